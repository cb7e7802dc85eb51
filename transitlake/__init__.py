"""transitlake: transit-survey catalog analytics written as Spark DataFrame jobs."""
