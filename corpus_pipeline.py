"""From raw documents to token ids: five stages, each by one operator of the package.

A stage takes what its predecessor kept, as written and read again. All but the last return
the columns of documents. SQL cannot express certified cutoffs, tries or BPE, so there is no
check SQL; tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.llm import bpe, mixing, ngram_join, quality_rules, secrets
from transitlake.llm.common import bounded_batches, stored, table, word_count
from transitlake.llm.queries import vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    measured = stored(quality_rules.measure(docs.select("doc_id", "lang", "text"), keep_text=False))
    cutoffs = quality_rules.fit(measured, table(spark, sf_dir, "labels"))
    # measured again beside the text: cheaper than moving every text to its verdict
    return quality_rules.judge(quality_rules.measure(docs), cutoffs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays."""
    bounded_batches(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS), n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kind's name; the length follows."""
    clean = secrets.redacted(secrets.scan(docs.select(*COLUMNS)))
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.select(*COLUMNS).withColumn("_size", word_count("text")).withColumn("_content", F.xxhash64("text"))
    mixed = mixing.mix(sized, ["doc_id", "_content"], size="_size").where(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy."""
    bounded_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary_path("word_bpe_49k.json"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources", mixture),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
