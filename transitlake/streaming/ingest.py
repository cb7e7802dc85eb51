"""Incremental ingest of uploaded files.

The table is kept as a compacted ``version=<tag>`` plus a log of batches. A batch
costs only its own size: it is written under its batch id and merged on read by
the latest-row-per-key rule, which gives the same table as rewriting everything
at each upload. ``compact`` writes the next version now and then. Replaying a
batch overwrites its own folder only, so a retry after a failure changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake import schema as S
from transitlake.functions.features import add_bundles, add_catalog_features
from transitlake.functions.labels import anonymous_id, class_of_upload, mission_from_flags
from transitlake.functions.numbers import clean_numbers
from transitlake.operators import running
from transitlake.operators.dedup import keep_one, stack_feeds
from transitlake.operators.filters import plausible, positive, split_labelled
from transitlake.operators.quality import winsorize
from transitlake.sources.readers import PLACE, read_by_header
from transitlake.sources.writers import latest_version, version_tag, write_version

SEQUENCE, REASON = "ingest_seq", "reject_reason"
#: parts of the table and the stage under which their rows are counted
PARTS = {"log": "labelled", "pool": "without_label", "rejects": "rejected"}


def _guessed_flags(columns: list[str]) -> dict[str, int]:
    """Mission from the column names; at most one flag, TESS before K2 before Kepler."""
    names = [c.lower() for c in columns]
    hints = {
        "is_tess": any("toi_" in n for n in names) or "tmag" in names,
        "is_k2": any("k2" in n for n in names),
        "is_kepler": any("koi_" in n for n in names),
    }
    chosen = next((f for f, hit in hints.items() if hit), None)
    return {f: int(f == chosen) for f in hints}


def normalise_upload(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Upload columns to unified ones: renames, flags, star id, label, no leaks. A row with
    two mission flags fails the job, or else gets a ``reject_reason``."""
    by_lower = {c.lower(): c for c in raw.columns}
    found = {by_lower[k]: v for k, v in S.UPLOAD_RENAMES.items() if k in by_lower and v not in raw.columns}
    targets: dict[str, str] = {}
    for source, target in found.items():
        targets.setdefault(target, source)
    df = raw.withColumnsRenamed({source: target for target, source in targets.items()})

    content = df.drop(*PLACE)  # the same row is the same star wherever its file lies
    new = {}
    if "star_id" in df.columns:
        new["star_id"] = F.coalesce(F.col("star_id").cast("string"), anonymous_id(content))
    else:
        named = [F.col(by_lower[c]).cast("string") for c in S.UPLOAD_STAR_IDS if by_lower.get(c) in df.columns]
        new["star_id"] = F.coalesce(*named[:1], anonymous_id(content))
    # flags that a file gives are not mixed with guessed ones
    guessed = _guessed_flags(raw.columns)
    if any(flag in df.columns for flag in guessed):
        for flag in guessed:
            new[flag] = F.coalesce(F.col(flag).try_cast("int"), F.lit(0)) if flag in df.columns else F.lit(0)
    else:
        new |= {flag: F.lit(value) for flag, value in guessed.items()}
    label = F.col("label_int") if "label_int" in df.columns else F.lit(None).cast("string")
    new["label_int"] = class_of_upload(label)
    return at_most_one_mission(df.withColumns(new).drop(*S.LEAKING_COLUMNS), strict)


def at_most_one_mission(df: DataFrame, strict: bool = True) -> DataFrame:
    """The same rows; one with two mission flags fails the job that reads it, or is marked."""
    total, fault = sum((F.col(f) for f in S.MISSION_FLAGS.values()), F.lit(0)), F.lit("a row carries more than one mission flag")
    if not strict:
        return df.withColumn(REASON, F.when(total > 1, fault))
    first = next(iter(S.MISSION_FLAGS.values()))
    return df.withColumn(first, F.when(total <= 1, F.col(first)).otherwise(F.raise_error(fault).cast("int")))


def engineer(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Numbers, bundles and features, clipping inside each file, then every quality filter."""
    errors = [f"{b}_err{n}" for b in S.BUNDLE_BASES for n in (1, 2)]
    typed = clean_numbers(df, [*S.NUMERIC_INPUTS, "t0_bjd", *errors])
    out = add_catalog_features(add_bundles(typed))
    by = [c for c in ("_file",) if c in out.columns]
    return plausible(positive(winsorize(out, by=by, approximate=approximate)))


def prepare(raw: DataFrame, approximate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled rows of one upload."""
    return split_labelled(engineer(normalise_upload(raw), approximate))


def merge_batch(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Union by name, then the last row per star and period: of the latest batch, in it of
    the file changed last, in a file the last line. Rows without a place are ordered by
    content, so the outcome does not depend on the run."""
    both = batch if current is None else current.unionByName(batch, allowMissingColumns=True)
    keys = [c for c in ("star_id", "period") if c in both.columns]
    content = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(both.columns)])
    placed = [F.col(c).desc_nulls_last() for c in ("_changed", "_file", "_block", "_line") if c in both.columns]
    return keep_one(both, keys, [F.col(SEQUENCE).desc(), *placed, content.asc()])


def sum_of(tables: list[DataFrame]) -> DataFrame:
    """Their rows together, as one row ``value``."""
    return reduce(DataFrame.unionByName, tables).agg(F.count("*").alias("value"))


class IngestTable:
    """Labelled rows (latest per key) and the pool of unlabelled rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, part: str) -> DataFrame | None:
        reader = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.folder}/{part}")
        try:
            return reader.parquet(f"{self.folder}/{part}")
        except Exception as error:
            if any(code in str(error) for code in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                return None
            raise

    def append(self, raw: DataFrame | list[DataFrame], batch_id: int, strict: bool = False) -> None:
        """One batch: uploads of one or several headers, normalised each by its own. A row that
        contradicts itself goes to the rejects with its reason, or in ``strict`` mode fails the
        batch. The batch's counts are appended to the quality log."""
        given = [normalise_upload(r, strict) for r in (raw if isinstance(raw, list) else [raw])]
        good = given if strict else [g.where(F.col(REASON).isNull()).drop(REASON) for g in given]
        uploads = [split_labelled(engineer(g)) for g in good]
        self._write("log", stack_feeds([labelled for labelled, _ in uploads]), batch_id)
        self._remember(batch_id)
        self._write("pool", stack_feeds([rest for _, rest in uploads]), batch_id)
        if not strict:
            self._write("rejects", stack_feeds([g.where(F.col(REASON).isNotNull()) for g in given]), batch_id)
        self._log(batch_id, sum_of([g.select(F.lit(1)) for g in given]))

    def append_catalog(self, raw: DataFrame, catalog: S.Catalog, batch_id: int) -> None:
        """One source catalog file as a batch of the table."""
        rows = process_catalog(raw, catalog)
        self._write("log", rows.drop("feed_ord", "rowid", "label_raw"), batch_id)
        self._remember(batch_id)

    def _write(self, part: str, rows: DataFrame, batch_id: int) -> None:
        stamped = rows.withColumn(SEQUENCE, F.lit(batch_id).cast("bigint"))
        stamped.write.mode("overwrite").parquet(f"{self.folder}/{part}/batch_id={batch_id}")

    def counts(self, batch_id: int | None = None) -> DataFrame:
        """Rows of each batch (or of one) by part, as quality log rows: ``stage, metric, value``."""
        found = [(part, self._read(part)) for part in PARTS]
        rows = [
            (r if batch_id is None else r.where(F.col("batch_id") == batch_id))
            .groupBy(F.concat(F.lit("batch "), F.col("batch_id").cast("string")).alias("metric"))
            .agg(F.count("*").alias("value"))
            .select(F.lit(PARTS[part]).alias("stage"), "metric", "value")
            for part, r in found
            if r is not None
        ]
        return reduce(DataFrame.unionByName, rows)

    def _log(self, batch_id: int, read: DataFrame) -> None:
        """The batch's rows as read, by part, and those that the filters dropped. A replayed
        batch replaces its own entries."""
        name = f"batch {batch_id}"
        arrived = read.select(F.lit("read").alias("stage"), F.lit(name).alias("metric"), "value")
        told = self.counts(batch_id)
        kept = told.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("kept"))
        left = arrived.select(F.lit("filtered").alias("stage"), "metric", (F.col("value") - kept.scalar()).alias("value"))
        entries = arrived.unionByName(told).unionByName(left)
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/quality_log/batch_id={batch_id}")

    def quality_log(self) -> DataFrame | None:
        """``stage, metric, value`` of all batches that were appended."""
        log = self._read("quality_log")
        return None if log is None else log.select("stage", "metric", "value")

    def _remember(self, batch_id: int) -> None:
        """What the batch changes in the value counts that the medians are made of.

        Of older batches the keys are read; values only of batches that hold a row which
        this one replaces, and only in the columns of the medians."""
        log = self._read("log")
        keys = [c for c in ("star_id", "period") if c in log.columns]
        columns = [c for c in dict.fromkeys([*S.NUMERIC_INPUTS, *S.FEATURE_COLUMNS]) if c in log.columns]
        placed = [c for c in ("_changed", "_file", "_block", "_line") if c in log.columns]
        batch = merge_batch(None, log.where(F.col("batch_id") == batch_id).drop("batch_id"))
        arrived = batch.select(*{*keys, *columns})
        older = log.where(F.col("batch_id") < batch_id)
        touched = batch.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        # one number a batch that the table ever took
        hit = [r[0] for r in older.select("batch_id", *keys).join(touched, same, "left_semi").select("batch_id").distinct().collect()]
        replaced = None
        if hit:
            rows = older.where(F.col("batch_id").isin(hit)).join(touched, same, "left_semi")
            # ties inside a file are decided by all columns, as when the table is read
            replaced = merge_batch(None, rows.drop("batch_id")).select(*{*keys, *columns, *placed})
        running.write_changes(running.changes(arrived, replaced, columns), f"{self.folder}/counts", batch_id)

    def medians(self) -> dict[str, float]:
        """Exact medians of the current rows, from the value counts of all batches: no row of
        an older batch is read, of the counts the bins that hold a median."""
        bins, values = self._read("counts/bins"), self._read("counts/values")
        return {} if bins is None else running.medians(bins, values)

    def refresh_medians(self, columns: list[str] | None = None) -> str:
        """Medians of the table as it is now, in a folder of their own."""
        path = f"{self.folder}/medians/{version_tag()}-{uuid.uuid4().hex[:8]}"
        rows = [(k, v) for k, v in self.medians().items() if columns is None or k in columns]
        self.spark.createDataFrame(rows, "key string, value double").coalesce(1).write.mode("errorifexists").json(path)
        return path

    def latest_medians(self) -> DataFrame | None:
        """``key, value`` of the newest refresh."""
        try:
            found = self.spark.read.schema("key string, value double").json(f"{self.folder}/medians/*")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        made = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        newest = found.select(made.alias("made")).agg(F.max("made")).scalar()
        return found.where(made == newest)

    def current(self) -> DataFrame | None:
        """Latest version merged with the batches that came after it."""
        log = self._read("log")
        tag = latest_version(self.spark, f"{self.folder}/versions")
        if tag is None:
            return None if log is None else merge_batch(None, log.drop("batch_id"))
        base = self.spark.read.parquet(f"{self.folder}/versions/version={tag}")
        if log is None:
            return base
        done = base.agg(F.coalesce(F.max(SEQUENCE), F.lit(-1)).alias("m")).scalar()
        return merge_batch(base, log.where(F.col("batch_id") > done).drop("batch_id"))

    def pool(self) -> DataFrame | None:
        rows = self._read("pool")
        return None if rows is None else rows.drop("batch_id")

    def compact(self, tag: str | None = None) -> str:
        """Write the merged table as a new version; the old one stays as a backup."""
        return write_version(self.current(), f"{self.folder}/versions", tag)

    def ingest_new_files(self, source: str, checkpoint: str, files_per_batch: int = 1000) -> None:
        """Pick up every CSV that has arrived since the last run, then stop.

        The stream only says which files are new; each is read by its own header.
        """

        def take(lines: DataFrame, batch_id: int) -> None:
            # at most files_per_batch names
            files = [r[0] for r in lines.select("file").distinct().collect()]
            if files:
                self.append(read_by_header(self.spark, files, placed=True), batch_id)
                self.refresh_medians()

        stream = self.spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
        query = (
            stream.select(F.col("_metadata.file_path").alias("file"))
            .writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def process_catalog(raw: DataFrame, catalog: S.Catalog) -> DataFrame:
    """One source catalog file as a batch: mapped, clipped, labelled, deduplicated."""
    from transitlake.operators.dedup import drop_repeats
    from transitlake.operators.filters import labelled
    from transitlake.plans.build import enrich, map_catalog

    return drop_repeats(labelled(winsorize(enrich(map_catalog(raw, catalog)))))


def with_mission(df: DataFrame) -> DataFrame:
    return df.withColumn("mission", mission_from_flags())
