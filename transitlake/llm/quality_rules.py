"""Quality rules whose cutoffs are chosen under a guarantee.

A rule rejects a document whose score exceeds a cutoff. Cutoffs come from labelled
documents: for each stratum and rule the grid is walked from its most lenient cutoff to
harsher ones, and a cutoff is certified while the exact binomial upper bound of the share
of good documents that it rejects stays within the rule's part of ``risk``. The walk stops
at the first failure (fixed-sequence testing), so the grid costs nothing; the error level
is divided by the number of strata and rules (Bonferroni). All certified cutoffs hold at
once with probability ``1 - error``, hence any of them may be picked: the one that
rejects the most bad documents, a good one counting as ``good_cost`` bad ones, and the most
lenient of equals. Without a certified and useful cutoff the rule is off in that stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import stored, without

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
WINDOW = 5
BLANKS, SYMBOLS, INNER = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))


def rules() -> dict[str, tuple[Column, list[int]]]:
    """Scores per thousand and their cutoffs, harsh to lenient."""
    per_mille = lambda part, whole: F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(F.lit(0))
    return {
        "symbols": (per_mille("n_symbols", "n_words"), [20, 50, 100, 150, 200, 300, 400, 500, 700, 1000, 1500, 2000, 2500]),
        "dup_lines": (per_mille("n_dup_lines", "n_lines"), [200, 250, 300, 350, 400, 500, 600, 700, 800, 900]),
        "repeats": (per_mille("n_repeat_words", "n_words"), [50, 75, 100, 125, 150, 175, 200]),
    }


def described(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """``MEASURES`` of one UTF-8 text."""
    words = raw.split()
    n = len(words)
    solid = raw.translate(None, BLANKS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            reach = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + WINDOW - max(reach, i)
                    reach = i + WINDOW
    return (
        n, len(solid.translate(None, INNER)), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines),
    )


def measure(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``MEASURES`` and ``base_failed`` to every row; columns of these names are replaced.

    A null text counts as empty: all measures 0, base failed. Words are runs without the six
    ASCII blanks, lines are parted by \\n. Rows stay where they are; nothing is shuffled.
    """
    kept = without(df, *MEASURES, "base_failed")
    at = kept.columns.index(text)
    shown = [c for c in kept.columns if keep_text or c != text]
    schema = kept.select(*[F.col(f"`{c}`") for c in shown])._jdf.schema().toDDL()
    schema = ", ".join([*([schema] if shown else []), *(f"{m} BIGINT" for m in MEASURES)])
    places = [i for i, c in enumerate(kept.columns) if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            found = [described(t or b"") for t in texts]
            made = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(MEASURES))]
            names = [batch.schema.names[i] for i in places]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *made], names=[*names, *MEASURES])

    measured = kept.mapInArrow(run, schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed from its largest term down."""
    if k >= n:
        return 1.0
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    if k > n * p:  # beyond the mean: no bound that could help
        return 1.0
    total, i = term, k
    while i > 0 and term > total * 1e-17:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return min(1.0, total)


def chosen_cutoff(
    cutoffs: list[int], good: list[int], bad: list[int], risk: float, error: float, good_cost: float
) -> int | None:
    """``good[i]``/``bad[i]``: labelled documents whose score exceeds just the first ``i``
    cutoffs. The certified cutoff of the largest gain, or None."""
    n, best, gain = sum(good), None, 0.0
    good_out = bad_out = 0
    for i in range(len(cutoffs), 0, -1):
        good_out += good[i]
        bad_out += bad[i]
        if n == 0 or binomial_tail(good_out, n, risk) > error:
            break
        if bad_out - good_cost * good_out > gain:
            best, gain = cutoffs[i - 1], bad_out - good_cost * good_out
    return best


def fit(
    measured: DataFrame, labels: DataFrame, id: str = "doc_id", stratum: str = "lang",
    risk: float = 0.01, error: float = 0.05, good_cost: float = 20.0,
) -> DataFrame:
    """One row per stratum: ``stratum`` and ``cut_<rule>`` (null: off).

    ``labels``: doc id and ``quality`` (1 good, 0 bad; nulls are no labels; of several
    labels the worst counts). Every labelled document that passes the base rules takes part;
    a null stratum is a stratum of its own. Only (stratum, rule, score step) counts are
    shuffled, combined map-side, so a hot stratum is no more than a few rows a task.
    """
    told = labels.where(F.col(id).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id).alias("_id"))
    told = told.agg(F.min("quality").alias("_quality"))
    sized = rules()
    steps = [
        F.struct(F.lit(name).alias("rule"), sum((score > c).cast("int") for c in cuts).alias("step"))
        for name, (score, cuts) in sized.items()
    ]
    held = measured.where(~F.col("base_failed")).join(told, F.col(id) == F.col("_id"))
    counted = (
        held.select(F.col(stratum).alias("stratum"), (F.col("_quality") >= 1).alias("good"), F.explode(F.array(*steps)).alias("_s"))
        .groupBy("stratum", "_s.rule", "_s.step")
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    counted = stored(counted)
    tests = counted.select(F.count_distinct(F.struct("stratum")).alias("n")).scalar() * len(sized)
    grids = {name: cuts for name, (_, cuts) in sized.items()}

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = grids[rows["rule"].iloc[0]]
        good, bad = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
        for step, g, b in zip(rows["step"], rows["good"], rows["bad"]):
            good[int(step)] += int(g)
            bad[int(step)] += int(b)
        cut = chosen_cutoff(cuts, good, bad, risk / len(grids), error / float(rows["tests"].iloc[0]), good_cost)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "rule": [rows["rule"].iloc[0]], "cut": pd.array([cut], "Int64")})

    keyed = counted.withColumn("tests", tests)
    cut = keyed.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cut long")
    columns = [F.max(F.when(F.col("rule") == name, F.col("cut"))).alias(f"cut_{name}") for name in sized]
    return stored(cut.groupBy("stratum").agg(*columns))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``kept`` to measured rows: false where the base failed or a cutoff of the row's
    stratum is exceeded; a stratum without cutoffs keeps the rest. ``cutoffs`` has a row
    per stratum and is joined by its stored size."""
    at = cutoffs.withColumnsRenamed({c: f"_c_{c}" for c in cutoffs.columns})
    joined = measured.join(at, F.col(stratum).eqNullSafe(F.col("_c_stratum")), "left")
    over = F.lit(False)
    for name, (score, _) in rules().items():
        over = over | F.coalesce(score > F.col(f"_c_cut_{name}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop(*at.columns)
