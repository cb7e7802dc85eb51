"""Exact order statistics of many columns by radix selection.

A double's bits, arranged to sort like the number, are digits of 16, 24 and 24 bits. One
pass counts the highest digit of every value, per group and column; the running counts say
in which digit each wanted rank lies; the next pass counts the next digit of just the values
with that prefix. After three passes the value is known to the last bit. A task adds up its
rows, so what is shuffled per pass is a row per (group, column, prefix, digit) at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.numbers import finite
from transitlake.session import cut_lineage, written

#: bits of a value that are known after each pass
KNOWN = (16, 40, 64)
#: groups that the passes may carry in their closure
MOST_GROUPS = 10_000
SIGN = np.uint64(1 << 63)


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    raw = (values + 0.0).view(np.uint64)
    return np.where(raw & SIGN, ~raw, raw | SIGN)


def from_sortable(code: int) -> float:
    raw = np.uint64(code)
    return float(np.array([raw ^ SIGN if raw & SIGN else ~raw], np.uint64).view(np.float64)[0])


def _groups_of(batch: pa.RecordBatch, width: int, numbers: dict) -> np.ndarray:
    """The number of each row's group."""
    out = np.zeros(batch.num_rows, np.int64)
    if not width:
        return out
    values, size = [], 1
    for i in range(width):
        coded = batch.column(i).dictionary_encode(null_encoding="encode")
        values.append(coded.dictionary.to_pylist())
        out += coded.indices.to_numpy(zero_copy_only=False) * size
        size *= len(values[-1])
    met, where = np.unique(out, return_inverse=True)
    keys = []
    for code in met.tolist():
        key = []
        for held in values:
            code, at = divmod(code, len(held))
            key.append(held[at])
        keys.append(numbers[tuple(key)])
    return np.array(keys, np.int64)[where]


def digit_counts(values: DataFrame, by: list[str], columns: int, numbers: dict, level: int, prefixes: dict) -> DataFrame:
    """``g, slot, prefix, digit, n``: values per digit of this level, among those whose higher
    digits are one of ``prefixes[g, slot]`` (sorted; all values at level 0)."""
    shift, width = np.uint64(64 - KNOWN[level]), np.uint64(KNOWN[level] - (KNOWN[level - 1] if level else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            group = _groups_of(batch, len(by), numbers)
            split = [(int(g), group == g) for g in np.unique(group)]
            held = batch.column(len(by)).flatten()
            filled = held.is_valid().to_numpy(zero_copy_only=False).reshape(-1, columns)
            cells = held.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, columns)
            for slot in range(columns):
                present, codes = filled[:, slot], sortable(cells[:, slot])
                for g, rows in split:
                    mine = codes[rows & present] >> shift
                    if level:
                        wanted = prefixes.get((g, slot))
                        if wanted is None:
                            continue
                        above = mine >> width
                        at = np.minimum(np.searchsorted(wanted, above), len(wanted) - 1)
                        mine = mine[wanted[at] == above]
                    if not level:
                        dense = np.bincount(mine.astype(np.int64), minlength=1 << KNOWN[0])
                        total[g, slot] = total[g, slot] + dense if (g, slot) in total else dense
                    elif len(mine):
                        known = total.setdefault((g, slot), {})
                        for code, n in zip(*(a.tolist() for a in np.unique(mine, return_counts=True))):
                            known[code] = known.get(code, 0) + n
        if not level:
            total = {k: {c: int(dense[c]) for c in np.flatnonzero(dense).tolist()} for k, dense in total.items()}
        rows = [(g, slot, code, n) for (g, slot), held in total.items() for code, n in held.items()]
        g, slot, code, n = (np.array(c, np.uint64) for c in zip(*rows)) if rows else (np.zeros(0, np.uint64),) * 4
        # the last level's codes use all 64 bits: they travel with the sign bit turned
        parts = [pa.array(g.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array((code ^ SIGN).view(np.int64)), pa.array(n.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(parts, names=["g", "slot", "code", "n"])

    # one array a row leaves the JVM at a fraction of the time that a column each takes
    rows = values.select(*by, F.array(*[F.col(f"_v{i}") for i in range(columns)]).alias("_cells"))
    parts = rows.mapInArrow(run, "g int, slot int, code long, n long")
    return parts.groupBy("g", "slot", "code").agg(F.sum("n").alias("n"))


def order_statistics(
    df: DataFrame, columns: list[str], shares: list[float], positions: Callable[[Column, int], Column], by: list[str] | None = None,
    kept: bool = False,
) -> DataFrame:
    """Exact values at chosen ranks: ``by..., column, which, n, position, value``.

    ``positions(n, k)`` gives, for share number ``k``, an array column of 1-based ranks among
    the ``n`` present values of a column. The narrow input is written once, unless the caller
    has ``kept`` it already, and read three times; nothing is sorted. Groups come from fixed lists (``MOST_GROUPS`` at most).
    """
    by = by or []
    spark = df.sparkSession
    cells = [finite(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)]
    values = df.select(*by, *cells)
    values = values if kept else written(values)
    kinds = values.select(*by).schema if by else None
    groups = [tuple(r) for r in values.select(*by).distinct().limit(MOST_GROUPS + 1).collect()] if by else [()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    numbers = {key: g for g, key in enumerate(groups)}

    targets: list[dict] = []
    for level in range(len(KNOWN)):
        prefixes: dict[tuple[int, int], list[int]] = {}
        for t in targets:
            prefixes.setdefault((t["g"], t["slot"]), []).append(t["code"])
        wanted = {k: np.array(sorted(set(v)), np.uint64) for k, v in prefixes.items()}
        counts = digit_counts(values, by, len(columns), numbers, level, wanted)
        if level == 0:
            counts = cut_lineage(counts)
            totals = counts.groupBy("g", "slot").agg(F.sum("n").alias("total"))
            asked = F.array(*[F.struct(F.lit(k).alias("which"), positions(F.col("total"), k).alias("at")) for k in range(len(shares))])
            ranks = totals.select("g", "slot", "total", F.explode(asked).alias("_a")).select("g", "slot", "total", "_a.which", F.explode("_a.at").alias("position"))
            targets = [{**r.asDict(), "code": 0, "rank": r["position"]} for r in ranks.collect()]
        if not targets:
            break
        # one row per wanted rank: its prefix so far, and its rank among the values below it
        schema = "g int, slot int, which int, position long, total long, above long, rank long"
        open_ranks = spark.createDataFrame(
            [(t["g"], t["slot"], t["which"], t["position"], t["total"], t["code"] - (1 << 63) if t["code"] >> 63 else t["code"], t["rank"]) for t in targets], schema
        ).withColumnsRenamed({"g": "_g", "slot": "_slot"})
        turned = F.col("code").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
        above = F.shiftrightunsigned(turned, KNOWN[level] - KNOWN[level - 1]) if level else F.lit(0).cast("long")
        placed = counts.withColumn("_above", above)
        upto = Window.partitionBy("g", "slot", "_above").orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = placed.withColumn("_upto", F.sum("n").over(upto))
        here = (F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("n"))
        same = (F.col("g") == F.col("_g")) & (F.col("slot") == F.col("_slot")) & (F.col("_above") == F.col("above"))
        # the wanted ranks are few by construction: groups x columns x ranks
        found = running.join(F.broadcast(open_ranks), same).where(here)
        found = found.select("g", "slot", "which", "position", "total", "code", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank"))
        targets = [{**r.asDict(), "code": int(np.int64(r["code"]).view(np.uint64) ^ SIGN)} for r in found.collect()]

    rows = [(*groups[t["g"]], columns[t["slot"]], t["which"], t["total"], t["position"], from_sortable(t["code"])) for t in targets]
    tail = "column string, which int, n long, position long, value double"
    named = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds or []]
    return spark.createDataFrame(rows, ", ".join([*named, tail]))
