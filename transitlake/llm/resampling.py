"""Importance resampling toward a target corpus over hashed word n-grams.

A feature's bucket is its CRC-32 modulo a bucket count; a bucket's gain is the log ratio of
its smoothed shares in the target and in the raw corpus, and a document's weight is the sum
of its features' gains. Adding Gumbel noise that depends on the document's id alone and
taking the highest scores draws without replacement in proportion to ``exp(weight)``.

CRC-32 without a byte loop: the register is linear over XOR, so a message's CRC is the XOR
of what each byte contributes at its distance from the end (a table of ``DEPTH`` x 256), and
of a constant that depends on the length. All features of a batch are one gather and one
``bitwise_xor.reduceat``. A span of more than ``DEPTH`` bytes is cut into blocks counted
from its end; block values are then folded in pairs, the front one moved on by as many zero
bytes as the block behind it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm.common import blank_null, stored, without
from transitlake.operators.ranks import RANGES, with_ranges

#: distances from the end that the table knows, and bytes that one gather handles
DEPTH, GATHER = 64, 1 << 18
#: the reflected CRC-32 polynomial; a fixed value
POLYNOMIAL = 0xEDB88320
MEASURES = "n_words long, n_features long"


def first_table() -> np.ndarray:
    """Contribution of a last byte: eight steps of the shift register."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = np.where(register & 1, (register >> 1) ^ np.uint32(POLYNOMIAL), register >> 1).astype(np.uint32)
    return register


class PositionTable:
    """``at[d * 256 + b]``: what byte ``b`` contributes ``d`` bytes before the end."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.last = first_table()
        rows = [self.last]
        for _ in range(depth - 1):
            rows.append(self.one_on(rows[-1]))
        self.at = np.concatenate(rows)
        # moves[j]: the register after 2**j zero bytes, as four tables of its bytes
        basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
        self.moves = [self.one_on(basis)]
        self.ends = self.length_constants(np.arange(depth + 1))

    def one_on(self, register: np.ndarray) -> np.ndarray:
        return (register >> np.uint32(8)) ^ self.last[register & np.uint32(255)]

    def moved(self, register: np.ndarray, power: int) -> np.ndarray:
        """The register after ``2**power`` zero bytes."""
        while len(self.moves) <= power:
            self.moves.append(self._applied(self.moves[-1], self.moves[-1]))
        return self._applied(self.moves[power], register)

    @staticmethod
    def _applied(move: np.ndarray, register: np.ndarray) -> np.ndarray:
        out = move[0][register & np.uint32(255)]
        for i in (1, 2, 3):
            out = out ^ move[i][(register >> np.uint32(8 * i)) & np.uint32(255)]
        return out

    def length_constants(self, lengths: np.ndarray) -> np.ndarray:
        """The CRC of that many zero bytes: start value and final complement."""
        register = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
        for power in range(int(lengths.max(initial=0)).bit_length()):
            on = (lengths >> power) & 1 == 1
            register[on] = self.moved(register[on], power)
        return ~register

    def crc(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of ``raw[starts[i]:ends[i]]``; spans may overlap and are not empty."""
        lengths = ends - starts
        if not len(lengths):
            return np.zeros(0, np.uint32)
        blocks = -(-lengths // self.depth)
        if blocks.max() == 1:
            return self._short(raw, starts, ends) ^ self.ends[lengths]
        span = np.repeat(np.arange(len(lengths)), blocks)
        behind = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))
        until = ends[span] - behind * self.depth
        value = self._short(raw, np.maximum(starts[span], until - self.depth), until)
        power = self.depth.bit_length() - 1
        while behind.max():
            odd = behind & 1 == 1
            value[odd] = self.moved(value[odd], power)
            behind >>= 1
            power += 1
            first = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (behind[1:] != behind[:-1])]))
            value, span, behind = np.bitwise_xor.reduceat(value, first), span[first], behind[first]
        constants = self.ends[np.minimum(lengths, self.depth)]
        long = lengths > self.depth
        constants[long] = self.length_constants(lengths[long])
        return value ^ constants

    def _short(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XORed contributions of spans of 1 to ``depth`` bytes, some ``GATHER`` bytes at a time."""
        lengths = ends - starts
        upto = np.cumsum(lengths)
        out, done = np.empty(len(lengths), np.uint32), 0
        while done < len(lengths):
            before = upto[done - 1] if done else 0
            stop = max(int(np.searchsorted(upto, before + GATHER, "right")), done + 1)
            size = lengths[done:stop]
            offsets = upto[done:stop] - size - before
            place = np.arange(int(size.sum()))
            byte = raw[place + np.repeat(starts[done:stop] - offsets, size)]
            distance = np.repeat(offsets + size - 1, size) - place
            out[done:stop] = np.bitwise_xor.reduceat(self.at[distance * 256 + byte], offsets)
            done = stop
        return out


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, and whether a lowered byte belongs to a word: digits, a-z and
    every byte of a character beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    return lower, inside


def features(texts: list[bytes], table: PositionTable, tables, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, and the text and CRC of every feature: runs of ``shortest`` to
    ``longest`` consecutive words, joined by one space."""
    lower, inside = tables
    raw = lower[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    held = inside[raw]
    edge = held[1:] != held[:-1]
    # a word's bytes and the one behind it stay: words joined by one byte each
    kept = held.copy()
    kept[1:] |= held[:-1]
    first = np.flatnonzero(np.concatenate([held[:1], edge & held[1:]]))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, "right")
    words = raw[kept]
    solid = held[kept]
    words[~solid] = 32
    ends = np.flatnonzero(~solid)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    of, crcs = [], []
    for n in range(shortest, longest + 1):
        if len(starts) < n:
            break
        a, b = starts[: len(starts) - n + 1], ends[n - 1 :]
        same = owner[: len(a)] == owner[n - 1 :]
        of.append(owner[: len(a)][same])
        crcs.append(table.crc(words, a[same], b[same]))
    none = np.zeros(0, np.int64)
    return np.bincount(owner, minlength=len(texts)), np.concatenate([none, *of]), np.concatenate([none, *crcs]).astype(np.int64)


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def bucket_counts(df: DataFrame, text: str, buckets: int, shortest: int = 1, longest: int = 1) -> DataFrame:
    """``bucket, n``: features of every text in each bucket that has any. A task adds up its
    texts and hands on one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tables, total = PositionTable(), byte_tables(), np.zeros(buckets, np.int64)
        for batch in batches:
            _, _, crcs = features(_texts(batch, 0), table, tables, shortest, longest)
            total += np.bincount(crcs % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    parts = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` for every bucket, in thousandths, from the two corpora's counts:
    shares are smoothed by one feature a bucket."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    every = raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"), *[F.lit(0).cast("long").alias(c) for c in "st"])
    counted = stored(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = counted.agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    smooth = F.lit(float(buckets))
    ratio = ((t + 1) * (whole.select("s").scalar() + smooth)) / ((s + 1) * (whole.select("t").scalar() + smooth))
    return counted.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(df: DataFrame, text: str, gain: list[int], shortest: int = 1, longest: int = 1) -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight``, and drop the text. Map-only."""
    at = df.columns.index(text)
    places = [i for i in range(len(df.columns)) if i != at]
    rest = df.select(*[F.col(f"`{df.columns[i]}`") for i in places])
    schema = ", ".join([*([rest._jdf.schema().toDDL()] if places else []), MEASURES, "weight long"])
    buckets, gained = len(gain), np.array(gain, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tables = PositionTable(), byte_tables()
        for batch in batches:
            n = batch.num_rows
            words, of, crcs = features(_texts(batch, at), table, tables, shortest, longest)
            # integers below 2**53: sums of doubles are exact
            weight = np.bincount(of, gained[crcs % buckets], minlength=n)
            made = [words, np.bincount(of, minlength=n), weight]
            names = [*(batch.schema.names[i] for i in places), "n_words", "n_features", "weight"]
            columns = [pa.array(m.astype(np.int64), pa.int64()) for m in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *columns], names=names)

    return df.mapInArrow(run, schema)


def noise(id: str, seed: int) -> Column:
    """Standard Gumbel noise in thousandths from the id alone."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, eligible: Column, percent: int, id: str) -> DataFrame:
    """Add ``rank``: 1, 2, 3 ... for the ``percent`` of eligible rows of the highest scores,
    ties to smaller ids, null for all others.

    Scores are cut into ranges; a range's rows are counted, and only the ranges that reach
    into the draw are sorted, each on its own. What is joined has one row a range. Counting
    and ranking are two jobs, so the ranges' bounds are kept between them.
    """
    marked = with_ranges(scored.withColumn("_order", F.when(eligible, F.col("score"))), "_order", kept=True)
    marked = marked.withColumn(RANGES, F.when(F.col("_order").isNotNull(), F.col(RANGES)))
    above = Window.orderBy(F.col(RANGES).desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = marked.where(F.col(RANGES).isNotNull()).groupBy(RANGES).agg(F.count("*").alias("_n"))
    before = stored(held.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0))))
    taken = before.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * percent / 100).alias("k")).scalar()
    known = before.select(F.col(RANGES).alias("_at"), "_before")
    placed = marked.join(F.broadcast(known), F.col(RANGES) == F.col("_at"), "left").withColumn("_k", taken)
    inside = Window.partitionBy(RANGES).orderBy(F.col("score").desc(), F.col(id).asc_nulls_last())
    rank = F.row_number().over(inside).cast("long") + F.col("_before")
    reached = F.coalesce(F.col("_before") < F.col("_k"), F.lit(False))
    ranked = placed.where(reached).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("_k"), F.col("rank")))
    others = placed.where(~reached).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("_order", RANGES, "_at", "_before", "_k")


def resample(
    df: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = 10_000,
    shortest: int = 1, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """All rows of ``df`` without their text, with ``n_words``, ``n_features``, ``weight``,
    ``score`` and ``rank`` (null: not drawn); columns of these names are replaced.

    ``target`` holds texts in a column of the same name. A null text has no words, weight 0
    and is not eligible for the draw; a document needs ``least_words``. Rows equal in id and
    score are ranked in any order among themselves, null ids last. Gains go to the workers:
    ``buckets`` numbers, whatever the data. Text is read twice and never shuffled.
    """
    kept = without(df, "n_words", "n_features", "weight", "score", "rank")
    counted = [bucket_counts(x.select(blank_null(text).alias("text")), "text", buckets, shortest, longest) for x in (kept, target)]
    gain = [r["gain"] for r in gains(*counted, buckets).orderBy("bucket").collect()]
    # columns that the steps here add may clash with the input's: they travel in one struct
    carried = kept.select(F.col(id).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in kept.columns if c != text]).alias("_row"), blank_null(text).alias("_text"))
    weights = weighed(carried, "_text", gain, shortest, longest)
    scored = stored(weights.withColumn("score", F.col("weight") + noise("_id", seed)))
    ranked = drawn(scored, F.col("n_words") >= least_words, percent, "_id")
    return ranked.select("_row.*", "n_words", "n_features", "weight", "score", "rank")
