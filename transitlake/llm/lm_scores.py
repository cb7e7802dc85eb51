"""Stupid-backoff scores of every document by the n-gram counts of all others.

Words are kept in blocks: a block holds whole documents as codes into its own word list.
Each block sends its distinct n-grams of each order, with their counts, to the count table,
which is partitioned by hash; a partition adds up what all blocks sent and answers each
block with the totals of its n-grams. The join back is thus one row per block and
partition, not one per occurrence; blocks are stored in buckets, to which only the answers
are shuffled. In the block the totals meet the documents' n-grams and are summed per document. A document's own counts are taken off first, so that it does not
vouch for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import bucketed

#: words after which a block is closed (it ends with a whole document)
BLOCK_WORDS = 2_000_000
#: words of the corpus per partition of a count table
PART_WORDS = 4_000_000
BACKOFF = 0.4
MULTIPLIER = 0x9E3779B97F4A7C15
BLOCKS = "block long, ids array<long>, n_words array<int>, words long, codes binary, vocabulary binary"


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes, all first bytes of the values before all second ones: codes are mostly
    small, and steps between sorted hashes leave their high bytes empty. Mixed with the low
    bytes, which are noise, the empty ones take some 20 % more."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(cell: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences to the value before, modulo 2^64; ``cumsum`` undoes it."""
    return np.diff(values, prepend=np.uint64(0))


def blocks_of(df: DataFrame, id: str, text: str, block_words: int) -> DataFrame:
    """One row per block; ``codes`` are packed int32, ``vocabulary`` holds steps of uint64 hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId() << 32, 0
        ids, lengths, codes, known = [], [], [], {}

        def row() -> pa.RecordBatch:
            flat = np.array(codes, np.int32)
            hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            # frequent words get small codes, which the files store shorter; equally frequent
            # ones go by hash, so that the vocabulary is made of short steps
            order = np.lexsort((hashed, -np.bincount(flat, minlength=len(known))))
            renamed = np.empty(len(known), np.int32)
            renamed[order] = np.arange(len(known), dtype=np.int32)
            cells = [[place + number], [ids], [lengths], [len(flat)], [packed(renamed[flat])], [packed(steps(hashed[order]))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            names = ["block", "ids", "n_words", "words", "codes", "vocabulary"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (raw or b"").split()
                ids.append(own)
                lengths.append(len(words))
                codes.extend([known.setdefault(w, len(known)) for w in words])
                if len(codes) >= block_words or len(ids) >= block_words:
                    yield row()
                    number += 1
                    ids, lengths, codes, known = [], [], [], {}
        if ids:
            yield row()

    return df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


def gram_hashes(hashed: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each word, 0 where the document has too few before."""
    out = np.zeros(len(hashed), np.uint64)
    if len(hashed) >= order:
        mixed = np.full(len(hashed) - order + 1, order, np.uint64)
        for i in range(order):  # wraps: arithmetic modulo 2^64
            mixed = (mixed ^ hashed[i : i + len(mixed)]) * np.uint64(MULTIPLIER)
            mixed ^= mixed >> np.uint64(31)
        out[order - 1 :] = np.maximum(mixed, np.uint64(1))
    for i in range(order - 1):
        out[starts[starts + i < len(out)] + i] = 0
    return out


def opened(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and each document's first word and length."""
    lengths = np.array(block["n_words"], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    vocabulary = np.cumsum(unpacked(block["vocabulary"], np.uint64), dtype=np.uint64)
    hashed = vocabulary[unpacked(block["codes"], np.int32)]
    return hashed, starts, lengths


def part_bounds(parts: int) -> np.ndarray:
    """Where the ranges of the partitions begin, equal parts of the hash space."""
    return np.array([(i << 64) // parts for i in range(parts)], dtype=np.uint64)


def score(
    df: DataFrame, id: str = "doc_id", text: str = "text", order: int = 3,
    block_words: int = BLOCK_WORDS, part_words: int = PART_WORDS,
) -> DataFrame:
    """``id, n_words, log_score, mean_log_score`` for every row.

    Words are runs without the six ASCII blanks. A word scores ``c(gram) / c(gram without its
    last word)`` for the longest of its n-grams, of up to ``order`` words, that other
    documents hold (``c`` counts in these), times ``BACKOFF`` for each word that had to be
    left off; a single word scores ``c / words of the others``, with ``c`` at least 1. Scores
    are summed as natural logarithms. A null or empty text has no words, score 0 and a null
    mean. Repeated rows are documents of their own, null ids too.
    """
    blocks = bucketed(blocks_of(df, id, text, block_words), "block")
    total = blocks.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-total // part_words))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = part_bounds(parts)
        for rows in batches:
            for block in rows.to_dict("records"):
                hashed, starts, _ = opened(block)
                for n in range(1, order + 1):
                    grams, counts = np.unique(gram_hashes(hashed, starts, n), return_counts=True)
                    kept = grams > 0
                    grams, counts = grams[kept], counts[kept].astype(np.uint32)
                    cuts = [*np.searchsorted(grams, bounds).tolist(), len(grams)]
                    made = [(n, p, block["block"], packed(steps(grams[a:b])), packed(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                    yield pd.DataFrame(made, columns=["order", "part", "block", "grams", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.cumsum(unpacked(g, np.uint64), dtype=np.uint64) for g in rows["grams"]]
        counts = np.concatenate([unpacked(c, np.uint32) for c in rows["counts"]])
        _, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(place, weights=counts).astype(np.uint64)[place]
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        # most totals are small: the narrowest type that holds them
        shown = [t.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(t) or t.max() <= np.iinfo(k).max)) for t in np.split(totals, cuts)]
        return pd.DataFrame({
            "order": rows["order"], "part": rows["part"], "block": rows["block"],
            "width": [t.itemsize for t in shown], "totals": [packed(t) for t in shown],
        })

    def finish(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = {"id": "Int64", "n_words": "int64", "log_score": "float64"}
        if not len(block):
            return pd.DataFrame({c: pd.array([], k) for c, k in columns.items()})
        block = block.iloc[0]
        hashed, starts, lengths = opened(block)
        document = np.repeat(np.arange(len(lengths)), lengths)
        others = total - lengths[document]
        answers = answers.sort_values(["order", "part"])
        # counts of the n-gram ending at each word, without those of the word's document
        counts = {}
        for n in range(1, order + 1):
            mine = answers[answers["order"] == n]
            totals = np.concatenate([np.zeros(0, np.int64), *(unpacked(t, f"u{w}").astype(np.int64) for t, w in zip(mine["totals"], mine["width"]))])
            grams = gram_hashes(hashed, starts, n)
            unique, place = np.unique(grams, return_inverse=True)
            totals = np.concatenate([np.zeros(int(len(unique) and unique[0] == 0), np.int64), totals])
            key = place.astype(np.int64) * max(1, len(lengths)) + document
            _, own, times = np.unique(key, return_inverse=True, return_counts=True)
            counts[n] = np.where(grams > 0, totals[place] - times[own], 0)
        logs = np.log(np.maximum(counts[1], 1)) - np.log(np.maximum(others, 1))
        reach = np.arange(len(document)) - starts[document] if len(document) else np.zeros(0, int)
        for n in range(2, order + 1):
            before = np.concatenate([[0], counts[n - 1][:-1]]) if len(document) else counts[n - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                longer = np.log(counts[n]) - np.log(before)
            # a word too near the start of its document has no longer n-gram to leave off
            logs = np.where(counts[n] > 0, longer, logs + np.where(reach >= n - 1, np.log(BACKOFF), 0.0))
        sums = np.bincount(document, weights=logs, minlength=len(lengths)) if len(document) else np.zeros(len(lengths))
        return pd.DataFrame({"id": pd.array([None if pd.isna(i) else int(i) for i in block["ids"]], "Int64"), "n_words": lengths, "log_score": sums})

    sent = blocks.mapInPandas(send, "order int, part long, block long, grams binary, counts binary")
    answers = sent.groupBy("order", "part").applyInPandas(
        add, "order int, part long, block long, width int, totals binary"
    )
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        finish, "id long, n_words long, log_score double"
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return found.select(F.col("id").alias(id), "n_words", "log_score", mean.alias("mean_log_score"))
