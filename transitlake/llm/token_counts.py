"""Token counts of fields and sections by offsets.

A document is rendered from its fields and encoded once, as a whole. The tokens' spans are
joined to the spans of fields and of the last field's sections, by binary search in the task
that holds the document, as no document's spans concern another one; a token that crosses a
boundary is allotted by a named rule. Encoding parts one by one would count tokens that the
whole text never has.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: to the section of the token's first byte, of its last, or of most of its bytes (of equals the first)
RULES = ("first", "last", "most")
SECTIONS = "section long, name string, start long, `end` long, n_tokens long, n_crossing long"


def allotted(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross into or out of it, of each section. Tokens and sections
    both tile the text; given are their ends in bytes (an empty section ends where it begins)."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    # empty sections hold no byte: the last non-empty one that begins before the token's end
    owner = (first if rule == "first" else last).copy()
    crosses = np.flatnonzero(first != last)
    crossing = np.zeros(len(section_ends), np.int64)
    section_starts = np.concatenate([[0], section_ends[:-1]])
    for t in crosses:
        touched = np.arange(first[t], last[t] + 1)
        held = np.minimum(section_ends[touched], token_ends[t]) - np.maximum(section_starts[touched], starts[t])
        crossing[touched[held > 0]] += 1
        if rule == "most":
            owner[t] = touched[int(np.argmax(held))]
    return np.bincount(owner, minlength=len(section_ends)), crossing


def rendered(fields: list[bytes], separator: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The document and (field, end in bytes) of its sections: each field but the last with
    the separator behind it, and each separated piece of the last."""
    pieces = fields[-1].split(separator)
    parts = [f + separator for f in fields[:-1]] + [p + separator for p in pieces[:-1]] + [pieces[-1]]
    names = [*range(len(fields) - 1), *[len(fields) - 1] * len(pieces)]
    return b"".join(parts), list(zip(names, np.cumsum([len(p) for p in parts]).tolist()))


#: a pattern ending in this gives a run of blanks before a word, but for its last, as one piece
LONG_BLANKS, BLANK_RUN = r"\s+(?!\S)|\s+", r"\p{White_Space}{4096,}"


def encoded(coder, pattern: str, text: str) -> list[int]:
    """Tokens of a text. The library's matcher recurses once per blank of a run, so long runs
    are cut by the pattern's own rule and encoded as the one piece that they are."""
    if not pattern.endswith(LONG_BLANKS) or not text:
        return coder.encode_ordinary(text)
    import regex

    out, done = [], 0
    for run in regex.finditer(BLANK_RUN, text):
        end = run.end() - 1 if run.end() < len(text) else run.end()
        out += coder.encode_ordinary(text[done : run.start()])
        out += coder._encode_single_piece(text[run.start() : end])
        done = end
    return out + coder.encode_ordinary(text[done:])


def count(
    df: DataFrame, ranks: str, pattern: str, id: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"),
    separator: str = "\n", rule: str = "most",
) -> DataFrame:
    """One row per section of every document: ``id, section`` (from 0), ``name`` (its field),
    ``start``/``end`` (code points in the rendered document), ``n_tokens``, ``n_crossing``.

    The rendered document is the fields joined by ``separator``, nulls as empty. Each field
    is a section, the last one is parted at every separator; a separator belongs to the
    section before it. Over a document's sections ``n_tokens`` adds up to its tokens.
    Repeated rows and null ids are documents like others. ``ranks`` is the path of a file of
    base64 tokens and ranks, read by the driver and broadcast; its size is fixed.
    """
    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    shared = df.sparkSession.sparkContext.broadcast(table)
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")
    shown = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        width = np.zeros(max(shared.value.values()) + 1, np.int64)
        for token, rank in shared.value.items():
            width[rank] = len(token)
        mark = separator.encode()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            columns = [[v or b"" for v in batch.column(i + 1).cast(pa.binary()).to_pylist()] for i in range(len(shown))]
            out: list[list] = [[] for _ in range(7)]
            for own, *parts in zip(ids, *columns):
                whole, sections = rendered(parts, mark)
                tokens = encoded(coder, pattern, whole.decode("utf-8", "replace"))
                ends = np.cumsum(width[tokens]) if tokens else np.zeros(0, np.int64)
                limits = np.array([e for _, e in sections], np.int64)
                if len(tokens):
                    n, crossing = allotted(ends, limits, rule)
                else:
                    n = crossing = np.zeros(len(limits), np.int64)
                raw = np.frombuffer(whole, np.uint8)
                # code points that begin before each byte
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[limits]
                k = len(limits)
                cells = [[own] * k, range(k), [shown[f] for f, _ in sections], [0, *points[:-1].tolist()], points.tolist(), n.tolist(), crossing.tolist()]
                for held, new in zip(out, cells):
                    held.extend(new)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "section", "name", "start", "end", "n_tokens", "n_crossing"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    narrow = df.select(F.col(id).cast("long").alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return narrow.mapInArrow(run, f"id long, {SECTIONS}").withColumnRenamed("id", id)
