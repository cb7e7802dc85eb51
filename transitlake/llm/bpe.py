"""BPE encoding and decoding of whole texts with a published vocabulary.

Each pre-token ("word") is merged on a contiguous rank array: one list holds the parts
between the boundaries still standing, a second one the rank of each adjacent pair. The
smallest rank is looked for again and again, its boundary deleted and the two
neighbouring ranks refreshed. That is quadratic in a word's length, so words of more
than ``SHORT`` symbols take the same merges in the same order from a heap instead.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from transitlake.llm.common import without

#: symbols of a word up to which the rank array is scanned
SHORT = 128
#: words that a task remembers with their ids before it starts afresh
REMEMBERED = 400_000
NEVER = 1 << 60
# fixed values: the white space of the vocabulary's patterns, and the pattern with it
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: the same where a text has code points from LATER on, some of which only newer Unicode versions call letters
LATER = "\u0530"
PIECES_LATER = rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![%s])\p{{L}})+|(?![%s])\p{{N}}|(?:[^{SPACE}\p{{L}}\p{{N}}]|[%s])+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else
    the next unused code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


# fixed values: code points that the regex module calls letters or numbers and the vocabulary's
# library, of an older Unicode version, does not
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F "
)


def newer_letters() -> str:
    """``NEWER`` as the inside of a character class."""
    ends = (r.split("-") for r in NEWER.split())
    return "".join(f"{chr(int(e[0], 16))}-{chr(int(e[-1], 16))}" for e in ends)


# fixed values: lower case of letters newer than Python's tables
LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


class Vocabulary:
    """Merges and tokens of a word BPE in the JSON layout of the tokenizers library
    (NFC, lower case, pieces of letters, single digits and signs, bytes as letters,
    a suffix at each word's end, no decoder)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.newer = newer_letters()
        letters = byte_letters()
        self.first = [ids.get(c) for c in letters]
        self.last = [ids.get(c + self.end) for c in letters]
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (left, right) in enumerate(model["merges"]):
            self.pairs.setdefault((ids[left], ids[right]), rank)
            self.merged.append(ids[left + right])

    @classmethod
    def of(cls, tables: dict) -> Vocabulary:
        """From the tables of another one."""
        made = cls.__new__(cls)
        vars(made).update(tables)
        return made

    def word(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        raw = piece.encode("utf-8", "replace")
        parts = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return tuple(by_rank_array(parts, self.pairs, self.merged) if len(parts) <= SHORT else by_heap(parts, self.pairs, self.merged))


def by_rank_array(parts: list[int], pairs: dict, merged: list[int]) -> list[int]:
    ranks = [pairs.get(pair, NEVER) for pair in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == NEVER:
            break
        at = ranks.index(least)
        parts[at] = merged[least]
        del parts[at + 1], ranks[at]
        if at:
            ranks[at - 1] = pairs.get((parts[at - 1], parts[at]), NEVER)
        if at < len(ranks):
            ranks[at] = pairs.get((parts[at], parts[at + 1]), NEVER)
    return parts


def by_heap(parts: list[int], pairs: dict, merged: list[int]) -> list[int]:
    """The same merges for a long word: smallest rank first, then leftmost."""
    n = len(parts)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(pairs[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, at = heapq.heappop(heap)
        right = following[at]
        if parts[at] < 0 or right >= n or pairs.get((parts[at], parts[right])) != rank:
            continue
        parts[at], parts[right] = merged[rank], -1
        following[at] = after = following[right]
        if after < n:
            before[after] = at
        for i, j in ((before[at], at), (at, after)):
            if i >= 0 and j < n and (found := pairs.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (found, i))
    return [p for p in parts if p >= 0]


class Coder:
    """Encodes and decodes texts with a memory of the words met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces = regex.compile(PIECES)
        self.pieces_later = regex.compile(PIECES_LATER.replace("%s", vocabulary.newer))
        self.later = regex.compile(f"[{LATER}-\U0010ffff]")
        marks = "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        special = self.vocabulary.special
        parts = self.marks.split(text) if self.marks and any(s in text for s in special) else [text]
        for part in parts:
            if part in special:
                out.append(special[part])
                continue
            known = self.known
            part = normal(part)
            pieces = self.pieces
            if self.later.search(part):
                part, pieces = part.translate(LOWER), self.pieces_later
            for piece in pieces.findall(part):
                try:
                    out += known[piece]
                except KeyError:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids = self.vocabulary.word(piece)
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens joined by one space."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


def normal(text: str) -> str:
    """NFC, then each letter's own lower case (a final sigma gets no special form)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``ids`` (array<int>) and ``decoded`` (the ids turned back into text).

    ``vocabulary`` is the path of the vocabulary file; the driver reads it and its
    tables, whose size the file fixes, are broadcast. A null or empty text gives no ids
    and an empty decoded text. Repeated rows stay; rows are neither moved nor shuffled.
    Columns already named like an output are replaced.
    """
    spark = df.sparkSession
    kept = without(df, ids, decoded)
    shared = spark.sparkContext.broadcast(vars(Vocabulary(vocabulary)))
    at = kept.columns.index(text)
    schema = f"{kept._jdf.schema().toDDL()}, `{ids}` ARRAY<INT>, `{decoded}` STRING" if kept.columns else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary.of(shared.value))
        for batch in batches:
            found = [coder.encode(t) if t else [] for t in batch.column(at).to_pylist()]
            back = [coder.decode(i) for i in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int32())), pa.array(back, pa.string())],
                names=[*batch.schema.names, ids, decoded],
            )

    return kept.mapInArrow(run, schema)
