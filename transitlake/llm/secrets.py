"""Secret scans over a trigram inverted index.

Each rule's regex is reduced to a Boolean query over trigrams that any match must hold:
an OR of clauses, each an AND of trigrams. The index keeps postings (trigram, document)
for the trigrams that the rules ask for; the postings of a clause are intersected by
counting, and only the documents of a satisfied clause are verified with the regex. A rule
from which no trigram follows is run over every text. Trigrams are taken in lower case, so
that one index serves rules with and without case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import blank_null, without

#: alternatives that a piece of a regex may expand to before it counts as "anything"
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; of each match the characters
    of ``group`` must number ``at_least``, else the match is dropped (it still consumes
    its text). ``pieces`` names an equal pattern without short matches, where there is one."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    pieces: str | None = None

    @property
    def searched(self) -> str:
        return self.pieces or self.pattern


# fixed values: the base patterns, in the order in which equal starts are listed
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
]
#: further kinds, told by fixed prefixes
MORE = [
    # one character class: Java would recurse once per repetition of a group
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # only where a run begins, else a long run would be scanned once per start inside it
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
]
RULES = [*BASE, *MORE]


def strings_of(node) -> list[str] | None:
    """All strings of a piece of a parsed regex in lower case, None if too many."""
    op, value = node
    if op is ops.LITERAL:
        return [chr(value).lower()]
    if op is ops.SUBPATTERN:
        return joined(value[3])
    if op is ops.BRANCH:
        found = [joined(branch) for branch in value[1]]
        flat = None if None in found else sorted({s for f in found for s in f})
        return flat if flat and len(flat) <= MOST_STRINGS else None
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] <= 2:
        once = joined(value[2])
        if once is not None:
            out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(once, repeat=n)}
            return sorted(out) if len(out) <= MOST_STRINGS else None
    if op is ops.IN and all(o is ops.LITERAL for o, _ in value):
        return sorted({chr(v).lower() for _, v in value})
    return None


def joined(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        found = strings_of(node)
        if found is None or len(found) * len(out) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in found]
    return out


def runs_of(nodes) -> list[list[str]]:
    """Maximal runs of a sequence that expand to few strings; any match holds one string
    of each run."""
    runs, now = [], [""]
    for node in nodes:
        op, value = node
        found = strings_of(node)
        if found is not None and len(found) * len(now) <= MOST_STRINGS:
            now = [a + b for a in now for b in found]
            continue
        runs.append(now)
        now = [""] if found is None else found
        if found is None:
            # what must occur at least once inside is mandatory too
            inside = value[3] if op is ops.SUBPATTERN else value[2] if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] else None
            runs += runs_of(inside) if inside is not None else []
    return [*runs, now]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of trigrams that every match of ``pattern`` satisfies; None: no trigram
    is mandatory. Of several mandatory runs each is an OR; they are multiplied out while
    few, and the run with the longest shortest string decides otherwise."""
    usable = [r for r in runs_of(parser.parse(pattern)) if min(map(len, r)) >= 3]
    if not usable:
        return None
    usable.sort(key=lambda r: -min(map(len, r)))
    clauses = [frozenset()]
    for run in usable:
        each = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if len(each) * len(clauses) > MOST_STRINGS:
            break
        clauses = [a | b for a in clauses for b in each]
    # a clause that asks for more than another one adds nothing
    return sorted({c for c in clauses if not any(d < c for d in clauses)}, key=sorted)


def queries_of(rules: list[Rule]) -> dict[str, list[frozenset[str]]]:
    """By kind; kinds without mandatory trigrams are absent."""
    found = {r.kind: trigram_query(r.searched) for r in rules}
    return {kind: clauses for kind, clauses in found.items() if clauses}


def postings(df: DataFrame, id: str, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index for the given trigrams: ``trigram`` (its number), ``_posted``."""
    lower = F.lower(F.col(text))
    held = F.filter(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]), F.isnotnull)
    present = df.select(F.col(id).alias("_posted"), lower.alias("_low")).select("_posted", held.alias("_held"))
    # outer: else the optimizer would repeat the whole search as a filter below the explode
    return present.select("_posted", F.explode_outer("_held").alias("trigram")).where(F.col("trigram").isNotNull())


def candidates(index: DataFrame, rules: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """``_posted`` and the kinds (``_kinds``) with a clause whose postings all hold it. A
    repeated id may be counted more than once: one candidate too many, never one too few."""
    asked = [
        F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("clause"), F.lit(trigrams.index(t)).alias("trigram"), F.lit(len(clause)).alias("needed"))
        for kind, clauses in rules.items()
        for n, clause in enumerate(clauses)
        for t in sorted(clause)
    ]
    # the rules' own table: its size is theirs, not the data's
    asked = index.sparkSession.range(1).select(F.inline(F.array(*asked)))
    hits = index.join(F.broadcast(asked), "trigram").groupBy("_posted", "kind", "clause")
    full = hits.agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where(F.col("n") >= F.col("needed"))
    return full.groupBy("_posted").agg(F.collect_set("kind").alias("_kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans (kind, order, start, end) of a rule's matches: the gaps between the matches
    and the matches themselves give the places, in code points."""
    whole, part = (F.regexp_extract_all(text, F.lit(rule.searched), F.lit(g)) for g in (0, rule.group))
    gaps = F.split(text, rule.searched, -1)
    lengths = F.arrays_zip(
        F.slice(F.transform(gaps, F.length), 1, F.size(whole)).alias("gap"),
        F.transform(whole, F.length).alias("full"), F.transform(part, F.length).alias("part"),
    )
    number = [r.kind for r in RULES].index(rule.kind) if rule in RULES else len(RULES)
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["full"]
        span = F.struct(start.alias("start"), F.lit(number).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            end.alias("at"),
            F.when(x["part"] >= rule.at_least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(lengths, none, step, lambda s: s["found"])


SPANS = "array<struct<start:int,`order`:int,`end`:int,kind:string>>"


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Add ``spans``: the rules' matches by start, then rule order, as structs of start,
    order, end (exclusive) and kind, in code points; a column of this name is replaced.

    A null or empty text has none. Repeated ids are served by the same candidates, each
    row is verified on its own text; null ids are ids like others. Equal rows stay.
    """
    kept = without(df, "spans")
    # the row travels in one struct, so that its columns clash with none of the names below
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row")
    kept, whole = kept.select(row), blank_null(F.col("_row")[text])
    indexed = queries_of(rules)
    trigrams = sorted({t for clauses in indexed.values() for c in clauses for t in c})
    # rules without a mandatory trigram are run here, over every text
    free = [r for r in rules if r.kind not in indexed]
    everywhere = [F.when(F.rlike(whole, F.lit(r.searched)), spans_of(whole, r)) for r in free]
    none = F.array().cast(SPANS)
    tested = kept.withColumn("_free", F.concat(none, *[F.coalesce(e, none) for e in everywhere]))
    if not indexed:
        return tested.select("_row.*", F.array_sort("_free").alias("spans"))
    narrow = kept.select(F.col("_row")[id].alias("_id"), whole.alias("_text"))
    found = candidates(postings(narrow, "_id", "_text", trigrams), indexed, trigrams)
    joined = tested.join(found, F.col("_row")[id].eqNullSafe(F.col("_posted")), "left")
    verified = [
        F.when(F.array_contains("_kinds", r.kind), spans_of(whole, r)) for r in rules if r.kind in indexed
    ]
    every = F.concat(F.col("_free"), *[F.coalesce(v, none) for v in verified])
    return joined.select("_row.*", F.array_sort(every).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def redacted(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each found span by ``[kind]`` and drop ``spans``; of overlapping spans the
    first and everything up to the end of the last becomes one mark. A text without spans
    is left alone."""
    cut = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), state["at"] + 1, s["start"] - state["at"])
        fresh = F.concat(state["parts"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], fresh).otherwise(state["parts"]).alias("parts"),
        )

    clean = F.aggregate(
        F.col(spans), cut, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(F.col(text), s["at"] + 1, F.length(text)))
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).drop(spans)


def python_spans(text: str | None, rules: list[Rule] = RULES) -> list[tuple[int, int, str]]:
    """The same by brute force, for tests: (start, end, kind)."""
    out = []
    for order, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.at_least:
                out.append((m.start(), order, m.end(), r.kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]
