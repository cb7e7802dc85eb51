"""Jaccard join of n-gram sets by prefix trees, and the components of its links.

1. Each text becomes a set of hashed n-grams; equal sets are one class from there on.
2. N-grams of the lower quarter of the hash space tell, exactly, which classes can have a
   partner at all: of a set with a partner at most ``n - ceil(t n)`` n-grams are held by no
   other class. The rest leaves before anything else is shuffled.
3. The others' n-grams get a global order, rare first. Two linked sets share an n-gram
   within their first ``n - ceil(t n) + 1`` (n-grams held once come first and match
   nothing). All classes with a common such n-gram meet in the block of its leader, the
   smallest class among them; a class comes into a block once, not once per n-gram.
4. A block stores its ordered sets in a trie. A set's walk shares the overlap counted on a
   common path, leaves a subtree when what remains of the set, or of the longest set below,
   cannot reach the threshold, and passes over a subtree whose sets are all in the walking
   set's component already. So a block of near copies costs one walk, not all pairs.
5. A block over ``CHUNK`` n-grams is split, with its leader in each part. Sets that did not
   join the leader's component then meet every other part in a second pass.

Both sides of all these joins grow with the data: by hint they are merge joins at every
size, never broadcasts, and adaptive execution splits their hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import stored
from transitlake.llm.components import components

#: n-grams that one trie may hold
CHUNK = 2_000_000
#: the part of the hash space that is looked at first: the lowest quarter
SAMPLED = -(1 << 63) + (1 << 62)
MULTIPLIER = 0x9E3779B97F4A7C15


def ngrams(raw: bytes, n: int) -> np.ndarray:
    """The sorted set of hashed word n-grams; the whole sequence if it is shorter."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    found = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):  # wraps: arithmetic modulo 2^64
        found = found * np.uint64(MULTIPLIER) + hashed[i : i + len(found)]
    found ^= found >> np.uint64(29)
    return np.unique((found * np.uint64(MULTIPLIER)).view(np.int64))


def hashed_sets(df: DataFrame, id: str, text: str, n: int, whole: bool) -> DataFrame:
    """``_id, _content`` (hash of the text), ``_n, _class`` (hash of the set, null if empty) and
    ``_grams``: the sampled part of the set or the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams(t or b"", n) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            classes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
            shown = sets if whole else [s[: np.searchsorted(s, SAMPLED)] for s in sets]
            ends = np.cumsum([0, *map(len, shown)])
            flat = np.concatenate([np.zeros(0, np.int64), *shown])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), sizes, pa.array(classes, pa.int64()), grams],
                names=["_id", "_content", "_n", "_class", "_grams"],
            )

    narrow = df.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_content"))
    return narrow.mapInArrow(run, "_id long, _content long, _n long, _class long, _grams array<long>")


def least_shared(n: Column, percent: int) -> Column:
    """n-grams that a set of ``n`` must share with any partner."""
    return F.ceil(n * percent / 100)


class Trie:
    """Sorted integer sets in a path-compressed trie: a node is a run of sets (in
    lexicographic order) with a common beginning."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets, self.sizes, self.order = sets, sizes, order
        common = [0]
        for a, b in zip(order, order[1:]):
            x, y = sets[a], sets[b]
            k = min(len(x), len(y))
            differ = np.flatnonzero(x[:k] != y[:k])
            common.append(int(differ[0]) if len(differ) else k)
        common = np.array(common)
        lengths, total = np.array([len(sets[i]) for i in order]), np.array([sizes[i] for i in order])
        self.segment: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.member: list[int] = []  # of a leaf its set, else -1
        self.longest: list[int] = []
        self.smallest: list[int] = []
        self.some: list[int] = []
        todo = [(0, len(order), 0, -1)]
        while todo:
            low, high, depth, parent = todo.pop()
            node = len(self.segment)
            first = sets[order[low]]
            end = len(first) if high - low == 1 else int(common[low + 1 : high].min())
            self.segment.append(first[depth:end])
            self.children.append([])
            self.member.append(order[low] if high - low == 1 else -1)
            self.longest.append(int(lengths[low:high].max()) - end)
            self.smallest.append(int(total[low:high].min()))
            self.some.append(order[low])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(common[low + 1 : high] == end)).tolist(), high]
                todo += [(a, b, end, node) for a, b in zip(cuts, cuts[1:])]
        self.uniform = [m >= 0 for m in self.member]


def linked(sets: list[np.ndarray], sizes: list[int], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (positions) that join all sets that the threshold links, one for each merging of
    two components; sets of one label are one component from the start."""
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    sets = np.split(local.astype(np.uint32), cuts)
    top = list(range(len(sets)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    seen: dict[int, int] = {}
    for i, label in enumerate(labels):
        top[i] = seen.setdefault(label, i)
    trie, found = Trie(sets, sizes), []
    mark = np.zeros(len(tokens), bool)
    for x in range(len(sets)):
        mark[sets[x]] = True
        n, own = sizes[x], len(sets[x])
        todo = [(0, 0)]
        visited = []
        while todo:
            node, shared = todo.pop()
            if trie.uniform[node] and find(trie.some[node]) == find(x):
                continue
            segment = trie.segment[node]
            if len(segment):
                shared += int(np.count_nonzero(mark[segment]))
                beyond = own - int(np.searchsorted(sets[x], segment[-1], "right"))
            else:
                beyond = own - shared
            most = shared + min(trie.longest[node], beyond)
            if (100 + percent) * most < percent * (n + trie.smallest[node]):
                continue
            y = trie.member[node]
            if y < 0:
                visited.append(node)
                todo += [(child, shared) for child in trie.children[node]]
            elif y != x and 100 * shared >= percent * (n + sizes[y] - shared):
                a, b = find(x), find(y)
                if a != b:
                    top[max(a, b)] = min(a, b)
                    found.append((x, y))
        for node in reversed(visited):  # children come after their parent
            if not trie.uniform[node]:
                below = trie.children[node]
                trie.uniform[node] = all(trie.uniform[c] for c in below) and len({find(trie.some[c]) for c in below}) == 1
        mark[sets[x]] = False
    return found


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """``blocks``: ``_block, _part, _class, _n, _label, _ordered``. Links ``a, b`` between
    classes of the same block and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(rows) > 1:
                links = linked([r[2] for r in rows], [r[1] for r in rows], [r[3] for r in rows], percent)
                out.extend((rows[i][0], rows[j][0]) for i, j in links)
            rows.clear()

        for batch in batches:
            b = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            flat, ends = b["_ordered"].flatten().to_numpy(), np.cumsum([0, *pa.compute.list_value_length(b["_ordered"]).to_pylist()])
            fields = zip(*(b[n].to_pylist() for n in ("_block", "_part", "_class", "_n", "_label")))
            for i, (block, part, own, n, label) in enumerate(fields):
                if (block, part) != key:
                    close()
                    key = (block, part)
                rows.append((own, n, flat[ends[i] : ends[i + 1]].copy(), label))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    together = blocks.repartition("_block", "_part").sortWithinPartitions("_block", "_part")
    return together.mapInArrow(run, "a long, b long")


def links_between(sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """``sets``: ``_class, _n, _grams``. ``vertex, root`` of all classes that have a link to
    another one. A class has one row; more of them, from repeated rows, only raise frequencies
    in the global order, which may be any."""
    grams = sets.select("_class", F.explode("_grams").alias("_gram"))
    held = grams.groupBy("_gram").agg(F.count("*").alias("_df")).where(F.col("_df") > 1)
    held = held.withColumnRenamed("_gram", "_g")
    # one number orders n-grams by the magnitude of their frequency, then by hash
    rank = F.shiftleft(F.floor(F.log2("_df")).cast("long"), 56).bitwiseOR(F.col("_gram").bitwiseAND(F.lit((1 << 56) - 1)))
    ranked = grams.join(held.hint("merge"), F.col("_gram") == F.col("_g")).select("_class", rank.alias("_rank"))
    ordered = ranked.groupBy("_class").agg(F.array_sort(F.collect_set("_rank")).alias("_ordered"))
    sized = sets.select(F.col("_class").alias("_c"), "_n").distinct()
    ordered = ordered.join(sized.hint("merge"), F.col("_class") == F.col("_c")).drop("_c")
    alone = F.col("_n") - F.size("_ordered")
    first = F.col("_n") - least_shared(F.col("_n"), percent) + 1 - alone
    ordered = stored(ordered.withColumn("_first", first.cast("int")).where(F.col("_first") > 0))
    prefix = ordered.select("_class", F.explode(F.slice("_ordered", 1, F.col("_first"))).alias("_rank"))
    leaders = prefix.groupBy("_rank").agg(F.min("_class").alias("_block"), F.count("*").alias("_k")).where(F.col("_k") > 1)
    leaders = leaders.select(F.col("_rank").alias("_r"), "_block")
    met = prefix.join(leaders.hint("merge"), F.col("_rank") == F.col("_r")).select("_block", "_class").distinct()
    weights = ordered.select(F.col("_class").alias("_c"), F.size("_ordered").alias("_w"))
    met = stored(met.join(weights.hint("merge"), F.col("_class") == F.col("_c")).drop("_c"))
    parts = met.groupBy(F.col("_block").alias("_b")).agg(F.ceil(F.sum("_w") / chunk).cast("int").alias("_parts"))
    split = met.join(parts.hint("merge"), F.col("_block") == F.col("_b")).drop("_b")
    mine = F.pmod(F.xxhash64("_class"), F.col("_parts")).cast("int")
    leads = F.col("_class") == F.col("_block")
    split = stored(split.withColumn("_mine", mine))
    every = F.when(leads, F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array("_mine"))
    spread = split.select("_block", "_class", F.explode(every).alias("_part")).withColumn("_label", F.col("_class"))
    full = ordered.select(F.col("_class").alias("_c"), "_n", "_ordered")
    with_sets = lambda rows: rows.join(full.hint("merge"), F.col("_class") == F.col("_c")).drop("_c")
    links = stored(block_links(with_sets(spread), percent))
    large = split.where(F.col("_parts") > 1)
    if large.isEmpty():
        return components(links)

    # what is not with the leader of a large block meets all of the block, part by part
    roots = components(links)
    label = F.coalesce("root", F.col("_class"))
    labelled = large.join(roots, F.col("_class") == F.col("vertex"), "left").select("_block", "_class", "_mine", "_parts", "_w", label.alias("_label"))
    of_leader = labelled.where(leads).select(F.col("_block").alias("_b"), F.col("_label").alias("_lead"))
    labelled = stored(labelled.join(of_leader, F.col("_block") == F.col("_b")).drop("_b"))
    apart = labelled.where(F.col("_label") != F.col("_lead"))
    shares = apart.groupBy(F.col("_block").alias("_b")).agg(F.ceil(F.sum("_w") / chunk).cast("int").alias("_shares"))
    shared = labelled.join(shares, F.col("_block") == F.col("_b")).drop("_b")
    share = F.pmod(F.xxhash64(F.lit(1), "_class"), F.col("_shares")).cast("int")
    pairs = lambda a, b: (a * F.col("_parts") + b).alias("_part")
    whole = shared.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    whole = whole.select("_block", "_class", pairs(F.col("_s"), F.col("_mine")), "_label")
    single = shared.where(F.col("_label") != F.col("_lead")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    single = single.select("_block", "_class", pairs(share, F.col("_p")), "_label")
    more = stored(block_links(with_sets(whole.unionByName(single).distinct()), percent))
    return components(links.unionByName(more))


def rooted_rows(df: DataFrame, id: str, text: str, n: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``_id, _content, _n, _class`` and ``_root``, the component's mark
    (null for an empty set or a null id)."""
    hashed = stored(hashed_sets(df, id, text, n, whole=False))
    known = hashed.where(F.col("_class").isNotNull() & F.col("_id").isNotNull())
    sampled = known.select("_class", F.explode("_grams").alias("_gram"))
    owners = sampled.groupBy("_gram").agg(F.min("_class").alias("_class"), F.max("_class").alias("_last"))
    alone = owners.where(F.col("_class") == F.col("_last")).groupBy(F.col("_class").alias("_c")).agg(F.count("*").alias("_alone"))
    # a class is read from one document: the smallest id, then the smallest content hash
    first = F.min(F.struct("_id", "_content")).alias("_first")
    classes = known.groupBy("_class").agg(first, F.min("_n").alias("_n"))
    spare = F.col("_n") - least_shared(F.col("_n"), percent)
    # a set needs room for a partner that differs: one n-gram less, or one more
    room = (F.col("_n") * 100 >= percent * (F.col("_n") + 1)) | (spare >= 1)
    able = classes.where(room).join(alone.hint("merge"), F.col("_class") == F.col("_c"), "left")
    able = able.where(F.coalesce("_alone", F.lit(0)) <= spare)
    able = stored(able.select(F.col("_first._id").alias("_rep"), F.col("_first._content").alias("_own")))
    texts = df.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    read = (F.col("_id") == F.col("_rep")) & (F.xxhash64("_text") == F.col("_own"))
    texts = texts.join(able.hint("merge"), read, "left_semi")
    sets = stored(hashed_sets(texts, "_id", "_text", n, whole=True).select("_class", "_n", "_grams"))
    roots = links_between(sets, percent, chunk)
    rooted = hashed.drop("_grams").join(roots.hint("merge"), F.col("_class") == F.col("vertex"), "left")
    mark = F.when(F.col("_id").isNotNull(), F.coalesce("root", "_class"))
    return rooted.select("_id", "_content", "_n", "_class", mark.alias("_root"))


def join_components(
    df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, chunk: int = CHUNK
) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles`` and ``component_id``, the smallest id that
    links of Jaccard similarity ``percent / 100`` or more reach.

    Words are runs without the six ASCII blanks, A-Z lower-cased. A text of fewer than ``n``
    words is one n-gram; an empty or null text has none, links with nothing and is its own
    component. Rows of equal sets are linked, repeated ids included; a row without an id
    takes no part in links and has no component. Of the input only ``id`` and ``text`` are read.
    """
    rooted = rooted_rows(df, id, text, n, percent, chunk)
    member = F.col("_root").isNotNull()
    least = rooted.where(member).groupBy(F.col("_root").alias("_r")).agg(F.min("_id").alias("_least"))
    # rows without a class need no partner and no place in the join
    joined = rooted.where(member).join(least.hint("merge"), F.col("_root") == F.col("_r"))
    bare = rooted.where(~member).withColumn("_least", F.when(F.col("_class").isNull(), F.col("_id")))
    columns = [F.col("_id").alias(id), F.col("_n").alias("n_shingles"), F.col("_least").alias("component_id")]
    return joined.select(*columns).unionByName(bare.select(*columns))


def one_of_each(
    df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, chunk: int = CHUNK
) -> DataFrame:
    """The rows of ``df``, one for each component: that of the smallest id (then smallest
    content hash). Rows with an empty set stand alone, so of equal ones with one id one
    stays; rows without an id all stay."""
    rooted = rooted_rows(df, id, text, n, percent, chunk).where(F.col("_id").isNotNull())
    grouped = rooted.where(F.col("_root").isNotNull()).groupBy("_root")
    best = grouped.agg(F.min(F.struct("_id", "_content")).alias("_best")).select("_best.*")
    empty = rooted.where(F.col("_root").isNull()).select("_id", "_content").distinct()
    best = best.unionByName(empty)
    marked = df.withColumn("_own", F.xxhash64(text))
    same = (F.col(f"`{id}`").cast("long") == F.col("_id")) & (F.col("_own") == F.col("_content"))
    kept = marked.where(F.col(f"`{id}`").isNotNull()).join(best.hint("merge"), same).dropDuplicates(["_id", "_content"])
    return kept.select(*df.columns).unionByName(df.where(F.col(f"`{id}`").isNull()))
