"""Approximate nearest neighbours by inner product over an inverted multi-index.

Each vector is cut into halves, and each half quantised by a codebook of its own; a cell
is a pair of centroids. A query sorts both codebooks by inner product and walks centroid
pairs in the order of their sums with a heap, until the cells met hold enough vectors.
These candidates are reranked with the original vectors in double precision. How many are
enough is measured: for a fixed number of sample queries the true neighbours are found by
brute force, and the walk must be as long as brings in the wanted share of them. Clustered
vectors need few candidates, vectors without structure a good part of the table.

Equal vectors are indexed once, with their smallest ids (a group of copies can give no
query more than that many neighbours), so a hot vector is one entry. Cells are dealt into
buckets of bounded size; a cell of more is split over several buckets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm.common import stored

#: vectors that the codebooks are fitted on, at most
SAMPLE = 20_000
#: centroids of a half, at most, and vectors that a cell would hold were all alike
CENTROIDS, PER_CELL = 256, 50
#: queries whose true neighbours are found by brute force to set the number of candidates
PROBES = 64
#: share of true neighbours that the candidates shall hold
RECALL = 0.96
#: vectors in a bucket of cells, and queries that meet it in one task
BUCKET, QUERIES = 4096, 4096


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def codebook(points: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct points of the sample."""
    distinct = np.unique(points, axis=0)
    start = np.random.default_rng(seed).permutation(len(distinct))[:size]
    centres = distinct[start]
    for _ in range(rounds):
        nearest = assigned(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


def assigned(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def fit(vectors: DataFrame, count: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves from the ``SAMPLE`` vectors of the smallest hashes: a bounded
    sample that does not depend on where rows lie."""
    drawn = vectors.orderBy(F.xxhash64(F.lit(seed), "_vector"), "_vector").limit(SAMPLE).select("_vector").collect()
    points = np.array([r[0] for r in drawn], dtype=float)
    if not len(points):
        return np.zeros((1, 1)), np.zeros((1, 1))
    half = max(1, points.shape[1] // 2)
    size = 1 << min(CENTROIDS.bit_length() - 1, int(np.log2(max(1.0, (count / PER_CELL) ** 0.5))))
    return codebook(points[:, :half], size, seed), codebook(points[:, half:], size, seed + 1)


def cells_in_order(left: np.ndarray, right: np.ndarray, held: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells by falling sum of the halves' inner products, until they hold
    ``enough`` vectors; ``held``: vectors by cell."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    l, r = left[a], right[b]
    heap, seen, out, total = [(-(l[0] + r[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and total < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if held[cell]:
            out.append(cell)
            total += int(held[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(l) and y < len(r) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(l[x] + r[y]), x, y))
    return out


def enough_candidates(
    index: DataFrame, first: np.ndarray, second: np.ndarray, held: np.ndarray, k: int, recall: float
) -> int:
    """The length of walk that meets ``recall`` of the true neighbours of ``PROBES`` vectors of
    the index. Each task keeps its ``k`` best for each of them; ``PROBES * k`` rows are collected."""
    asked = index.orderBy(F.xxhash64(F.lit(64), "_vector"), "_vector").limit(PROBES).select("_vector").collect()
    if not asked:
        return 0
    q = np.array([r[0] for r in asked], dtype=float)
    half = first.shape[1]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            v, cells = np.array(rows["_vector"].tolist(), dtype=float), rows["_cell"].to_numpy()
            scores = q @ v.T
            scores[(q[:, None, :] == v[None, :, :]).all(axis=2)] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            n = best.shape[1]
            yield pd.DataFrame({
                "_q": np.repeat(np.arange(len(q)), n), "_score": np.take_along_axis(scores, best, 1).ravel(), "_cell": cells[best].ravel(),
            })

    near = index.select("_vector", "_cell").mapInPandas(nearest, "_q int, _score double, _cell long")
    nth = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_score"), "_cell"))
    true = near.where(F.col("_score") > float("-inf")).withColumn("_n", nth).where(F.col("_n") <= k).collect()
    order = [cells_in_order(first @ x[:half], second @ x[half:], held, int(held.sum()) + 1) for x in q]
    reached = [dict(zip(cells, np.cumsum(held[cells]).tolist())) for cells in order]
    costs = sorted(reached[r["_q"]][r["_cell"]] for r in true)
    return costs[min(len(costs) - 1, int(recall * len(costs)))] if costs else 0


def search(
    df: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that satisfies ``queries`` its ``k``
    nearest other rows found, by inner product, ties to the smaller id.

    Rows with a null id, or a vector that is null, empty, zero, of null or non-finite
    components, or of another length than the table's first by hash, take no part. Repeated
    ids count as one row's. With fewer than ``k`` others all are returned.
    """
    spark = df.sparkSession
    given = df.select(F.col(id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"), queries.alias("_asks"))
    given = given.where(F.col("_id").isNotNull() & usable(F.col("_vector")))
    dimension = given.select(F.max_by(F.size("_vector"), F.xxhash64("_vector"))).first()[0] or 2
    given = given.where(F.size("_vector") == dimension)
    # the smallest ids of each distinct vector: k besides the query's own
    nth = F.row_number().over(Window.partitionBy("_vector").orderBy("_id"))
    distinct = given.select("_id", "_vector").distinct().withColumn("_n", nth).where(F.col("_n") <= k + 1)
    distinct = stored(distinct.groupBy("_vector").agg(F.array_sort(F.collect_list("_id")).alias("_ids")))
    first, second = fit(distinct, distinct.count())
    half, width = first.shape[1], len(second)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                points = np.array(rows["_vector"].tolist(), dtype=float)
                rows["_cell"] = assigned(points[:, :half], first) * width + assigned(points[:, half:], second)
                yield rows

    index = stored(distinct.mapInPandas(assign, "_vector array<double>, _ids array<long>, _cell long"))
    held = np.zeros(len(first) * width, dtype=np.int64)
    for r in index.groupBy("_cell").count().collect():  # one row a cell, as many as pairs of centroids
        held[r["_cell"]] = r["count"]
    candidates = enough_candidates(index, first, second, held, k, recall)
    # cells in order fill the buckets; a large cell has several of its own
    ends = np.cumsum(held)
    low, high = (ends - held) // BUCKET, np.maximum(ends - 1, 0) // BUCKET

    spots = spark.range(1).select(F.lit(low.tolist()).alias("_lows"), F.lit(high.tolist()).alias("_highs"))
    lows, highs = spots.select("_lows").scalar(), spots.select("_highs").scalar()
    at = lambda array: F.get(array, F.col("_cell").cast("int"))
    spread = at(lows) + F.pmod(F.xxhash64("_vector"), at(highs) - at(lows) + 1)
    bucketed = index.withColumn("_bucket", spread.cast("long"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for own, vec in zip(rows["_id"], rows["_vector"]):
                q = np.asarray(vec, dtype=float)
                cells = cells_in_order(first @ q[:half], second @ q[half:], held, candidates + k)
                by: dict[int, list[int]] = {}
                for cell in cells:
                    for bucket in range(int(low[cell]), int(high[cell]) + 1):
                        by.setdefault(bucket, []).append(cell)
                out += [(own, q, bucket, found) for bucket, found in by.items()]
            if out:
                yield pd.DataFrame(out, columns=["_id", "_vector", "_bucket", "_cells"])

    asked = given.where(F.coalesce("_asks", F.lit(False))).select("_id", "_vector").distinct()
    probes = asked.mapInPandas(probe, "_id long, _vector array<double>, _bucket long, _cells array<int>")
    probes = stored(probes)
    busiest = probes.groupBy("_bucket").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-busiest // QUERIES)
    probes = probes.withColumn("_block", F.pmod(F.xxhash64("_id", "_vector"), F.lit(blocks)))
    # only the buckets that some query visits, once for each block of their queries
    met = probes.select(F.col("_bucket").alias("_b"), F.col("_block").alias("_q")).distinct()
    entries = bucketed.join(met, F.col("_bucket") == F.col("_b")).select("_vector", "_ids", "_cell", "_bucket", "_q")

    def rank(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": pd.array([], "int64"), "vec_id": pd.array([], "int64"), "score": pd.array([], "float64")})
        if not len(asked) or not len(there):
            return out
        q, v = np.array(asked["_vector"].tolist(), dtype=float), np.array(there["_vector"].tolist(), dtype=float)
        cells, ids = there["_cell"].to_numpy(), there["_ids"].tolist()
        places = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)}
        found = []
        for i, (own, wanted) in enumerate(zip(asked["_id"], asked["_cells"])):
            spots = [places[int(c)] for c in wanted if int(c) in places]
            if not spots:
                continue
            near = np.concatenate(spots)
            rough = v[near] @ q[i]
            if len(near) > k + 1:  # at most one entry holds nothing but the query itself
                least = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                near = near[rough >= least - 1e-9 * max(1.0, abs(least))]
            exact = (v[near] * q[i]).sum(axis=1)
            best = sorted((-s, int(n)) for j, s in zip(near, exact) for n in ids[j] if n != own)[:k]
            found += [(own, n, -s) for s, n in best]
        return pd.DataFrame(found, columns=out.columns).astype(out.dtypes.to_dict()) if found else out

    ranked = (
        probes.groupBy("_bucket", "_block")
        .cogroup(entries.groupBy("_bucket", "_q"))
        .applyInPandas(rank, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
