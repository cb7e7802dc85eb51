"""Shards over fixed virtual slots.

Records are hashed into a few thousand slots whose number never changes. A versioned map
says which shard holds a slot; bytes are summed per slot, and rebalancing edits the map by
moving as few slots as bring the shards' bytes near each other. The map and the loads have
one row per slot, a bound that does not depend on the data, so the driver may edit them and
Spark may broadcast them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.llm.common import stored, without

SLOTS = 4096


def with_slots(df: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot``: null keys hash like any value."""
    return without(df, "virtual_slot").withColumn(
        "virtual_slot", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(slots)).cast("int")
    )


def slot_loads(slotted: DataFrame, size: str) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: at most one row per slot reaches the driver."""
    loads = slotted.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    return {r["virtual_slot"]: (r["bytes"] or 0, r["rows"]) for r in loads.collect()}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1: slots dealt round."""
    return {slot: slot % shards for slot in range(slots)}


def rebalanced(held: dict[int, int], bytes_of: dict[int, int], shards: int) -> dict[int, int]:
    """The next version: between the fullest and an emptier shard, or a fuller and the
    emptiest one, a slot moves or two slots are swapped, whichever brings the two shards
    nearest each other, until no edit narrows a gap or there were four edits a slot."""
    edited = dict(held)
    lists: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    full = [0] * shards
    for slot, shard in edited.items():
        if load := bytes_of.get(slot, 0):
            insort(lists[shard], (load, slot))
            full[shard] += load
    for _ in range(4 * len(edited)):
        order = sorted(range(shards), key=full.__getitem__)
        pairs = [(order[-1], other) for other in order[:-1]] + [(other, order[0]) for other in order[-2:0:-1]]
        for rich, poor in pairs:
            edit = best_edit(lists[rich], lists[poor], full[rich] - full[poor])
            if edit is not None:
                break
        else:
            return edited
        for (load, slot), source, to in zip(edit, (rich, poor), (poor, rich)):
            lists[source].remove((load, slot))
            insort(lists[to], (load, slot))
            full[source] -= load
            full[to] += load
            edited[slot] = to
    return edited


def best_edit(rich: list[tuple[int, int]], poor: list[tuple[int, int]], gap: int) -> list[tuple[int, int]] | None:
    """The slot to move, or the two slots to swap, so that the gap shrinks most; None if none
    does. Both lists are sorted by load."""
    if gap < 2:
        return None
    best, edit = gap, None
    # a slot of at most half the gap narrows it most when it is the largest such
    at = bisect_right(rich, (gap // 2, 1 << 62)) - 1
    if at >= 0:
        best, edit = gap - 2 * rich[at][0], [rich[at]]
    for given in rich:
        near = bisect_left(poor, (given[0] - gap // 2, -1))
        for back in poor[max(near - 1, 0) : near + 1]:
            left = abs(gap - 2 * (given[0] - back[0]))
            if left < best:
                best, edit = left, [given, back]
        if best < 2:
            break
    return edit


def map_table(spark: SparkSession, versions: list[dict[int, int]], loads: dict[int, tuple[int, int]]) -> DataFrame:
    """The stored map: ``map_version, virtual_slot, shard, bytes, rows, before`` (rows of
    the shard's smaller slots), all versions."""
    rows = []
    for version, held in enumerate(versions, 1):
        before: dict[int, int] = {}
        for slot in sorted(held):
            shard, (size, n) = held[slot], loads.get(slot, (0, 0))
            rows.append((version, slot, shard, size, n, before.get(shard, 0)))
            before[shard] = before.get(shard, 0) + n
    schema = "map_version int, virtual_slot int, shard int, bytes long, rows long, before long"
    return stored(spark.createDataFrame(rows, schema))


def place(df: DataFrame, keys: list[str], size: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot``, ``shard``, ``map_version`` and ``place`` (a record's number in
    its shard, gapless from 0); columns of these names are replaced.

    Every row is placed; rows equal in ``keys`` share a slot and so a shard, also as ``shards``
    changes; equal texts do if the keys are made of the text. Sizes count bytes; null sizes count
    nothing. An empty table gives an empty result. Numbers are dealt inside a slot, so the
    largest window holds one slot's rows.
    """
    kept = without(df, "virtual_slot", "shard", "map_version", "place")
    # the row travels in one struct, so that its columns clash with none of the names below
    row = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row")
    slotted = with_slots(kept, keys, slots).select(row, "virtual_slot")
    loads = slot_loads(slotted.select("virtual_slot", F.col("_row")[size].alias("_size")), "_size")
    first = first_map(shards, slots)
    second = rebalanced(first, {s: b for s, (b, _) in loads.items()}, shards)
    held = map_table(df.sparkSession, [first, second], loads)
    latest = held.where(F.col("map_version") == 2).select("map_version", "virtual_slot", "shard", "before")
    order = Window.partitionBy("virtual_slot").orderBy(*[F.col("_row")[k] for k in keys])
    return (
        slotted.withColumn("place", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(latest), "virtual_slot")
        .select("virtual_slot", "_row.*", (F.col("place") + F.col("before")).alias("place"), "map_version", "shard")
    )
