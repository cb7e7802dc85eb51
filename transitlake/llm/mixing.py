"""Mixing sources to target weights by pivotal rounding.

Every document of a source is expected ``target / source size`` times. The whole part is
taken; the fractions are rounded dependently: a fractional unit duels with others, expected
words pass between them in a direction that its coin decides, until it is 0 or 1. A duel
keeps the sum of words, so a source's words are exact up to what is left over, and as the
largest documents duel first, that is small.

The duels form a tree: blocks of some ``BLOCK`` units are rounded in parallel and leave a
few fractional units each; these residuals are the next level's units. No block grows with
the data. Random numbers are hashes of the two units' keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitlake.llm.common import stored, uniform, without

WEIGHTS = [5, 2, 1]
#: units rounded in one go, on average, and those that such a block leaves, about: one in
#: ``RESERVE`` waits, so that later blocks hold units of all sizes too
BLOCK, LEFT, RESERVE = 64, 12, 6
NEAR = 1e-9


def source_targets(sized: DataFrame, source: str, size: str, weights: list[int] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """One row per source: ``_source, source_size, target, _rows``.

    Sources in code point order, null last, take the weights in turn and share the sum of
    all sizes; a target ends at ``cap`` times its source's size and the excess goes to the
    others by weight. That fixed point is ``min(cap, level * weight)``: with sources in the
    order of cap / weight, the level follows from running sums. The windows see one row a
    source.
    """
    totals = sized.groupBy(F.col(source).alias("_source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("source_size"), F.count("*").alias("_rows")
    )
    totals = stored(totals)
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    place = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weighted = totals.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place))
    weighted = weighted.withColumn("_cap", cap * F.col("source_size").cast("double"))
    filled = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    upto = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(everything).cast("double")
    left_mass = whole - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))
    left_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(upto), F.lit(0.0))
    # the level if just the sources before this one are full: right at the first that is not
    # full at it, and from there on no level is higher
    leveled = weighted.withColumn("_level", left_mass / left_weight)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    leveled = leveled.withColumn("_filled", F.max(fits).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_filled"), F.lit(float("inf"))) * F.col("_weight"))
    return stored(leveled.select("_source", "source_size", target.alias("target"), "_rows"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def duels(units: Column, level: int, seed: int) -> Column:
    """Round an array of ``struct(size, key, p)``, largest sizes first: the same array with
    new ``p``, nearly all of them 0 or 1.

    In turn each unit throws its coin and duels with the smaller ones: if it rises it takes
    the words it lacks from them, if it falls it hands them the words it has, to each
    opponent the same share of either, and no more than leaves the opponent's ``p`` between 0
    and 1 both ways. So no unit's expectation changes and the sum of words stays; a unit
    whose opponents cannot carry all of it stays fractional. Units without words have no
    opponents: their coin decides.
    """

    def duel(state: Column, k: Column) -> Column:
        """``state``: chances of the units before ``k``, as they ended, and of the others."""
        own = F.get(units, k)
        fighter = F.struct(
            own["size"].cast("double").alias("size"), F.get(state["open"], F.lit(0)).alias("p"),
            uniform(F.lit(seed), F.lit(level), own["key"]).alias("u"),
        )
        smaller = F.slice(units["size"], k + 2, F.size(units))
        others = F.slice(state["open"], 2, F.size(units))

        def ended(p: Column, rest: Column) -> Column:
            return F.struct(F.concat(state["done"], F.array(p)).alias("done"), rest.alias("open"))

        def fought(a: Column) -> Column:
            lacks, had, rises = (1 - a["p"]) * a["size"], a["p"] * a["size"], a["u"] < a["p"]
            # the share of the duel that each smaller unit can carry
            can = F.zip_with(
                others, smaller, lambda p, s: F.when(s > 0, F.least(p * s / lacks, (1 - p) * s / had)).otherwise(0.0)
            )

            def moved(carried: Column) -> Column:
                def after(t: Column) -> Column:
                    scale, done = 1 / F.greatest(t, F.lit(1.0)), F.least(t, F.lit(1.0))
                    mine = F.when(rises, F.when(t >= 1, 1.0).otherwise(a["p"] + done * (1 - a["p"]))).otherwise(
                        F.when(t >= 1, 0.0).otherwise(a["p"] - done * a["p"])
                    )
                    words = F.when(rises, -lacks).otherwise(had) * scale

                    def opponents(w: Column) -> Column:
                        gained = F.zip_with(carried, smaller, lambda c, s: F.when(c > 0, w * c / s).otherwise(0.0))
                        return F.zip_with(others, gained, lambda p, d: F.greatest(F.least(p + d, F.lit(1.0)), F.lit(0.0)))

                    return ended(mine, let(words, opponents))

                return let(F.aggregate(carried, F.lit(0.0), lambda s, c: s + c), after)

            settled = (a["p"] < NEAR) | (a["p"] > 1 - NEAR)
            return (
                F.when(settled, ended(a["p"], others))
                .when(a["size"] == 0, ended(rises.cast("double"), others))
                .otherwise(let(can, moved))
            )

        return let(fighter, fought)

    start = F.struct(F.array().cast("array<double>").alias("done"), units["p"].alias("open"))
    chances = F.aggregate(F.sequence(F.lit(0), F.size(units) - 1), start, duel, lambda s: s["done"])
    return F.zip_with(units, chances, lambda x, p: F.struct(x["size"].alias("size"), x["key"].alias("key"), p.alias("p")))


def last_rounding(units: Column) -> Column:
    """Keys of the units, largest first, that rise if each goes where the words taken so far
    come nearest their sum."""
    start = F.struct(F.lit(0.0).alias("over"), F.array().cast("array<binary>").alias("won"))

    def step(state: Column, x: Column) -> Column:
        up, down = state["over"] + (1 - x["p"]) * x["size"], state["over"] - x["p"] * x["size"]
        rises = F.abs(up) <= F.abs(down)
        return F.struct(
            F.when(rises, up).otherwise(down).alias("over"),
            F.when(rises, F.concat(state["won"], F.array(x["key"]))).otherwise(state["won"]).alias("won"),
        )

    return F.aggregate(units, start, step, lambda s: s["won"])


def rounded(units: DataFrame, seed: int) -> DataFrame:
    """``units``: ``_source, size, key, p, _n`` with 0 < p < 1 and ``_n``: about the number of
    units in the source. The keys that are rounded up, each once.

    Blocks are dealt by hash, so that each holds large and small units and leaves a few small
    ones. What the last block of a source leaves is rounded to the nearest sum."""
    level, won = 0, None
    while True:
        blocks = F.ceil(F.col("_n") / BLOCK)
        dealt = units.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), blocks)).withColumn("_blocks", blocks)
        waits = (uniform(F.lit(seed), F.lit(level), F.lit("waits"), F.col("key")) * RESERVE < 1) & (F.col("_blocks") > 1)
        unit = F.struct("size", "key", "p")
        gathered = [F.collect_list(F.when(x, unit)).alias(n) for x, n in ((~waits, "_held"), (waits, "_waits"))]
        folded = dealt.groupBy("_source", "_block", "_blocks").agg(*gathered)
        fought = duels(F.sort_array("_held", asc=False), level, seed)
        folded = folded.select("_source", "_blocks", "_waits", F.when(F.size("_held") > 0, fought).otherwise(F.col("_held")).alias("_f"))
        rest = F.concat("_waits", F.filter("_f", lambda x: (x["p"] >= NEAR) & (x["p"] <= 1 - NEAR)))
        up = F.transform(F.filter("_f", lambda x: x["p"] > 1 - NEAR), lambda x: x["key"])
        folded = stored(folded.select("_source", "_blocks", up.alias("won"), rest.alias("rest")))
        last = F.when(F.col("_blocks") == 1, last_rounding(F.col("rest"))).otherwise(F.array().cast("array<binary>"))
        keys = folded.select(F.explode(F.concat("won", last)).alias("key"))
        won = keys if won is None else won.unionByName(keys)
        units = folded.where(F.col("_blocks") > 1).select("_source", F.explode("rest").alias("_u"), (LEFT * F.col("_blocks")).alias("_n"))
        units = units.select("_source", "_u.*", "_n")
        if units.isEmpty():
            return won
        level += 1


def mix(
    df: DataFrame, keys: list[str], source: str = "source", size: str = "size",
    weights: list[int] = WEIGHTS, cap: float = 3.0, seed: int = 9,
) -> DataFrame:
    """Add ``source_size``, ``target`` (of the row's source) and ``copies`` (how often the
    mix takes the row, at most ``ceil(cap)``); columns of these names are replaced.

    ``keys`` tell rows apart. Rows equal in keys, source and size are one unit with their
    summed expectation, dealt out evenly among them. A null size counts 0, a null source is
    a source of its own, a source without size has target 0 and no copies. Reruns agree.
    """
    kept = without(df, "source_size", "target", "copies")
    sized = kept.withColumn(size, F.coalesce(F.col(size).cast("long"), F.lit(0)))
    told = F.struct(*[F.col(f"`{k}`") for k in dict.fromkeys([*keys, source, size])])
    mark = F.unhex(F.sha2(F.to_json(told, {"ignoreNullFields": "false"}), 224))
    # the row travels in one struct, so that its columns clash with none of the names below
    row = F.struct(*[F.col(f"`{c}`") for c in sized.columns])
    keyed = sized.select(row.alias("_row"), mark.alias("_key"))
    named = keyed.select("_key", F.col("_row")[source].alias("_named"), F.col("_row")[size].alias("_size"))
    targets = source_targets(named, "_named", "_size", weights, cap)
    units = named.groupBy(F.col("_key").alias("key"), F.col("_named").alias("_unit_source"), F.col("_size").alias("size")).agg(
        F.count("*").alias("m")
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.least(share, F.lit(float(cap))) * F.col("m")
    units = units.join(targets, F.col("_unit_source").eqNullSafe(F.col("_source")))
    units = units.withColumn("_whole", F.floor(expected + NEAR)).withColumn("p", expected - F.col("_whole"))
    units = stored(units.select("_source", "size", "key", "m", "_whole", "p", "source_size", "target", "_rows"))
    fractional = units.where(F.col("p") > NEAR).select("_source", "size", "key", "p", F.col("_rows").alias("_n"))
    up = rounded(fractional, seed).select(F.col("key").alias("_up"))
    counted = units.join(up, F.col("key") == F.col("_up"), "left").select(
        F.col("key").alias("_unit"), "m", "source_size", "target",
        (F.col("_whole") + F.col("_up").isNotNull().cast("long")).alias("_total"),
    )
    joined = keyed.join(counted, F.col("_key") == F.col("_unit"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    each = F.floor(F.col("_total") / F.col("m"))
    copies = each + (F.col("_nth") <= F.col("_total") - each * F.col("m")).cast("long")
    return joined.withColumn("_nth", nth).select(
        "_row.*", F.col("source_size").cast("long").alias("source_size"), "target", copies.cast("long").alias("copies")
    )
