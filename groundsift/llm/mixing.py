"""Mixing sources to target weights by Pfair scheduling.  DataFrame functions only.

A source's rows are cut into blocks.  Weights are whole parts of ``period``
slots; block k of a source with weight w = part / period is released at slot
floor(k / w) and due at slot ceil((k + 1) / w).  Every slot goes to the released
block that is due first.  On one machine with weights that add up to one this
meets every deadline, so after any number of slots t each source has had more
than w t - 1 and less than w t + 1 blocks.  The schedule repeats every
``period`` slots and is folded over one row of arrays.

The mix runs until each source has been read to its end once.  A source that
ends earlier starts its next epoch, so rows come up again where the target
weight is above what the source holds; no row is left out.  A block of a
source's end is shorter.  Default targets are rows to the power 0.75.

A null source is a source of its own.  Null ids and null texts are rows like
any other, repeated rows are scheduled each for itself.  Sources with a target
but no row are left out and the targets of the rest rescaled; sources without
a target, or with one that isn't above zero, are refused, since their rows
could not be kept.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import cut, rank_in

#: rows of a block; slots of the schedule's period
BLOCK_ROWS = 16
PERIOD = 1024
POWER = 0.75


def parts(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """``(source, n, target)`` to one row ``(sources)``: structs (source, n, part), parts at least 1 that add up to the period.

    Every source has one slot; the others go by largest remainder, ties by
    order of name.  The period is raised to 16 slots a source where it is shorter.
    """
    listed = sources.agg(F.array_sort(F.collect_list(F.struct("source", "n", "target"))).alias("s"))
    listed = listed.withColumn("period", F.greatest(F.lit(period), 16 * F.size("s")))
    listed = listed.withColumn("total", F.aggregate("s", F.lit(0.0), lambda t, x: t + x["target"]))
    free = F.col("period") - F.size("s")
    share = lambda x: x["target"] / F.col("total") * free
    listed = listed.withColumn("floor", F.transform("s", lambda x: F.floor(share(x))))
    listed = listed.withColumn("spare", free - F.aggregate("floor", F.lit(0).cast("long"), lambda t, x: t + x))
    order = F.array_sort(F.transform("s", lambda x, i: F.struct((-(share(x) - F.floor(share(x)))).alias("r"), i.alias("i"))))
    listed = listed.withColumn("lucky", F.transform(F.slice(order, F.lit(1), F.greatest(F.col("spare").cast("int"), F.lit(0))), lambda x: x["i"]))
    named = F.transform("s", lambda x, i: F.struct(x["source"].alias("source"), x["n"].alias("n"), (
        F.get("floor", i) + 1 + F.array_contains("lucky", i).cast("long")).alias("part")))
    return listed.select(F.col("period").cast("long").alias("period"), named.alias("sources"))


def schedule(weights: DataFrame) -> DataFrame:
    """``(period, sources)`` to itself with ``slots``: the source index of each slot of one period, earliest deadline first."""
    size = F.size("sources")
    done = F.transform("sources", lambda x: F.lit(0).cast("long"))

    def next_(state: Column, t: Column) -> Column:
        # (deadline, index) of every source whose next block is released by slot t
        open_ = F.transform("sources", lambda x, i: F.when(
            F.get(state["done"], i) * F.col("period") < (t + 1) * x["part"],
            F.struct(F.ceil((F.get(state["done"], i) + 1) * F.col("period") / x["part"]).alias("due"), i.alias("i"))))
        first = F.array_min(open_)["i"]
        return F.struct(F.transform(state["done"], lambda d, i: d + (i == first).cast("long")).alias("done"),
                        F.concat(state["slots"], F.array(first)).alias("slots"))

    start = F.struct(done.alias("done"), F.array().cast("array<int>").alias("slots"))
    folded = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, next_, lambda s: s["slots"])
    return weights.where(size > 0).withColumn("slots", folded)


def plan(docs: DataFrame, targets: DataFrame | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """One row per source: ``(source, n, blocks, part, period, own, length)``.

    ``own`` holds the slots of a period that are the source's; ``length`` is
    the number of slots that the mix runs.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if targets is None:
        counts = counts.withColumn("target", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        t = targets.select(F.col("source").alias("_s"), F.col("target").cast("double").alias("target"))
        counts = counts.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        counts = counts.withColumn("target", F.when(F.col("target") > 0, F.col("target")).otherwise(
            F.raise_error(F.concat(F.lit("no target weight above zero for source "), F.coalesce(F.col("source").cast("string"), F.lit("null")))).cast("double")))
    made = schedule(parts(counts, period))
    each = made.select("period", "slots", F.posexplode("sources").alias("i", "x")).select(
        F.col("x.source").alias("source"), F.col("x.n").alias("n"), F.ceil(F.col("x.n") / block_rows).alias("blocks"), F.col("x.part").alias("part"), "period",
        F.filter(F.transform("slots", lambda s, k: F.when(s == F.col("i"), k)), lambda k: k.isNotNull()).alias("own"))
    end = (F.floor((F.col("blocks") - 1) / F.col("part")) * F.col("period") + F.get("own", ((F.col("blocks") - 1) % F.col("part")).cast("int")) + 1)
    return each.join(each.groupBy("period").agg(F.max(end).alias("length")), "period")  # the period is the same for all


def mix(docs: DataFrame, targets: DataFrame | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """``docs(doc_id, source, ...)``, read from a table, to ``(row, epoch, block, place, slot, release, due)``.

    ``row`` is the input row, once for each time it comes up; ``slot`` orders
    the mix, ``place`` the rows of a block.  Blocks hold rows by hash of the
    row, so that a block is a fair draw of its source.
    """
    weights = cut(plan(docs, targets, block_rows, period))
    rows = docs.select(F.struct("*").alias("row"), F.col("source"), F.xxhash64(*docs.columns).alias("_o"), F.col("doc_id").alias("_d"))
    ranked = rank_in(rows, ["source"], ["_o", "_d"], "_rank")
    w = weights.withColumnRenamed("source", "_source")
    # ``period`` slots in all and one row a source: bounded by the schedule
    joined = ranked.join(F.broadcast(w), F.col("source").eqNullSafe(F.col("_source")))
    block = F.floor(F.col("_rank") / block_rows)
    # slots of the source among the first ``length``
    mine = (F.floor(F.col("length") / F.col("period")) * F.col("part")
            + F.size(F.filter("own", lambda k: k < F.col("length") % F.col("period"))))
    turns = F.ceil((mine - F.col("block")) / F.col("blocks"))
    joined = joined.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    k = F.col("epoch") * F.col("blocks") + F.col("block")
    return joined.select(
        "row", "epoch", "block", (F.col("_rank") % block_rows).alias("place"),
        (F.floor(k / F.col("part")) * F.col("period") + F.get("own", (k % F.col("part")).cast("int"))).alias("slot"),
        F.floor(k * F.col("period") / F.col("part")).alias("release"), F.ceil((k + 1) * F.col("period") / F.col("part")).alias("due"))
