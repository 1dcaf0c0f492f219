"""Ranks over a whole table, or over groups of any size, without a one-task window.

Rows are range partitioned and sorted once and kept in the checkpoint folder;
a row's rank is its place in its partition plus the sizes of the partitions
before it.  Only one number per partition travels to the other side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsift.session import pin


def _placed(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add ``_p``, the sorted partition, ``_i``, the place in it from 0, and ``name``, the place in the table from 1."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = pin(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_p", F.shiftrightunsigned("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_s"))
    # one row per partition: the side is as small as the partition count
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i") + 1).drop("_m", "_s")


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add ``name``: 1-based place in ``order``, which should end in a unique key."""
    return _placed(df, order, name).drop("_p", "_i")


def grouped_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Place inside a group that may hold any share of the table; null is a group too.

    Only groups that open a partition can have begun before it.  Their first
    places, one a partition at most, are broadcast; all other groups lie in one
    partition, and a window over (partition, group) never holds more than that.
    """
    ranked = _placed(df, [*[F.col(g) for g in group], *order], "_g")
    named = ranked.withColumn("_k", F.struct(*[F.struct(F.col(g).isNull(), F.col(g)) for g in group]))
    opening = named.where("_i = 0").select("_k").distinct()
    begun = named.join(F.broadcast(opening), "_k", "left_semi").groupBy("_k").agg(F.min("_g").alias("_f"))
    local = F.min("_g").over(Window.partitionBy("_p", "_k"))
    return (named.withColumn("_l", local).join(F.broadcast(begun), "_k", "left")
            .withColumn(name, F.col("_g") - F.coalesce("_f", "_l") + 1).drop("_k", "_p", "_i", "_g", "_l", "_f"))


def with_neighbours(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Add ``prev_*`` and ``next_*`` of ``columns`` inside a group of any size.

    Rows meet their neighbours in a join on (group, place), which spreads a hot
    group over all tasks; a window would sort it in one.
    """
    key = F.struct(*[F.struct(F.col(g).isNull(), F.col(g)) for g in group])
    r = grouped_rank(df, group, order, "_pos").withColumn("_k", key)
    side = lambda by, tag: r.select("_k", (F.col("_pos") + by).alias("_pos"), *[F.col(c).alias(f"{tag}_{c}") for c in columns])
    return r.join(side(1, "prev"), ["_k", "_pos"], "left").join(side(-1, "next"), ["_k", "_pos"], "left").drop("_k", "_pos")


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str, name: str, block: int = 4096) -> DataFrame:
    """Sum of ``value`` over the rows of a group before this one.

    Places are cut into blocks; totals of blocks are summed over blocks, which
    are fewer by that factor, and rows inside a block by a window of bounded size.
    """
    key = F.struct(*[F.struct(F.col(g).isNull(), F.col(g)) for g in group])
    r = grouped_rank(df, group, order, "_pos").withColumn("_b", F.floor((F.col("_pos") - 1) / block)).withColumn("_k", key)
    sums = r.groupBy("_k", "_b").agg(F.sum(value).alias("_t"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_t").over(
        Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    w = Window.partitionBy("_k", "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (r.join(before, ["_k", "_b"]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0)))
            .drop("_k", "_pos", "_b", "_before"))
