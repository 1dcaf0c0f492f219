"""Keys anywhere in JSON texts, level by level.

Texts become variants once.  Each round explodes the objects and arrays of one
level for all rows at once, keeps their keys and goes on with those children
that are objects or arrays themselves, until none is left; so depth costs rounds
and never a deep expression, and keys are decoded by the parser, however they
are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.session import cut


def tree_keys(rows: DataFrame, key: str, body: Column) -> DataFrame:
    """``(key, depth, name)`` of every object key in the text of a row; texts that are no JSON have none."""
    spark = rows.sparkSession
    inner = lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")
    level = rows.select(F.col(key), F.try_parse_json(body).alias("v")).where(F.col("v").isNotNull() & inner(F.col("v")))
    found, depth = None, 0
    while True:
        children = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(key, F.col("key").alias("name"), F.col("value").alias("v"))
        children = cut(children.select(key, "name", F.when(inner(F.col("v")), F.col("v")).alias("v")))
        names = children.where("name IS NOT NULL").select(key, F.lit(depth).alias("depth"), "name")
        found = names if found is None else found.unionByName(names)
        level, depth = children.where("v IS NOT NULL").select(key, "v"), depth + 1
        if level.isEmpty():
            return found


def has_key(rows: DataFrame, key: str, body: Column, names: Sequence[str]) -> DataFrame:
    """``(key, readable, forbidden)``: whether the text is JSON, and whether one of ``names`` is a key in it, in any case of letters; ``key`` must be unique."""
    hits = tree_keys(rows, key, body).where(F.lower("name").isin(list(names))).select(key, F.lit(True).alias("_hit")).distinct()
    out = rows.select(F.col(key), F.try_parse_json(body).isNotNull().alias("readable")).join(hits, key, "left")
    return out.select(key, "readable", F.coalesce("_hit", F.lit(False)).alias("forbidden"))
