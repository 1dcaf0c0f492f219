"""Exports: GeoJSON lines, spreadsheet CSV, versions with a content address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsift.functions.text import safe_cell


def geojson_geometry(geom: Column) -> Column:
    """GeoJSON text of a geometry."""
    coords = F.transform(geom, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(coords, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.when(F.size(geom) == 1, one).otherwise(many)


def feature_lines(df: DataFrame, id_col: str, geom: Column, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    props = F.to_json(F.struct(*[F.col(p) for p in properties]))
    return df.select(F.concat(F.lit('{"type":"Feature","id":"'), F.col(id_col).cast("string"), F.lit('","geometry":'), geojson_geometry(geom),
                              F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_features(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as text a spreadsheet will not run."""
    return df.select(*[safe_cell(F.col(c)).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` wrote, as text."""
    return spark.read.option("sep", ";").option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').csv(path)


def vertex_rows(df: DataFrame, keys: Sequence[str], geom: Column) -> DataFrame:
    """Part, ring and vertex numbers from 1, with coordinates."""
    a = df.select(*keys, F.posexplode(geom).alias("part", "_p"))
    b = a.select(*keys, (F.col("part") + 1).alias("part"), F.posexplode("_p").alias("ring", "_r"))
    c = b.select(*keys, "part", (F.col("ring") + 1).alias("ring"), F.posexplode("_r").alias("vertex", "_v"))
    return c.select(*keys, "part", "ring", (F.col("vertex") + 1).alias("vertex"), F.col("_v.x").alias("x"), F.col("_v.y").alias("y"))


def content_id(df: DataFrame, group: Sequence[str], order_free: Sequence[str], length: int = 20, name: str = "version") -> DataFrame:
    """Content address per group that no row order or partitioning changes.

    Slices of the row digests are summed, so no step gathers a whole group.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(order_free)])), 256)
    rows = df.select(*group, row.alias("_h")).groupBy(*group, "_h").agg(F.count("*").alias("_n"))
    # sums of digest slices are exact and combine before the shuffle; equal sets of rows give equal sums
    def part(a):
        return F.sum(F.conv(F.substring("_h", a, 12), 16, 10).cast("decimal(18,0)") * F.col("_n"))

    sums = rows.groupBy(*group).agg(F.sum("_n").alias("rows"), *[part(1 + 12 * i).alias(f"_s{i}") for i in range(5)])
    return sums.select(*group, "rows", F.substring(F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(5)]), 256), 1, length).alias(name))


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Write one immutable version; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def save(df: DataFrame, path: str) -> str:
    """Write ``df`` under its own content address, which is returned."""
    found = content_id(df.withColumn("_all", F.lit(1)), ["_all"], df.columns).first()
    version = found["version"] if found is not None else "empty"
    write_version(df, path, version)
    return version


def write_versions(df: DataFrame, path: str, group: Sequence[str]) -> None:
    """Write a version of every group, all in one job, each in the folder its content names.

    The job commits as a whole, so a lost executor leaves no half version.
    """
    named = df.join(content_id(df, group, df.columns).select(*group, "version"), list(group))
    named.write.mode("errorifexists").partitionBy("version").parquet(path)


def load_versions(spark: SparkSession, path: str, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all versions below ``path`` that still fit their address, and ``(group, version, refused)`` of each."""
    df = spark.read.parquet(path)
    found = content_id(df, [*group, "version"], [c for c in df.columns if c != "version"], name="found")
    states = found.select(*group, "version", (F.col("found") != F.col("version")).alias("refused"))
    return df.join(states.where("NOT refused").select("version"), "version"), states


def load_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Read a version back and refuse it when its content address no longer fits."""
    df = spark.read.parquet(f"{path}/version={version}")
    found = content_id(df.withColumn("_all", F.lit(1)), ["_all"], df.columns).first()
    if (found["version"] if found is not None else "empty") != version:
        raise ValueError("saved version has changed")
    return df
