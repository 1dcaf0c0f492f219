"""Vector answers: landed GeoJSON to feature rows, rule columns, accepted rows, rejects and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsift.functions import geometry as G

POLYGON = "array<array<array<double>>>"
MULTI = "array<array<array<array<double>>>>"


def read_layers(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Landed layer files, one FeatureCollection each, as one row per feature with its envelope."""
    reader = spark.read.option("multiLine", True)
    raw = (reader.schema(schema) if schema else reader).json(path).withColumn("_file", F.input_file_name())
    return raw.select(*[c for c in raw.columns if c != "features"], F.posexplode_outer("features").alias("_ord", "feature"))


def parse_geometry(kind: Column, coordinates: Column) -> Column:
    """Coordinates text to the part / ring / vertex form; NULL for other kinds or broken text."""
    def ring(r):
        return F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    poly = F.from_json(coordinates, POLYGON)
    multi = F.from_json(coordinates, MULTI)
    return (F.when(kind == "Polygon", F.array(F.transform(poly, ring)))
            .when(kind == "MultiPolygon", F.transform(multi, lambda part: F.transform(part, ring))))


def to_lonlat(geom: Column, crs: Column) -> Column:
    """Vertices to longitude and latitude; Mercator answers are unprojected, others pass."""
    return F.when(crs == "EPSG:3857", G.map_points(geom, G.mercator_inverse)).otherwise(geom)


def response_gate(next_link: Column, declared: Column, got: Column) -> Column:
    """First completeness rule an answer breaks: a further page, or another count than it declares."""
    stated = F.when(declared.rlike(r"^\d+$"), declared.try_cast("bigint"))
    return F.when(F.coalesce(next_link, F.lit(False)), "further page").when(stated.isNotNull() & (stated != got), "count differs")


def normalize(features: DataFrame, crs_names=("EPSG:3857", "EPSG:4326")) -> DataFrame:
    """Rule column and stored form of every feature.

    Expects response, category, fid, crs, geom.  ``key`` is category and id, or
    the geometry digest when the answer names no id.
    """
    lonlat = to_lonlat(F.col("geom"), F.col("crs"))
    f = features.withColumn("world", lonlat)
    reason = F.when(~F.coalesce(F.col("crs").isin(*crs_names), F.lit(False)), "crs").otherwise(F.coalesce(
        G.invalid_reason(F.col("geom")), F.when(~G.finite_in_range(F.col("world"), -180.0, -90.0, 180.0, 90.0), "range")))
    return (f.withColumn("reason", reason)
            .withColumn("key", F.concat_ws(":", F.col("category").cast("string"), F.coalesce(F.col("fid"), G.geometry_hash(F.col("geom"))))))


def accept_strict(rows: DataFrame) -> DataFrame:
    """Per answer: accepted only when no feature breaks a rule."""
    return rows.groupBy("response").agg(F.count("*").alias("received"), F.count("reason").alias("bad"), (F.count("reason") == 0).alias("accepted"))


def split_quarantine(rows: DataFrame, structural=("crs", "ring structure", "range", "empty")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows, rejected rows and receipts.

    Only broken topology is quarantined; a structural fault rejects the whole
    answer, so its rows are in neither table.
    """
    state = (rows.groupBy("response").agg(F.count("*").alias("received"), F.count_if(F.col("reason").isin(*structural)).alias("structural"),
                                          F.count_if(F.col("reason").isNotNull() & ~F.col("reason").isin(*structural)).alias("invalid")))
    receipts = state.select("response", "received", F.when(F.col("structural") > 0, F.lit(0)).otherwise(F.col("received") - F.col("invalid")).alias("accepted"),
                            F.when(F.col("structural") > 0, F.lit(0)).otherwise(F.col("invalid")).alias("invalid"),
                            F.when(F.col("structural") > 0, "rejected").when(F.col("invalid") > 0, "partial").otherwise("done").alias("state"))
    open_ = rows.join(receipts.where("state <> 'rejected'").select("response"), "response", "left_semi")
    rejects = open_.where("reason IS NOT NULL").select("response", "key", "reason", F.sha2(F.to_json("geom"), 256).alias("geometry_sha256"), G.bounds(F.col("geom")).alias("bbox"))
    return open_.where("reason IS NULL"), rejects, receipts
