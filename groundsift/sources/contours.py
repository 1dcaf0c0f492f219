"""Contours of XML land records: whitelisted paths to point rows, then rules per contour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundsift.functions import geometry as G

_ORD = "struct<x:string,y:string,ord_nmb:string>"
RECORD = ("object struct<common_data:struct<cad_number:string>>, contours_location struct<contours:struct<contour:array<struct<"
          f"entity_spatial:struct<sk_id:string,spatials_elements:struct<spatial_element:array<struct<ordinates:struct<ordinate:array<{_ORD}>>>>>>>>>>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "land_record").schema(RECORD).load(path)


def record_points(records: DataFrame) -> DataFrame:
    """One row per ordinate: number, contour, order in the document, decimal text as written."""
    c = records.select(F.col("object.common_data.cad_number").alias("cad_number"), F.posexplode("contours_location.contours.contour").alias("contour", "_c"))
    e = c.select("cad_number", "contour", F.col("_c.entity_spatial.sk_id").alias("crs"),
                 F.get(F.col("_c.entity_spatial.spatials_elements.spatial_element"), F.lit(0)).alias("_e"))
    return (e.select("cad_number", "contour", "crs", F.posexplode("_e.ordinates.ordinate").alias("pos", "_o"))
            .select("cad_number", "contour", "crs", "pos", F.col("_o.x").alias("raw_x"), F.col("_o.y").alias("raw_y"), F.col("_o.ord_nmb").alias("ord")))


def check_contours(points: DataFrame, keys=("cad_number", "contour")) -> DataFrame:
    """Reason code per contour; NULL when it can be used.

    Closure compares exact decimals.  The last point may repeat ordinal 1 only
    when it closes the ring exactly.  Points of one contour form one ring, so
    gathering them is bounded by the record they come from.
    """
    p = points.withColumn("x", F.trim("raw_x").try_cast("decimal(20,6)")).withColumn("y", F.trim("raw_y").try_cast("decimal(20,6)")) \
        .withColumn("o", F.when(F.trim("ord").rlike(r"^\+?[0-9]+$"), F.trim("ord").try_cast("bigint")))
    g = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("bad"), F.count("ord").alias("ords"), F.max("pos").alias("last"),
        F.count_if(F.col("ord").isNotNull() & (F.col("o").isNull() | ((F.col("o") != F.col("pos") + 1) & (F.col("o") != 1)))).alias("misplaced"),
        F.max(F.when((F.col("o") == 1) & (F.col("pos") > 0), F.col("pos"))).alias("again"),
        F.count_if((F.col("o") == 1) & (F.col("pos") > 0)).alias("ones"),
        F.count_distinct("x", "y").alias("places"), F.min_by(F.struct("x", "y"), "pos").alias("first_point"), F.max_by(F.struct("x", "y"), "pos").alias("last_point"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))),
                    lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))
    closed = F.col("first_point") == F.col("last_point")
    repeat = F.coalesce(F.col("again") == F.col("last"), F.lit(False)) & (F.col("ones") == 1)
    order_bad = ((F.col("misplaced") > 0) | ((F.col("ords") > 0) & (F.col("ords") != F.col("n")))
                 | ((F.col("ones") > 0) & ~repeat) | (repeat & ~closed))
    code = (F.when(F.col("bad") > 0, "invalid_coordinate").when(order_bad, "invalid_point_order")
            .when((F.col("n") < 4) | (F.col("places") < 3), "insufficient_points").when(~closed, "unclosed_contour")
            .when(G.ring_self_intersects(F.col("ring")) | (G.ring_area(F.col("ring")) == 0), "invalid_contour"))
    return g.select(*keys, F.col("n").alias("point_count"), code.alias("code"), F.when(code.isNull(), F.abs(G.ring_area(F.col("ring")))).alias("area"))
