"""Incremental ingest of dated observations with Structured Streaming.

Every micro-batch reduces its rows to one delta per key and overwrites its own
folder, so a replayed batch changes nothing.  Deltas are only appended; reading
folds them.  A failed refresh never renews the date of the last good answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DELTA = "key bigint, last struct<ts:timestamp,event_id:bigint,event_type:string>, good struct<ts:timestamp,event_id:bigint,value:double>"


def deltas(rows: DataFrame) -> DataFrame:
    """Latest attempt and latest good, non-empty answer per key; combines before its shuffle."""
    good = F.when((F.col("event_type") != "error") & (F.col("value") > 0), F.struct("ts", "event_id", "value"))
    return rows.groupBy(F.col("user_id").alias("key")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"), F.max(good).alias("good"))


def fold(parts: DataFrame) -> DataFrame:
    g = parts.groupBy("key").agg(F.max("last").alias("last"), F.max("good").alias("good"))
    state = F.when(F.col("last.event_type") != "error", "received").when(F.col("good").isNotNull(), "retained").otherwise("error")
    return g.select("key", state.alias("state"), F.date_format("good.ts", "yyyy-MM-dd HH:mm:ss").alias("received_at"), F.col("good.value").alias("value"))


def ingest(spark: SparkSession, source: str, schema: StructType, glob: str, target: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Take everything that has landed since the last run, then stop."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(source))

    def store(batch: DataFrame, batch_id: int) -> None:
        deltas(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, target: str) -> DataFrame:
    return fold(spark.read.schema(DELTA).parquet(target))


def compact(spark: SparkSession, target: str, compacted: str) -> None:
    """Fold all deltas of a stopped ingest into one folder of the same form."""
    d = spark.read.schema(DELTA).parquet(target)
    d.groupBy("key").agg(F.max("last").alias("last"), F.max("good").alias("good")).write.mode("errorifexists").parquet(f"{compacted}/batch=0")
