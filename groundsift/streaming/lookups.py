"""Number lookups over any number of runs, each number's state kept by Structured Streaming.

A number is open until it is received.  After an error every next answer
counts; after ``not_found``, ``not_returned`` or ``rejected`` only one that was
asked for as a retry does.  The state store holds, per number, where it stands,
how many answers have counted and the last answer seen, so a run that starts
from the checkpoint goes on where the last one ended, and answers that land
once more change nothing.  Answers are numbered in the order they were given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from groundsift.session import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETRIED = ("not_found", "not_returned", "rejected")
OUT = "number long, state string, answer long, counted long"


class Lookup(StatefulProcessor):
    """State of one number: state, answer that set it, answers counted, last answer seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("lookup", "state string, answer long, counted long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, answer, counted, seen = self.held.get() if self.held.exists() else (None, -1, 0, -1)
        # of a number's answers in one batch; what a batch takes in is bounded by its files
        new = pd.concat(rows).sort_values("answer").drop_duplicates("answer")
        before = (state, counted)
        for got, number, retry in zip(new["state"], new["answer"].tolist(), new["retry"].tolist()):
            if number <= seen:
                continue
            seen = number
            if state is None or state == "error" or (state in RETRIED and retry):
                state, answer, counted = got, number, counted + 1
        self.held.update((state, answer, counted, seen))
        if before != (state, counted):
            yield pd.DataFrame({"number": [key[0]], "state": [state], "answer": [answer], "counted": [counted]})

    def close(self) -> None:
        pass


def run(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, files_per_batch: int = 16) -> None:
    """Take in all answers ``(number, answer, state, retry)`` that have landed since the last run, then stop."""
    ship_package(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        states = stream.groupBy("number").transformWithStateInPandas(Lookup(), OUT, "Update", "None")

        def store(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

        states.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def current(spark: SparkSession, target: str) -> DataFrame:
    """Where every number stands after all runs, and whether a retry run asks for it again."""
    last = spark.read.schema(OUT + ", batch long").parquet(target).groupBy("number").agg(F.max_by(F.struct("state", "answer", "counted"), "counted").alias("m"))
    return last.select("number", "m.state", "m.answer", "m.counted", (F.col("m.state") != "received").alias("open"))
