"""Long-running work: file streams whose restart repeats nothing, keyed upserts by micro-batch, state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orgweave.operators.upsert import coalescing_upsert
from orgweave.shipping import ship

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: str = "events*.parquet", schema: str | T.StructType = EVENTS) -> DataFrame:
    """Rows of the tables of ``folder`` whose names match ``files``; a table is a file or a folder of parts."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{files}}}")  # a source's path is a pattern or a folder, no file


def append_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is there and not done yet; a second call with the same checkpoint adds nothing."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def upsert_available(
    stream: DataFrame, table: str, checkpoint: str, key: Sequence[str], fields: Sequence[str], seq: str
) -> None:
    """Keep ``table`` (folders v=0, v=1, ...) the coalescing upsert of all rows seen.

    Each micro-batch merges into the version before it and writes the version of its own number, so a
    replayed batch writes the same folder again: nothing is done twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*key, *fields, F.col(seq).alias("_seq"), F.lit(1).cast("bigint").alias("puts"))
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{table}/v={number - 1}")
            rows = rows.unionByName(old.select(*key, *fields, F.col("first_seq").alias("_seq"), "puts"))
        firsts = rows.groupBy(*key).agg(F.first(F.lit(0)).alias("_x"), F.sum("puts").alias("_puts"))
        up = coalescing_upsert(rows.drop("puts"), key, [*key, *fields], "_seq").drop("key", "puts")
        up = up.join(firsts.drop("_x").withColumnRenamed("_puts", "puts"), list(key))
        up.write.mode("overwrite").parquet(f"{table}/v={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_until(writer: DataStreamWriter, should_stop: Callable[[], bool], every: str = "10 seconds", look: float = 0.2) -> int:
    """Keep a stream going, a micro-batch every so often, until told to stop or it ends; then the batch at work is
    finished and saved before the query stops. Returns the batches done; a later run goes on behind them."""
    q = writer.trigger(processingTime=every).start()
    while q.isActive and not should_stop():
        q.awaitTermination(look)
    while q.isActive and q.status["isTriggerActive"]:
        q.awaitTermination(look)
    q.stop()
    if q.exception() is not None:
        raise q.exception()
    return 0 if q.lastProgress is None else q.lastProgress["batchId"] + 1


def latest_version(spark: SparkSession, table: str, number: str = "v") -> DataFrame:
    every = spark.read.parquet(table)
    return every.filter(F.col(number) == every.agg(F.max(number)).first()[0]).drop(number)


def _state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, last_id, last = state.get if state.exists else (0, -1, None)
    for f in frames:
        n += len(f)
        f = f.dropna(subset=["value"]).sort_values("event_id")
        if len(f) and f["event_id"].iloc[-1] > last_id:
            last_id, last = int(f["event_id"].iloc[-1]), float(f["value"].iloc[-1])
    state.update((n, last_id, last))
    yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_id": [last_id], "last_value": [last]})


def latest_by_user(stream: DataFrame) -> DataFrame:
    """Running (user_id, events, last_id, last_value): custom state by key, blanks never erasing."""
    ship(stream.sparkSession)
    out = "user_id bigint, events bigint, last_id bigint, last_value double"
    return stream.groupBy("user_id").applyInPandasWithState(_state, out, "n bigint, last_id bigint, last double", "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An addition to the inventory: counts by event-time window and kind, late rows beyond ``late`` dropped."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
