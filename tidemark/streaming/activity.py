"""Activity over streams: windowed counts with late data, and anchored runs that are kept as state."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table (a file or a folder of files) as a stream, its schema read once."""
    schema: StructType = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if os.path.isfile(f"{folder}/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def windowed_activity(events: DataFrame, time: str, key: str, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """``start, key, events``: events per window and key; rows later than ``lateness`` behind the newest are dropped by the stream."""
    rows = events.withWatermark(time, lateness).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.col("window.start").alias("start"), key, "events")


def anchored_runs(events: DataFrame, time: str, key: str, span_s: int) -> DataFrame:
    """``key, first, last, events``: runs that end ``span_s`` seconds after their first event, emitted when they close.

    State per key is one open run; within a batch a key's rows may come in several chunks and
    are sorted before they are folded. The last run of a key is emitted by its timeout.
    """

    def fold(key_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed: list[tuple] = []
        run = state.getOption
        if state.hasTimedOut:
            yield pd.DataFrame([(key_[0], *run)], columns=["key", "first", "last", "events"])
            state.remove()
            return
        times = sorted(t for c in chunks for t in c["t"].tolist())
        for t in times:
            if run is None or t - run[0] > span_s:
                if run is not None:
                    closed.append((key_[0], *run))
                run = (t, t, 1)
            else:
                run = (run[0], max(run[1], t), run[2] + 1)
        if run is not None:
            state.update(run)
            mark = state.getCurrentWatermarkMs()
            state.setTimeoutTimestamp(max(mark + 1, (run[0] + span_s) * 1000 + 1))
        if closed:
            yield pd.DataFrame(closed, columns=["key", "first", "last", "events"])

    rows = events.withWatermark(time, f"{span_s} seconds").select(time, F.col(key).cast("string").alias("key"), F.unix_timestamp(time).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(
        fold, "key string, first long, last long, events long", "first long, last long, events long", "append", GroupStateTimeout.EventTimeTimeout
    )


def drain(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into files of a shared folder; returns the result, for complete results that of the last batch."""
    spark = stream.sparkSession
    base = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share, or name one")
        base = tempfile.mkdtemp(prefix="tidemark-stream-")
    out = f"{base.rstrip('/')}/stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")
    # a complete result replaces the last one in a folder, so that it never has to fit the driver
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        last[:] = [f"{out}/data-{number}"]
        batch.write.mode("overwrite").parquet(last[0])

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
