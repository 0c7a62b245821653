"""The crawl's running state as Structured Streaming: first sightings, counters, retries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.config import DEFAULT


def first_sightings(stream: DataFrame, *key: str) -> DataFrame:
    """Each key once, when first seen. The state is the visited set and grows with it, as a crawler's must."""
    return stream.select(*key).dropDuplicates(list(key))


def first_sightings_within(stream: DataFrame, time: str, delay: str, *key: str) -> DataFrame:
    """As ``first_sightings``, with state bounded to keys seen within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def window_counts(stream: DataFrame, time: str = "ts", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Attempts and successes by tumbling event-time window; later data than ``delay`` is left out."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("success"))
    return out.select(F.col("w.start").alias("start"), "attempts", "success")


def retry_states(stream: DataFrame, *order: str, retries: int = DEFAULT.retries) -> DataFrame:
    """(url, attempts, state) whenever a task ends: downloaded on success, failed after 1 + ``retries`` failures.

    ``stream`` has url, ok and the columns of ``order``, in which a batch's attempts of a URL are taken; batches
    follow each other, so what a batch may hold (``events``) bounds what a URL brings at once. A task that has ended
    starts anew when its URL comes again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        ended = []
        made = pd.concat(list(batches))
        for ok in (made.sort_values(list(order), kind="stable") if order else made)["ok"]:
            n += 1
            if ok or n > retries:
                ended.append((key[0], n, "downloaded" if ok else "failed"))
                n = 0
        if n:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(ended, columns=["url", "attempts", "state"])

    return stream.groupBy("url").applyInPandasWithState(step, "url string, attempts long, state string", "n long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a bounded stream to its end into a table in the shared scratch folder, and reads that.

    A ``path`` given again goes on where the run before it ended: its state and offsets are kept there.
    """
    spark = stream.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = path or f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        if mode == "append":
            batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        else:
            batch.write.mode("overwrite").parquet(f"{path}/data/batch=0")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names)


def source(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream: a folder of files, or one file, which a stream reads by its folder.

    A batch takes ``files_per_batch`` files at most: what arrives faster waits in the folder.
    """
    path = f"{sf_dir}/{table}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """The events table as a stream."""
    return source(spark, sf_dir, "events", files_per_batch)
