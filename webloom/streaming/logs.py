"""Logs written by streams: a batch's lines are a folder named by its number, so that a batch run again changes nothing."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from webloom.functions import urls
from webloom.operators import extract

PROGRESS = "stream string, batch long, at string, rows_in long, rows_per_s double, state_rows long, watermark string, ms long"


def log(stream: DataFrame, folder: str, name: str, most: int | None = None) -> StreamingQuery:
    """Starts appending ``stream`` to the log in ``folder`` under ``name``: JSON lines, below name/batch=n.

    The stream's state lies beside it, in name/_state; started again, it goes on where it ended, and a batch that was
    cut off is written anew in its place. Readers of the log see whole batches only. With ``most``, a batch logs its
    first ``most`` rows in the order of their columns, and the rest is silent.
    """

    def write(batch: DataFrame, number: int) -> None:
        some = batch if most is None else batch.orderBy(*batch.columns).limit(most)
        some.write.mode("overwrite").json(f"{folder}/{name}/batch={number}")

    return stream.writeStream.option("checkpointLocation", f"{folder}/{name}/_state").trigger(availableNow=True).foreachBatch(write).start()


def logged(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The lines of a log (``schema``), with their batch."""
    return spark.read.schema(schema).option("basePath", f"{folder}/{name}").json(f"{folder}/{name}")


def visited(pages: DataFrame) -> DataFrame:
    """(url) of each normalized link when it is first seen: what the log of visited URLs holds. The state is the visited set."""
    links = extract.two_tier_links(pages).where(urls.is_crawlable(F.col("link")))
    return links.select(urls.normalize_url(F.col("link")).alias("url")).dropDuplicates(["url"])


def quarantine(pages: DataFrame) -> DataFrame:
    """(page_id, url, reason) of each page that the parser gives up."""
    return extract.quarantined(extract.analyzed(pages))


def downloads(outcomes: DataFrame, url: str = "url", ok: str = "ok") -> DataFrame:
    """(url) of each success, as it is."""
    return outcomes.where(F.col(ok)).select(F.col(url).alias("url"))


class Progress(StreamingQueryListener):
    """What streams report while they run, a row for each batch, appended to a log of its own every ``often`` batches."""

    def __init__(self, spark: SparkSession, folder: str, often: int = 100) -> None:
        self.spark, self.folder, self.often = spark, folder, often
        self.held: list[tuple] = []
        self.written, self.ended, self.lock = 0, set(), threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        p = event.progress
        with self.lock:
            self.held.append((str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0.0), sum(s.numRowsTotal for s in p.stateOperators), p.eventTime.get("watermark"), p.batchDuration))
            if len(self.held) >= self.often:
                self._write()

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        with self.lock:
            self.ended.add(str(event.id))
            self.lock.notify_all()

    def _write(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, PROGRESS).coalesce(1).write.mode("overwrite").json(f"{self.folder}/progress/part={self.written}")
            self.held, self.written = [], self.written + 1

    def table(self) -> DataFrame:
        """(stream, batch, at, rows_in, rows_per_s, state_rows, watermark, ms) of all batches so far."""
        with self.lock:
            self._write()
        if not self.written:
            return self.spark.createDataFrame([], PROGRESS)
        return self.spark.read.schema(PROGRESS).json(f"{self.folder}/progress")

    def watch(self, start: Callable[[], StreamingQuery], seconds: float = 60.0) -> StreamingQuery:
        """Starts a bounded stream, waits for its end, and until all that it reports is here."""
        self.spark.streams.addListener(self)
        try:
            query = start()
            query.awaitTermination()
            with self.lock:
                self.lock.wait_for(lambda: str(query.id) in self.ended, seconds)
        finally:
            self.spark.streams.removeListener(self)
        return query


def reports(progress: DataFrame) -> DataFrame:
    """(line) of each batch: what a monitor prints while a stream runs."""
    return progress.where("rows_in > 0").select(F.format_string("batch %d: %d rows, %.0f a second, %d in state", "batch", "rows_in", "rows_per_s", "state_rows").alias("line"))
