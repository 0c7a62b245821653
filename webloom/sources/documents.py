"""Downloaded documents as files, written by a data source in two steps.

Tasks stage their files, each attempt in a folder of its own, beside an index of them (Parquet). When all have ended,
the commit moves the attempts that count into place and then writes one manifest, which alone makes them visible: a
reader sees a whole job or nothing of it, whatever tasks were repeated or lost. The manifest names attempts, not
documents, so that the driver's share does not grow with these. A name is won by the last in order within a job, and
by the later job over the earlier; names are settled over the indexes as a join, not on the driver.

    data/<attempt>/<filename>   index/<attempt>.parquet   commits/<number>.json   staged/<job>/<attempt>/...
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom.sources.sinks import document_names
from webloom.sources.stores import files, put, store

_INDEX = pa.schema([("filename", pa.string()), ("url", pa.string()), ("bytes", pa.int64())])
#: Rows of an index that are held before they are written.
HELD = 10_000


@dataclass
class Staged(WriterCommitMessage):
    """What a task that succeeded has left."""

    attempt: str
    documents: int
    bytes: int


class Documents(DataSource):
    """Format ``webloom_documents``, for writing (filename, url, content); overwriting hides what was there."""

    @classmethod
    def name(cls) -> str:
        return "webloom_documents"

    def schema(self) -> str:
        return "filename string, url string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options["path"], schema.names, overwrite)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite, self.job = path, names, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Stages a task's documents; nothing of them is visible."""
        import pyarrow.parquet as pq

        attempt = uuid.uuid4().hex
        found, top = store(self.path)
        own = f"{top}/staged/{self.job}/{attempt}"
        found.create_dir(f"{own}/data", recursive=True)
        n = size = 0
        with found.open_output_stream(f"{own}/index.parquet") as raw, pq.ParquetWriter(raw, _INDEX) as index:
            held: list[tuple[str, str, int]] = []
            for batch in iterator:
                name, url, content = (batch.column(self.names.index(c)) for c in ("filename", "url", "content"))
                for i in range(batch.num_rows):
                    body = content[i].as_buffer() if content[i].is_valid else pa.py_buffer(b"")
                    with found.open_output_stream(f"{own}/data/{name[i].as_py()}") as out:
                        out.write(body)
                    held.append((name[i].as_py(), url[i].as_py(), body.size))
                    n, size = n + 1, size + body.size
                    if len(held) >= HELD:
                        index.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _INDEX, strict=True)], schema=_INDEX))
                        held = []
            if held:
                index.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _INDEX, strict=True)], schema=_INDEX))
        return Staged(attempt, n, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Moves the attempts that count, then makes them visible by one file. What others staged goes."""
        done = [m for m in messages if isinstance(m, Staged) and m.documents]
        found, top = store(self.path)
        for folder in ("data", "index"):
            found.create_dir(f"{top}/{folder}", recursive=True)
        for m in done:
            found.move(f"{top}/staged/{self.job}/{m.attempt}/data", f"{top}/data/{m.attempt}")
            found.move(f"{top}/staged/{self.job}/{m.attempt}/index.parquet", f"{top}/index/{m.attempt}.parquet")
        number = max((int(f.base_name.removesuffix(".json")) for f in files(self.path, "commits")), default=0) + 1
        manifest = {"number": number, "overwrite": self.overwrite, "documents": sum(m.documents for m in done), "bytes": sum(m.bytes for m in done), "attempts": [m.attempt for m in done]}
        put(self.path, f"commits/{number:08d}.json", json.dumps(manifest).encode())
        self._clear(found, top)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Leaves what is visible as it was. A task that is being stopped may stage more after this; see ``tidy``."""
        found, top = store(self.path)
        self._clear(found, top)

    def _clear(self, found, top: str) -> None:
        from pyarrow import fs

        if found.get_file_info(f"{top}/staged/{self.job}").type != fs.FileType.NotFound:
            found.delete_dir(f"{top}/staged/{self.job}")


def save(df: DataFrame, folder: str, order: Column | None = None, disposition: str | None = None, overwrite: bool = False) -> None:
    """Successful downloads (url, status, content, ...) as files of ``folder``, a URI that all executors reach.

    Of those that get one name the last in ``order`` (by default in that of the URLs) is written, after which a later
    call's file of that name wins. Null contents are empty files; rows of null url are left out.
    """
    df.sparkSession.dataSource.register(Documents)
    named = document_names(df.where("status = 200 AND url IS NOT NULL"), disposition=disposition).withColumn("_order", F.col("url") if order is None else order)
    last = named.groupBy("filename").agg(F.max_by(F.struct("url", "content"), F.struct("_order", "url")).alias("x")).select("filename", "x.url", "x.content")
    last.write.format("webloom_documents").mode("overwrite" if overwrite else "append").save(folder)


def tidy(folder: str) -> None:
    """Deletes what failed jobs have staged. For when no job writes to the folder."""
    from pyarrow import fs

    found, top = store(folder)
    if found.get_file_info(f"{top}/staged").type != fs.FileType.NotFound:
        found.delete_dir_contents(f"{top}/staged")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(number, overwrite, documents, bytes, attempts) of each job that was committed."""
    if not files(folder, "commits"):
        return spark.createDataFrame([], "number long, overwrite boolean, documents long, bytes long, attempts array<string>")
    return spark.read.schema("number long, overwrite boolean, documents long, bytes long, attempts array<string>").json(f"{folder}/commits")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, url, bytes, number, attempt) of the documents that are there: of each name that of the last job."""
    made = commits(spark, folder)
    if not files(folder, "index"):
        return spark.createDataFrame([], "filename string, url string, bytes long, number long, attempt string")
    since = made.agg(F.coalesce(F.max(F.when(F.col("overwrite"), F.col("number"))), F.lit(0)).alias("since"))  # one row
    live = made.crossJoin(F.broadcast(since)).where("number >= since").select("number", F.explode("attempts").alias("attempt"))
    rows = spark.read.schema("filename string, url string, bytes long").parquet(f"{folder}/index").withColumn("attempt", F.regexp_extract(F.input_file_name(), r"([0-9a-f]{32})\.parquet$", 1))
    every = rows.join(live, "attempt")
    return every.groupBy("filename").agg(F.max_by(F.struct("url", "bytes", "number", "attempt"), "number").alias("x")).select("filename", "x.*")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, url, content) of the documents that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, top = store(folder)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                b = batch.slice(a, 64)
                content = []
                for name, attempt in zip(b["filename"].to_pylist(), b["attempt"].to_pylist(), strict=True):
                    with found.open_input_stream(f"{top}/data/{attempt}/{name}") as raw:
                        content.append(raw.read())
                yield pa.RecordBatch.from_arrays([b["filename"], b["url"], pa.array(content, pa.binary())], ["filename", "url", "content"])

    return listing(spark, folder).select("filename", "url", "attempt").mapInArrow(run, "filename string, url string, content binary")
