"""Sinks: URL logs, quarantine of failed pages, document files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls


def append_log(df: DataFrame, url: str, path: str) -> None:
    """One URL per line, appended: the visited, downloaded and failed-page logs."""
    df.select(F.col(url).cast("string").alias("value")).where("value IS NOT NULL").write.mode("append").text(path)


def document_names(df: DataFrame, url: str = "url", disposition: str | None = None) -> DataFrame:
    """``df`` with the file name that each download gets."""
    return df.withColumn("filename", urls.filename(F.col(url), F.col(disposition) if disposition else None))


def collisions(named: DataFrame) -> DataFrame:
    """File names that more than one URL gets; the later download would overwrite the earlier."""
    return named.groupBy("filename").agg(F.count("*").alias("n_urls")).where("n_urls > 1")


def write_documents(df: DataFrame, path: str) -> None:
    """Successful downloads (status 200) as (filename, url, content), partitioned for later extraction."""
    document_names(df.where("status = 200")).select("filename", "url", "content").write.mode("overwrite").parquet(path)


def write_files(df: DataFrame, folder: str, order: Column | None = None) -> DataFrame:
    """Successful downloads as files of ``folder``, a URI that all executors reach; (filename, url, bytes) of each.

    Of the URLs that get one name the last in ``order`` (by default in that of the URLs) is written: it would have
    overwritten the others. A file is written under a name of its own and moved, so that a task may run twice.
    """
    named = document_names(df.where("status = 200")).withColumn("_order", F.col("url") if order is None else order)
    last = named.groupBy("filename").agg(F.max_by(F.struct("url", "content"), F.struct("_order", "url")).alias("x")).select("filename", "x.url", "x.content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("filename"), batch.column("content"), strict=True):
                own = f"{top}/._{uuid.uuid4().hex}"
                raw = content.as_buffer() if content.is_valid else pa.py_buffer(b"")
                with store.open_output_stream(own) as out:
                    out.write(raw)
                store.move(own, f"{top}/{name.as_py()}")
                sizes.append(raw.size)
            yield pa.RecordBatch.from_arrays([batch.column("filename"), batch.column("url"), pa.array(sizes, pa.int64())], ["filename", "url", "bytes"])

    return last.mapInArrow(run, "filename string, url string, bytes long")
