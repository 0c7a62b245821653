"""Pages of a mirrored site as a data source: planned partitions, columns and filters that reach the files, capped bodies.

A mirror deals pages to parts by the CRC-32 of their host and sorts each part by host. A scan lists the files of the
parts that hold the hosts asked for, plans partitions of some bytes, skips row groups by their statistics, reads the
columns asked for and cuts bodies as they are read.

Hosts and ids are options of a scan. Spark 4.1 can push filters to a source in Python as well, but keeps what was
pushed last with the relation, so that another query of the same DataFrame would read too little.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from webloom.config import DEFAULT
from webloom.functions import urls
from webloom.sources.stores import files, store

#: Bytes of files in a partition, and rows that are read at once.
SPLIT, ROWS = 32 << 20, 512
SCHEMA = "page_id long, host string, url string, html string, size long, cut boolean"


def mirror(pages: DataFrame, folder: str, parts: int = 64) -> None:
    """Writes pages (page_id, url, html) as a mirror of ``parts`` parts. Hosts are in lower case; a URL without one has ''."""
    host = F.coalesce(F.lower(urls.host(F.col("url"))), F.lit(""))
    dealt = pages.select("page_id", host.alias("host"), "url", "html").withColumn("part", (F.crc32(F.col("host").cast("binary")) % parts).cast("int"))
    dealt.repartition("part").sortWithinPartitions("part", "host", "page_id").write.partitionBy("part").option("parquet.block.size", 8 << 20).parquet(f"{folder}/parts={parts}")


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class Mirror(DataSource):
    """Format ``webloom_mirror``; options path, max_body, split, hosts (JSON), first and last (ids). A schema of some of the columns is read alone."""

    @classmethod
    def name(cls) -> str:
        return "webloom_mirror"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MirrorReader(schema, self.options)


class MirrorReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.path = schema.names, options["path"]
        self.max_body, self.split = int(options.get("max_body", DEFAULT.max_body_bytes)), int(options.get("split", SPLIT))
        self.hosts = {*json.loads(options["hosts"])} if "hosts" in options else None
        self.first, self.last = (int(options[x]) if x in options else None for x in ("first", "last"))

    def partitions(self) -> Sequence[Files]:
        """The files of the parts that the hosts are in, packed to partitions of ``split`` bytes."""
        out: list[list[str]] = []
        room = 0
        for file in files(self.path):
            *_, parts, part, _ = file.path.split("/")
            n, k = int(parts.removeprefix("parts=")), int(part.removeprefix("part="))
            if self.hosts is not None and k not in {zlib.crc32(h.encode()) % n for h in self.hosts}:
                continue
            if not out or file.size > room:
                out.append([])
                room = self.split
            out[-1].append(file.path)
            room -= file.size
        return [Files(x) for x in out]

    def _wanted(self, group) -> bool:
        """Whether a row group may hold a row that is asked for, by the least and greatest of its columns."""
        for i in range(group.num_columns):
            column = group.column(i)
            stats = column.statistics
            if stats is None or not stats.has_min_max:
                continue
            if column.path_in_schema == "host" and self.hosts is not None and not any(stats.min <= h <= stats.max for h in self.hosts):
                return False
            if column.path_in_schema == "page_id" and (self.first is not None and stats.max < self.first or self.last is not None and stats.min > self.last):
                return False
        return True

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition is None:  # what a task gets where there is no partition
            return
        found, _ = store(self.path)
        need = {n for n in self.names if n in ("page_id", "host", "url", "html")} | ({"html"} if {"size", "cut"} & {*self.names} else set())
        need |= ({"host"} if self.hosts is not None else set()) | ({"page_id"} if self.first is not None or self.last is not None else set())
        for path in partition.paths:
            with found.open_input_file(path) as raw:
                file = pq.ParquetFile(raw)
                groups = [i for i in range(file.metadata.num_row_groups) if self._wanted(file.metadata.row_group(i))]
                for batch in file.iter_batches(ROWS, row_groups=groups, columns=sorted(need) or ["page_id"]):
                    yield self._shaped(batch)

    def _shaped(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows and columns asked for, bodies cut."""
        keep = pa.array([True] * batch.num_rows)
        if self.hosts is not None:
            keep = pc.and_(keep, pc.is_in(batch["host"], pa.array(sorted(self.hosts), pa.string())))
        for x, holds in ((self.first, pc.greater_equal), (self.last, pc.less_equal)):
            if x is not None:
                keep = pc.and_(keep, pc.fill_null(holds(batch["page_id"], x), False))
        batch = batch.filter(keep)
        made = {n: batch[n] for n in batch.schema.names}
        if "html" in made:
            body = made["html"].cast(pa.binary())
            size = pc.binary_length(body)
            over = pc.greater(size, self.max_body)
            made["size"], made["cut"] = pc.cast(pc.min_element_wise(size, self.max_body, skip_nulls=False), pa.int64()), over
            if "html" in self.names and pc.any(over).as_py():
                made["html"] = pa.array([None if x is None else x[: self.max_body].decode("utf-8", "replace") for x in body.to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([made[n] for n in self.names], self.names)


def scan(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, hosts: Sequence[str] | None = None, first: int | None = None, last: int | None = None, max_body: int = DEFAULT.max_body_bytes, split: int = SPLIT) -> DataFrame:
    """(page_id, host, url, html, size, cut) of a mirror, or those ``columns`` alone.

    ``hosts`` leave out files, and ids from ``first`` to ``last`` row groups; a null id is in no such range. Bodies of
    more than ``max_body`` bytes are cut there, ``size`` is the bytes that are left and ``cut`` says so. A null body
    has a null size.
    """
    spark.dataSource.register(Mirror)
    whole = StructType.fromDDL(SCHEMA)
    reader = spark.read.format("webloom_mirror").schema(StructType([whole[c] for c in columns]) if columns else whole).option("max_body", max_body).option("split", split)
    for name, value in (("hosts", None if hosts is None else json.dumps([*hosts])), ("first", first), ("last", last)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(folder)
