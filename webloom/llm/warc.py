"""WARC archives: a writer of one gzip member a record, and a reader that salvages damaged archives.

The reader checks each record as it goes: version line, header, length, end of record, block and payload digests,
and a member's own checksum. After a failed check it searches on, from the byte after the failed start, for the next
gzip member or version line that begins a valid record, goes on from there, and gives the bytes between as a
quarantined gap. An archive is read by one task as a stream, so memory is bounded by a window and the longest
record; archives are rolled at ROLL bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import Scratch, quoted

#: Bytes of an archive before the next one is begun, of a read, of a header at most, and of rows sent on at once.
ROLL, BLOCK, HEADER, ROWS = 64 << 20, 1 << 20, 1 << 26, 4 << 20
#: Payloads of fewer bytes are never written as revisits.
LEAST = 100
#: Fixed values of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Stores that executors read as streams; archives of others come through Spark's reader of binary files.
STREAMED = ("file", "hdfs")

_SCANNED = "file string, start long, end long, type string, record_id string, target_uri string, refers_to string, headers map<string,string>, payload binary, declared_bytes long, fault string"


class Bad(ValueError):
    """A record that fails a check."""


# Writing


def _field(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def record(kind: str, record_id: str, uri: str, date: str, digest: str, payload: bytes, size: int, more: dict[str, str]) -> bytes:
    """One record. Its block is an HTTP answer; that of a revisit has the head alone, with the length of the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": _field(uri), "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | more).items() if v != "")
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """``raw`` as a gzip member of its own."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(raw) + made.flush()


def _store(path: str):
    """(file system, path) of a URI, as seen from a task."""
    from pyarrow import fs

    if re.match(r"file:|/", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", path).lstrip("/")
    return fs.FileSystem.from_uri(path)


def _written(folder: str, date: str, zipped: bool, roll: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, top = _store(folder)
        store.create_dir(f"{top}/_attempts/{attempt}", recursive=True)
        out, size, n, done = None, 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"_attempts/{attempt}/{len(done):04d}", f"part-{part:05d}-{len(done):04d}.warc{'.gz' if zipped else ''}", size, n))
            out = None

        for batch in batches:
            for page, uri, payload, digest, first, first_uri in zip(*(c if c.type == pa.binary() else c.to_pylist() for c in batch.columns), strict=True):
                raw = payload.as_py() or b""
                name = lambda i, d=digest: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{i} {d}')}>"
                more = {"Page-Id": "" if page is None else str(page)}
                if first is not None:
                    more |= {"WARC-Refers-To": name(first), "WARC-Refers-To-Target-URI": _field(first_uri or ""), "WARC-Profile": REVISIT}
                made = record("response" if first is None else "revisit", name(page), uri or "", date, digest, raw, len(raw), more)
                made = member(made) if zipped else made
                if out is not None and size + len(made) > roll:
                    close()
                if out is None:
                    out, size, n = store.open_output_stream(f"{top}/_attempts/{attempt}/{len(done):04d}"), 0, 0
                out.write(made)
                size, n = size + len(made), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["written", "file", "bytes", "records"])

    return run


def _moved(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _store(folder)
        for batch in batches:
            for own, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if store.get_file_info(f"{top}/{own}").type != fs.FileType.NotFound:  # else an earlier try has moved it
                    store.move(f"{top}/{own}", f"{top}/{file}")
            yield batch.select(["file", "bytes", "records"])

    return run


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", zipped: bool = True, roll: int = ROLL, least: int = LEAST) -> DataFrame:
    """A record of each row, in new archives of ``folder`` (a URI that all executors reach); (file, bytes, records) of each archive.

    The payload is the text in UTF-8; null is empty. Of rows with equal payloads of ``least`` bytes or more that of
    the smallest id is a response, and so are rows that repeat its id; the others are revisits that refer to it. Rows
    of null id revisit one that has an id, or are responses where none has. An id that is no whole number is refused
    with an error; URLs are written on one line, whatever their length. Payloads are told apart by their SHA-256.
    Bodies are shuffled only where there are more groups of copies than Spark broadcasts. Tasks write below
    _attempts, and only what tasks that succeeded have written is moved into place, so that lost executors and
    repeated tasks leave no record twice. A table without rows makes no archive.
    """
    body = F.coalesce(F.col(quoted(html)).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("id"), F.col(quoted(url)).cast("string").alias("uri"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    copies = rows.where(F.octet_length("body") >= least).groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "uri"))).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    # Written first: a join of two plain shuffles is split where one payload holds many rows.
    own = Scratch(pages.sparkSession, "warc-manifest")
    copies = own.save(copies.select(F.col("digest").alias("same"), "first"), "copies")
    told = rows.join(copies, rows["digest"] == copies["same"], "left")
    other = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    told = told.select("id", "uri", "body", "digest", F.when(other, F.col("first.id")).alias("first"), F.when(other, F.col("first.uri")).alias("first_uri"))
    top = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(pages.sparkSession._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(top)
    manifest = own.save(told.mapInArrow(_written(folder, date, zipped, roll), "written string, file string, bytes long, records long"), "written")
    done = own.save(manifest.mapInArrow(_moved(folder), "file string, bytes long, records long"), "files")
    own.drop("written", "copies")
    store.delete(pages.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/_attempts"), True)
    return done


# Reading


class Window:
    """Bytes of an archive by offset, of which one block is held."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at, self.size, self.at, self.data = read_at, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if not (self.at <= pos and pos + n <= self.at + len(self.data)):
            self.at, self.data = pos, self.read_at(min(max(n, BLOCK), self.size - pos), pos)
        return self.data[pos - self.at : pos - self.at + n]

    def search(self, pos: int) -> int:
        """Where the next member or version line may begin, or the end."""
        while pos < self.size:
            data = self.get(pos, BLOCK)
            if found := _START.search(data):
                return pos + found.start()
            if pos + len(data) >= self.size:
                return self.size
            pos += len(data) - 9  # a version line may lie across blocks
        return self.size


class Stream:
    """The bytes of records from ``pos``: of a gzip member, or as they are."""

    def __init__(self, window: Window, pos: int) -> None:
        self.window, self.pos, self.held = window, pos, b""
        self.zipped = window.get(pos, 2) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None
        self.step, self.last, self.broken = 1 << 13, 0, False

    def up_to_fault(self, before, raw: bytes) -> bytes:
        """What a damaged stretch still gives, byte by byte: records before the damage may be whole."""
        self.broken, out = True, []
        try:
            for i in range(len(raw)):
                out.append(before.decompress(raw[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(out)

    def more(self) -> bool:
        """Takes up some more bytes; False at the end of the member or of the archive."""
        while True:
            if self.broken:
                raise Bad("member damaged")
            if self.zipped and self.inflate.eof:
                return False
            raw = self.window.get(self.pos, self.step)
            if not raw:
                if self.zipped:
                    raise Bad("member cut off")
                return False
            self.step, self.last = min(2 * self.step, 1 << 18), len(raw)
            self.pos += len(raw)
            if not self.zipped:
                self.held += raw
                return True
            before = self.inflate.copy()
            try:
                data = self.inflate.decompress(raw)
            except zlib.error:
                data = self.up_to_fault(before, raw)
            if self.inflate.eof:
                self.pos -= len(self.inflate.unused_data)
            if data:
                self.held += data
                return True

    def head(self) -> bytes:
        """Up to the blank line that ends a header."""
        seen = 0
        while True:
            if not b"WARC/1.".startswith(self.held[:7]):
                raise Bad("no version line")
            end = self.held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(self.held)
            if end >= 0:
                out, self.held = self.held[: end + 4], self.held[end + 4 :]
                return out
            if len(self.held) > HEADER or not self.more():
                raise Bad("no end of header")

    def exactly(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self.more():
                raise Bad("record cut off")
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def ended(self) -> bool:
        """Whether nothing follows; a member's checksum is then known to hold."""
        return not self.held and not self.more()

    def offset(self) -> int:
        """Of the archive's bytes the first behind the records read; within a member, one before that."""
        if self.zipped:
            return self.pos if self.inflate.eof else self.pos - self.last
        return self.pos - len(self.held)


def _digest_holds(said: str, data: bytes) -> bool:
    """Whether a labelled digest, in hex or base 32, is that of ``data``; one of an unknown kind is not held against it."""
    kind, _, value = said.partition(":")
    if kind.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    made = hashlib.new(kind.lower().replace("-", ""), data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def one_record(stream: Stream) -> tuple[dict[str, str], bytes | None, int | None]:
    """(header, payload, declared length of the payload) of the next record; Bad if it fails a check."""
    head = stream.head()
    lines = re.sub(rb"\r\n[ \t]+", b" ", head[:-4]).split(b"\r\n")
    if not _VERSION.fullmatch(lines[0] + b"\r\n"):
        raise Bad("no version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Bad("header damaged")
        fields[name.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size) or not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Bad("header damaged")
    if not stream.zipped and int(size) + 4 > stream.window.size - stream.offset():
        raise Bad("record cut off")
    block = stream.exactly(int(size))
    if stream.exactly(4) != b"\r\n\r\n":
        raise Bad("no end of record")
    if "warc-block-digest" in fields and not _digest_holds(fields["warc-block-digest"], block):
        raise Bad("block digest")
    payload, declared = block, None
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if found := re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})", http):
            declared = int(found[1])
    if fields["warc-type"] == "revisit":
        payload = None
    elif "warc-payload-digest" in fields and not _digest_holds(fields["warc-payload-digest"], payload):
        raise Bad("payload digest")
    return fields, payload, len(payload) if payload is not None else declared


def salvaged(window: Window) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, int | None, str | None]]:
    """(start, end, header, payload, declared length, fault) of each record and each gap, in order; they cover all bytes.

    A gap has no header, and the reason of the first check that failed in it. Records of one member share its
    offsets; of a member that is damaged behind some records, the gap begins about where they end.
    """
    pos, gap, fault = 0, None, None
    while pos < window.size:
        stream, good, last = Stream(window, pos), pos, False
        try:
            while not last:
                found = one_record(stream)
                last = stream.ended() if stream.zipped else True
                good = max(pos + 1, stream.offset())
                if gap is not None:
                    yield gap, pos, None, None, None, fault
                    gap = None
                yield pos, good, *found, None
            pos = good
        except Bad as why:
            if gap is None:
                gap, fault = good, str(why)
            pos = window.search(max(good, pos + 1))
    if gap is not None:
        yield gap, window.size, None, None, None, fault


def _rows(file: str, window: Window) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string())
    names = ["file", "start", "end", "type", "record_id", "target_uri", "refers_to", "headers", "payload", "declared_bytes", "fault"]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    for start, end, fields, payload, declared, fault in salvaged(window):
        get = (fields or {}).get
        held.append((file, start, end, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-refers-to"), None if fields is None else list(fields.items()), payload, declared, fault))
        size += len(payload or b"") + 512
        if size > ROWS:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, place = _store(path)
            with store.open_input_file(place) as file:
                yield from _rows(path, Window(lambda n, at, f=file: f.read_at(n, at), file.size()))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_buffer()
            yield from _rows(path, Window(lambda n, at, b=raw: b.slice(at, n).to_pybytes(), raw.size))


def salvage(spark: SparkSession, path: str, streamed: bool | None = None) -> DataFrame:
    """(file, start, end, type, record_id, target_uri, refers_to, headers, payload, declared_bytes, fault) of archives.

    ``path`` is an archive, a folder or a pattern; archives may be zipped by record, whole or not at all, whatever
    their names. Rows with a ``fault`` are gaps and have nothing else but file, start and end. Names of headers are
    in lower case. The payload is what follows the HTTP head, as it was sent, or the block where there is none, and
    null for revisits; declared_bytes is its length, for revisits that of the head. Empty archives give no row.
    ``streamed``: by executors, in bounded memory, or else whole through Spark, which reads any store (by default as
    the store of ``path`` allows).
    """
    if streamed is None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        streamed = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme() in STREAMED
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path").mapInArrow(_streamed, _SCANNED) if streamed else files.select("path", "content").mapInArrow(_held, _SCANNED)


def records(scanned: DataFrame) -> DataFrame:
    """The valid records that ``salvage`` has found."""
    return scanned.where("fault IS NULL").drop("fault")


def quarantined(scanned: DataFrame) -> DataFrame:
    """(file, start, end, fault) of each gap."""
    return scanned.where("fault IS NOT NULL").select("file", "start", "end", "fault")


def log_gaps(scanned: DataFrame, path: str) -> None:
    """Appends the gaps to a log of JSON lines."""
    quarantined(scanned).write.mode("append").json(path)


def resolved(scanned: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, found) of each response and revisit.

    Revisits take length and digest from the response that they refer to; where it is lost (``found`` false, and
    refers_to null) from what their own header says. What is read is kept without payloads in the shared scratch folder, so that
    archives are read once.
    """
    own = Scratch(scanned.sparkSession, "warc-read")
    said = F.regexp_extract(F.get(F.split(F.col("headers")["warc-payload-digest"], ":"), F.lit(1)), "^[0-9a-fA-F]{64}$", 0)
    got = records(scanned).where("type IN ('response', 'revisit')").select(
        F.col("headers")["page-id"].cast("long").alias("page_id"), F.col("type").alias("record_type"), "record_id", "refers_to", F.col("declared_bytes").alias("bytes"),
        F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.lower(said)).alias("digest"),
    )
    got = own.save(got, "read")
    answers = got.where("record_type = 'response'").groupBy(F.col("record_id").alias("answer")).agg(F.min("page_id").alias("of"), F.min("bytes").alias("of_bytes"), F.min("digest").alias("of_digest"))
    answers = own.save(answers, "answers")  # as above: the revisits of one response may be many
    own_rows = got.where("record_type = 'response'").select("page_id", "record_type", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("found"))
    both = got.where("record_type = 'revisit'").join(answers, F.col("refers_to") == F.col("answer"), "left")
    return own_rows.unionByName(both.select("page_id", "record_type", F.coalesce("of_bytes", "bytes").alias("payload_bytes"), F.coalesce("of_digest", "digest").alias("payload_digest"), F.col("of").alias("refers_to"), F.col("answer").isNotNull().alias("found")))
