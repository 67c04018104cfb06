"""WARC archives: a writer, and a reader that salvages what damage leaves.

Each written record is one gzip member (or, uncompressed, one run of bytes); a member that is
read may hold several.  The reader checks a member's checksum, the version line, the header
block, the content length and the block digest (SHA-1 in base32 or hexadecimal, either case).
Where a check fails it searches for the next place from which a valid member (or version line)
reads, goes on there, and logs the bytes between as a quarantined gap.

An archive is one task, read forwards in steps of a few megabytes: a worker holds a step and
one record, whatever the archive's size.  Only from stores that PyArrow can't open does an
archive come whole, by Spark's binary source, and has to fit a row.  A writer starts a new
file at ``_FILE_BYTES``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.common import release, scratch, slices, written

_FILE_BYTES = 32 << 20
_SEND_ROWS = 500_000  # of 17 bytes
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_EITHER = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_BLANK = re.compile(rb"\r\n\r\n")
_MAGIC = b"\x1f\x8b\x08"
_STEP = 4 << 20  # bytes of an archive read at a time
_HEADER_BYTES = 1 << 20  # a longer header block is damage
_DATE = "1970-01-01T00:00:00Z"  # written records carry no clock, so reruns agree


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One uncompressed record."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", "sha1:" + sha1_base32(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def http(payload_bytes: int, body: bytes) -> bytes:
    """A response as captured; a revisit has the header only, with the full payload's length."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + body


class Damage(ValueError):
    pass


class Bytes:
    """An archive's bytes by place; here wholly in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def part(self, a: int, b: int) -> bytes:
        return self.data[a:b]

    def find(self, what: re.Pattern, at: int, end: int | None = None) -> int:
        """Where the first match begins that begins at ``at`` or later (and before ``end``), or -1."""
        m = what.search(self.data, at, self.size if end is None else min(self.size, end))
        return m.start() if m else -1


class Stream(Bytes):
    """The same of an open file, of which a few steps are held."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.held: dict[int, bytes] = {}

    def part(self, a: int, b: int) -> bytes:
        b = min(b, self.size)
        if b - a > 2 * _STEP:
            return bytes(self.file.read_at(b - a, a))
        out = []
        while a < b:
            k = a // _STEP
            if k not in self.held:
                while len(self.held) > 3:
                    del self.held[next(iter(self.held))]
                self.held[k] = bytes(self.file.read_at(min(_STEP, self.size - k * _STEP), k * _STEP))
            out.append(self.held[k][a - k * _STEP : b - k * _STEP])
            a += len(out[-1])
        return b"".join(out)

    def find(self, what: re.Pattern, at: int, end: int | None = None) -> int:
        end = self.size if end is None else min(end, self.size)
        step = 4096
        while at < end:
            stop = min(end, at + step)
            m = what.search(self.part(at, stop))
            if m:
                return at + m.start()
            if stop == end:
                return -1
            at, step = stop - 16, min(8 * step, _STEP)  # 16: more than what is sought
        return -1


def _number(text: str) -> int:
    if not (text.isascii() and text.isdigit() and len(text) <= 18):
        raise Damage("no content length")
    return int(text)


def _same_digest(stated: str, block: bytes) -> bool:
    name, _, value = stated.partition(":")
    if name.strip().lower() != "sha1":
        return True  # of another kind: not checked
    value, digest = value.strip(), hashlib.sha1(block).digest()
    return value.lower() == digest.hex() if len(value) == 40 else value.upper() == base64.b32encode(digest).decode()


def parse(data: Bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers with lower-case names, block, end) of the record at ``at``, all checks passed."""
    if not _VERSION.match(data.part(at, at + 10)):
        raise Damage("no version line")
    close = data.find(_BLANK, at + 8, at + _HEADER_BYTES)
    if close < 0:
        raise Damage("header without end")
    headers: dict[str, str] = {}
    name = ""
    for line in data.part(at + 10, close).split(b"\r\n") if close > at + 10 else []:
        text = line.decode("utf-8", "replace")
        if name and text[:1] in (" ", "\t"):  # a folded line goes on
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Damage("header line without colon")
        name = name.strip().lower()
        headers[name] = value.strip()
    start = close + 4
    end = start + _number(headers.get("content-length", ""))
    if end + 4 > data.size or data.part(end, end + 4) != b"\r\n\r\n":
        raise Damage("block of another length")
    block = data.part(start, end)
    if not _same_digest(headers.get("warc-block-digest", ""), block):
        raise Damage("block digest differs")
    return headers, block, end + 4


def _inflate(data: Bytes, at: int) -> tuple[bytes, int]:
    z, out = zlib.decompressobj(31), []
    while not z.eof:  # in small steps, as what follows the member is copied
        step = data.part(at, at + 65536)
        if not step:
            raise Damage("gzip member without end")
        try:
            out.append(z.decompress(step))
        except zlib.error as e:
            raise Damage(f"gzip: {e}") from None
        at += len(step)
    return b"".join(out), at - len(z.unused_data)


def _member(data: Bytes, at: int) -> tuple[Bytes, int]:
    """The bytes of the sound gzip member at ``at``, which holds a record at least, and its end."""
    out, end = _inflate(data, at)
    inner = Bytes(out)
    try:
        parse(inner, 0)
    except Damage:
        if all(x[0] == "gap" for x in salvage(inner, False)):
            raise
    return inner, end


def salvage(data: bytes | Bytes, members: bool = True) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason, None), in order, without overlap.

    What one gzip member holds, records and gaps, has the member's start and end.  Without
    ``members``, no gzip is looked for.
    """
    data = Bytes(data) if isinstance(data, (bytes, bytearray)) else data
    begins = _EITHER if members else _VERSION
    at = 0
    while at < data.size:
        try:
            if members and data.part(at, at + 3) == _MAGIC:
                inner, end = _member(data, at)
                for kind, _, _, x, block in salvage(inner, False):
                    yield kind, at, end, x, block
            else:
                headers, block, end = parse(data, at)
                yield "record", at, end, headers, block
            at = end
            continue
        except Damage as e:
            reason = str(e)
        seek = data.find(begins, at + 1)
        while seek >= 0:
            try:
                _member(data, seek) if data.part(seek, seek + 3) == _MAGIC else parse(data, seek)
                break
            except Damage:
                seek = data.find(begins, seek + 1)
        seek = seek if seek >= 0 else data.size
        yield "gap", at, seek, reason, None
        at = seek


_ROW = "file string, kind string, start long, end long, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, reason string"
_SCHEMA = pa.schema(
    [("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
     ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("reason", pa.string())]
)
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})(?!\d)", re.IGNORECASE)


def _payload(kind: str, block: bytes) -> tuple[int, bytes | None]:
    """The full payload's length, and the payload where the record has it."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not (found and head.startswith(b"HTTP/")):
        return len(block), block
    stated = _LENGTH.search(head)
    return (int(stated[1]) if kind == "revisit" and stated else len(body)), (None if kind == "revisit" else body)


def _openable(path: str) -> bool:
    """Can PyArrow open the store of ``path``?"""
    try:
        _opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _opened(path: str):
    from pyarrow.fs import FileSystem

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return FileSystem.from_uri(path if "://" in path else "file://" + path)


def _rows(file: str, data: Bytes) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for kind, start, end, x, block in salvage(data):
        if kind == "gap":
            rows.append((file, kind, start, end, None, None, None, None, None, None, None, x))
            continue
        type_ = x.get("warc-type", "")
        n, payload = _payload(type_, block)
        rows.append((file, kind, start, end, type_, x.get("warc-record-id"), x.get("warc-refers-to"), x.get("warc-target-uri"), x.get("warc-payload-digest"), n, payload, None))
        size += len(block)
        if size > _STEP or len(rows) >= 10_000:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path`` (kind: record or gap), one row each.

    An empty file gives no rows; a file of noise gives one gap.  Records that repeat or tie in
    id are rows each; headers that a record lacks are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                store, name = _opened(file)
                with store.open_input_file(name) as f:
                    yield from _rows(file, Stream(f))
        release()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield from _rows(file, Bytes(content.as_py() or b""))
        release()

    # without the content column, Spark's source lists files and reads none
    return files.select("path").mapInArrow(streamed, _ROW) if _openable(path) else files.select("path", "content").mapInArrow(whole, _ROW)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = 0, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, response_id, is_response) by page.

    Of equal payloads of at least ``least_bytes`` bytes, the largest id is the response;
    null ids come last, and among rows of one id, one is the response.  Digests, not
    payloads, meet in the aggregation, which combines on the map side.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()))
    least = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "digest", "rid")
    best = least.groupBy("digest").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "rid")).alias("best"), F.count("*").alias("n"))
    twice = written(best.where("n > 1").select("digest", F.col("best.page_id").alias("response_id"), F.col("best.rid").alias("response_rid")))
    # ids and digests meet; payloads move only where the revisits are too many to send, and then by row, so no digest is hot
    again = least.select("rid", "digest").join(twice, "digest").where("rid <> response_rid")
    again = written(again.select("rid", "response_id", F.lit(False).alias("is_response")), twice)
    out = rows.join(F.broadcast(again) if again.count() <= _SEND_ROWS else again, "rid", "left")
    return out.withColumn("is_response", F.coalesce("is_response", F.lit(True))).drop("rid")


def write(pages: DataFrame, path: str, least_bytes: int = 0, compress: bool = True, **names) -> DataFrame:
    """Write one record per page under ``path``; (file, records, bytes) by archive file.

    A task writes files of its own name, each under a temporary name until it is whole, so
    a task that runs again replaces what a lost one left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        store, folder = FileSystem.from_uri(path) if "://" in path else FileSystem.from_uri("file://" + path)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        open_ = None

        def close() -> None:
            nonlocal open_
            if open_:
                stream, temporary, final, count, size = open_
                stream.close()
                store.move(temporary, final)
                done.append((final, count, size))
                open_ = None

        for b in (part for batch in batches for part in slices(batch)):
            for page_id, url, payload, size, digest, response_id, is_response in zip(*(c.to_pylist() for c in b.columns)):
                own = f"<urn:page:{'none' if page_id is None else page_id}>"
                head = [
                    ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "urn:none")),
                    ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"),
                ]
                if not is_response:
                    head += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", f"<urn:page:{'none' if response_id is None else response_id}>"),
                    ]
                data = record("response" if is_response else "revisit", head, http(size, bytes(payload) if is_response else b""))
                data = member(data) if compress else data
                if open_ and open_[4] + len(data) > _FILE_BYTES:
                    close()
                if not open_:
                    final = f"{folder}/part-{context.partitionId():05d}-{len(done):04d}.warc" + ".gz" * compress
                    temporary = f"{folder}/_{context.taskAttemptId()}-{len(done)}"
                    open_ = [store.open_output_stream(temporary, compression=None), temporary, final, 0, 0]
                open_[0].write(data)
                open_[3] += 1
                open_[4] += len(data)
        close()
        release()
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["file", "records", "bytes"])

    rows = with_revisits(pages, least_bytes, **names)
    return rows.select("page_id", "url", "payload", "payload_bytes", "digest", "response_id", "is_response").mapInArrow(run, "file string, records long, bytes long")


def round_trip(pages: DataFrame, least_bytes: int = 0, **names) -> DataFrame:
    """Write ``pages`` and read the archives back; one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  Null and empty pages
    have the empty payload; null urls are written as urn:none; null ids come back null and are
    a response only where no equal payload has an id.  Of rows that tie in payload and id, one
    is the response and the others revisit it.  Very long pages are a record each.  Other
    columns are not read, whatever their names.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch(spark) + "/warc"
    files = write(pages, path, least_bytes, **names)
    if not files.agg(F.sum("records").alias("n")).first()["n"]:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read(spark, path).where("kind = 'record'")

    def id_of(c: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as bigint)")

    return found.select(
        id_of("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", id_of("refers_to").alias("refers_to")
    )
