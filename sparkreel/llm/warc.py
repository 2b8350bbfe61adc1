"""WARC archives: a writer with payload deduplication and a splittable reader.

Writer. Every task writes its rows to one archive of its own, one gzip member per record,
in the shared folder. Of pages with equal payloads of MIN_DEDUP bytes or more, the one with
the largest page_id is a `response` record; the others are `revisit` records that refer to it
and hold no payload. The decision is a grouped maximum over payload digests, joined back.

Reader. Archives are cut into byte ranges of SPLIT bytes without regard to records. A task
scans its range for gzip magic, takes a position as a member only if the bytes there decode
to a WARC header, and owns the records that start inside its range; it reads the last one
past the end of the range. Members follow each other, so after one valid member the next is
tried where it ended, and only damage makes the task scan again. Damaged members are passed.

Files go through pyarrow's file systems (local paths, HDFS, object stores); a path without
scheme is where Spark itself would look for it. A retried writing task makes a new file; only files
that a finished task reports are read, from a table that is written once.

Defined cases: null html is an empty payload (always a response). A null url becomes
urn:page:<page_id>; line breaks in a url are escaped. Rows with a null page_id come back with
null; they revisit the largest page_id of their payload, or are responses if all are null.
Repeated page_ids get a record for each row, of the same kind. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import BROADCAST_ROWS
from .blocks import cut, qualified, shared_dir

MIN_DEDUP, SPLIT, SALT = 1000, 4 << 20, 32
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, bytes long, records long"
RECORDS = "page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean, payload binary"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The response or revisit record of a page."""
    revisit = refers_to is not None
    uri = (url if url is not None else f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return record("revisit" if revisit else "response", fields, http + (b"" if revisit else payload))


def _write(folder: str):
    def run(stream):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name, out, size, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for rb in stream:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size += out.write(info)
                size += out.write(page_record(page_id, url, html or b"", digest, refers))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return run


def _joined(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Pages with what is known of their digest, if several have it: by broadcast if that is small, so payloads aren't
    shuffled; else by digest and salt, so that pages of one digest are many tasks' work."""
    if shared.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(shared), "digest", "left")
    salted = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["digest", "_salt"], "left")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) into archives under folder; (path, bytes, records) of each."""
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.sha1("html"))
    shared = cut(rows.where(F.octet_length("html") >= MIN_DEDUP).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep"))
    named = _joined(rows, shared).select("page_id", "url", "html", "digest", F.when(~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep")).alias("refers_to"))
    return cut(named.mapInArrow(_write(folder), FILES))


class Range:
    """Bytes of a file from `start` on, read as they are needed."""

    def __init__(self, source, start: int, first: int):
        self.source, self.start = source, start
        source.seek(start)
        self.data, self.ended = bytearray(source.read(first)), False

    def need(self, upto: int) -> None:
        while len(self.data) < upto and not self.ended:
            more = self.source.read(max(1 << 16, upto - len(self.data)))
            self.ended = not more
            self.data += more


def member(r: Range, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at `at` if it is one of WARC, else None."""
    z, got, pos, step = zlib.decompressobj(31), bytearray(), at, 512
    try:
        while not z.eof:
            r.need(pos + step)
            part = bytes(r.data[pos : pos + step])
            if not part:
                return None
            got += z.decompress(part)
            pos += len(part)
            if len(got) >= 7 and not got.startswith(b"WARC/1."):
                return None
            step = 1 << 16
    except zlib.error:
        return None
    return (bytes(got), pos - len(z.unused_data)) if got.startswith(b"WARC/1.") else None


def members(r: Range, end: int):
    """Contents of the members that start before `end` (an offset in r)."""
    at = 0
    while at < end:
        found = member(r, at) if r.data[at : at + 3] == MAGIC else None
        if found is None:
            r.need(end + 2)
            at = r.data.find(MAGIC, at + 1, end + 2)
            if at < 0:
                return
            continue
        yield found[0]
        at = found[1]
        r.need(at + 3)


def _number(text: str | None) -> int | None:
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def _digest(text: str | None) -> str | None:
    """The value of a digest field, SHA-1 in lower-case hex whether it was written in base 32 or hex."""
    algorithm, colon, value = (text or "").strip().partition(":")
    if not colon:
        return None
    if algorithm.lower() == "sha1" and len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return value
    return value.lower() if algorithm.lower() == "sha1" else value


def parse(content: bytes) -> dict | None:
    """The row of a record, or None if it is neither response nor revisit.

    Foreign records are taken as they are: field names in any case, no or an unreadable length (the
    block is then the rest of the member), no HTTP head (the block is the payload), no digest
    (a response's is computed; digest_ok is null), a digest of another kind (digest_ok is null).
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    f = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if colon}
    kind = f.get("warc-type", "").lower()
    if kind not in ("response", "revisit"):
        return None
    size = _number(f.get("content-length"))
    block = rest.removesuffix(b"\r\n\r\n") if size is None or size < 0 else rest[:size]
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    named = f.get("warc-payload-digest")
    digest, ok = _digest(named), None
    if kind == "response":
        own = hashlib.sha1(payload).hexdigest()
        ok = own == digest if digest is not None and named.strip().lower().startswith("sha1:") else None
        digest = own if digest is None else digest
    elif digest is not None:
        ok = True
    return {"page_id": _number(f.get("x-page-id")), "record_type": kind, "uri": f.get("warc-target-uri"), "payload_bytes": len(payload) if kind == "response" else _number(f.get("x-payload-length")), "payload_digest": digest, "refers_to": _number(f.get("x-refers-to-page-id")), "digest_ok": ok, "payload": payload if kind == "response" else None}


_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary())])


def _read(with_payload: bool):
    schema = _SCHEMA if with_payload else pa.schema(list(_SCHEMA)[:-1])

    def run(stream):
        for rb in stream:
            for path, start, end in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as source:
                    rows, size = [], 0
                    for content in members(Range(source, start, end - start + (1 << 16)), end - start):
                        row = parse(content)
                        if row is not None:
                            rows.append(row)
                            size += len(content) if with_payload else 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read(files: DataFrame, with_payload: bool = True, split: int = SPLIT) -> DataFrame:
    """The response and revisit records of archives, from rows (path, bytes)."""
    total = files.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    local = qualified(files.sparkSession, "/").rstrip("/")  # of a path without scheme, as Spark resolves it
    path = F.when(F.col("path").startswith("/"), F.concat(F.lit(local), "path")).otherwise(F.col("path")).alias("path")
    ranges = files.where("bytes > 0").select(path, F.col("bytes"), F.explode(F.expr(f"sequence(0L, bytes - 1, {split}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end")).repartition(max(1, -(-total // split)), "path", "start")
    return ranges.mapInArrow(_read(with_payload), RECORDS if with_payload else RECORDS.rsplit(",", 1)[0])


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into archives in the shared folder and reads them back, without payloads."""
    spark: SparkSession = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder), with_payload=False)
