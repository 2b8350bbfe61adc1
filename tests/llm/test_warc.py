from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

from cases import as_set

from sparkreel.llm import blocks, queries, warc

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def brute(rows):
    keep = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            keep[b] = max(p, keep.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        other = keep.get(b)
        revisit = other is not None and other != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=repr)


def cases():
    big, magic = "<p>text</p>" * 200, "\x1f\x08 not a member "
    rows = [(k, f"http://h{k % 3}.example/{k}", f"<html>{k}</html>" * (k * 7 % 300)) for k in range(80)]
    rows += [(200 + k, "http://c.example/", big) for k in range(30)] + [(300 + k, "u", "x" * n) for k, n in enumerate((998, 999, 1000, 1001, 999, 1000))]
    rows += [(400, None, None), (401, "a\r\nWARC-Type: fake", ""), (402, "é", "WARC/1.1\r\n\r\n" * 100), (403, "z", magic * 50_000), (None, "n", big), (None, "n", "y" * 2000), (404, "long", "abc" * 700_000), (200, "again", big)]
    return rows


def test_cases(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, keep string").repartition(3)
    assert as_set(warc.round_trip(df), *COLUMNS) == brute(rows)


def test_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert as_set(queries.op2_warc(spark, sf_dir), *COLUMNS) == brute(rows)


def test_any_split_gives_each_record_once(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = warc.write(df, f"{blocks.shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    texts = {(p, (h or "").encode()) for p, _, h in rows}
    for split in (700, 5_000, 1 << 30):
        got = warc.read(files, split=split).collect()
        assert sorted(map(repr, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(repr, brute(rows)))
        assert all(r.digest_ok for r in got)
        assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")


def test_files_are_gzip_and_damage_is_passed(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(50)], "page_id long, url string, html string").coalesce(1)
    path = warc.write(df, str(tmp_path)).first().path.removeprefix("file:")
    raw = open(path, "rb").read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 51
    at = [k for k in range(len(raw)) if raw[k : k + 3] == warc.MAGIC]
    broken = bytearray(raw)
    broken[at[10] + 30] ^= 0xFF
    (tmp_path / "broken.gz").write_bytes(broken)
    files = spark.createDataFrame([(str(tmp_path / "broken.gz"), len(broken))], "path string, bytes long")
    assert 45 <= warc.read(files, split=900).select("page_id").distinct().count() <= 50


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0


def test_foreign_records(spark, tmp_path):
    """Records of other writers: nothing in them stops the reader."""
    page = b"HTTP/1.0 200 OK\r\n\r\n<p>x</p>"
    sha = hashlib.sha1(b"<p>x</p>").hexdigest()
    b32 = base64.b32encode(bytes.fromhex(sha)).decode()

    def made(*fields, body=page):
        return gzip.compress(b"WARC/1.0\r\n" + b"".join(x.encode() + b"\r\n" for x in fields) + b"\r\n" + body + b"\r\n\r\n")

    n = f"Content-Length: {len(page)}"
    records = [
        (made("WARC-Type: response", n), ("response", 8, sha, None)),
        (made("warc-type:response", "content-LENGTH:many", f"WARC-Payload-Digest: sha1:{b32}"), ("response", 8, sha, True)),
        (made("WARC-Type: response", n, f"WARC-Payload-Digest: sha1:{sha.upper()}"), ("response", 8, sha, True)),
        (made("WARC-Type: response", n, "WARC-Payload-Digest: sha1:" + "A" * 32), ("response", 8, "0" * 40, False)),
        (made("WARC-Type: response", n, "WARC-Payload-Digest: md5:abc"), ("response", 8, "abc", None)),
        (made("WARC-Type: response", "Content-Length: -4", "X-Page-ID: seven"), ("response", 8, sha, None)),
        (made("WARC-Type: response", "Content-Length: 5", body=b"plain"), ("response", 5, hashlib.sha1(b"plain").hexdigest(), None)),
        (made("WARC-Type: revisit", "Content-Length: 0", body=b""), ("revisit", None, None, None)),
        (made("WARC-Type: revisit", "Content-Length: 0", "WARC-Payload-Digest: none", body=b""), ("revisit", None, None, None)),
        (made("WARC-Type: metadata", "Content-Length: 0", body=b""), None),
        (made("no colon here", "WARC-Type: response", n), ("response", 8, sha, None)),
    ]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(r for r, _ in records))
    size = (tmp_path / "f.warc.gz").stat().st_size
    for name in (str(tmp_path / "f.warc.gz"), f"file://{tmp_path}/f.warc.gz"):
        got = warc.read(spark.createDataFrame([(name, size)], "path string, bytes long"), split=200).collect()
        assert sorted(map(repr, ((r.record_type, r.payload_bytes, r.payload_digest, r.digest_ok) for r in got))) == sorted(repr(x) for _, x in records if x)


def test_a_common_payload(spark, monkeypatch):
    """A third of the pages share a payload: by broadcast payloads aren't shuffled, and by salt the copies are many tasks' work."""
    rows = [(k, f"u{k}", "same payload " * 100 if k % 3 == 0 else f"page {k} " * 150) for k in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert as_set(warc.round_trip(df), *COLUMNS) == brute(rows)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert as_set(warc.round_trip(df), *COLUMNS) == brute(rows)
    named = df.selectExpr("page_id", "url", "cast(html as binary) html", "sha1(html) digest")
    shared = named.groupBy("digest").agg({"page_id": "max"}).toDF("digest", "keep")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # so that small partitions stay apart
    try:
        joined = warc._joined(named, shared)
        plan = joined._jdf.queryExecution().toString().split("Physical Plan")[1]
        assert "_salt" in plan and joined.count() == 600
        sizes = joined.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert max(sizes) < 600 / 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
