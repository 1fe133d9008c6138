import hashlib
import random

import pytest
from wattloom.llm.common import Scratch
from wattloom.llm.warc import GAP, MAGIC, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest int, least string"


def pages():
    rng = random.Random(4)
    record = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: 5" + GAP + "xxxxx" + GAP
    odd = [None, "", "é" * 60, "same " * 40, "same " * 40, "short", "short", MAGIC, MAGIC * 3, record, "a" * 200 + record + record + "tail", GAP, "\r\n" * 9, "x" + GAP + MAGIC, "W" * 400, "WARC/1.1" * 90, record[:-4], record + "\r\n", "big " * 300_000, MAGIC + "Content-Length: 999999999" + GAP]
    rows = [(100 - i, f"http://h/{i} x\n{i}", t, 1, "q") for i, t in enumerate(odd)]
    rows += [(1000 + i, None, "".join(rng.choice("ab\r\nWé ") for _ in range(rng.randrange(3000))), 1, "q") for i in range(300)]
    rows += [(3000 + i, "u", odd[10], 1, "q") for i in range(3)] + [(None, "u", odd[3], 1, "q"), (None, "u", "z" * 300, 1, "q")]
    return rows


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_round_trip(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    scratch = Scratch(spark, "t")
    path = scratch.path("warc")
    rows = pages()
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(3), path, scratch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in read_warc(spark, path, scratch, payloads=True).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    least = {}
    for i, _, t, *_ in rows:
        if t and len(t.encode()) >= 100 and i is not None:
            least[t] = min(i, least.get(t, i))
    want = []
    for i, _, t, *_ in rows:
        raw = (t or "").encode()
        refers = least.get(t) if least.get(t) not in (None, i) else None
        want.append((i if i is not None else -1, "revisit" if refers else "response", refers, len(raw), hashlib.sha256(raw).hexdigest(), None if refers else t or ""))
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or 0))


def test_empty_table(spark):
    scratch = Scratch(spark, "t")
    path = scratch.path("warc")
    write_warc(spark.createDataFrame([], SCHEMA), path, scratch)
    assert read_warc(spark, path, scratch).collect() == []


def records(spark, tmp_path, raw):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(raw)
    got = read_warc(spark, str(tmp_path / "a"), Scratch(spark, "t"), payloads=True).collect()
    return sorted((r.page_id, r.payload, r.payload_bytes, r.truncated) for r in got)


def record(page, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(block)}{GAP}".encode() + block + GAP.encode()


def test_bytes_of_no_record_are_no_payload(spark, tmp_path):
    raw = record(1, "é one".encode()) + record(2, b"second") + b"bytes that belong to no record" + GAP.encode()
    assert records(spark, tmp_path, raw) == [(1, "é one", 6, False), (2, "second", 6, False)]


def test_an_archive_cut_short_is_reported(spark, tmp_path):
    raw = record(1, b"first") + record(2, (MAGIC + "inside").encode()) + record(3, b"the third payload")
    assert records(spark, tmp_path, raw[:-9]) == [(1, "first", 5, False), (2, MAGIC + "inside", 16, False), (3, "the third pay"[:12], 12, True)]


def test_a_record_without_its_last_gap(spark, tmp_path):
    raw = record(1, b"first") + record(2, b"")
    assert records(spark, tmp_path, raw[: -len(GAP)]) == [(1, "first", 5, False), (2, "", 0, False)]


def test_scans_that_split_differently(spark):
    """Cores that come and go between two scans change the splits; no record may be lost by that."""
    scratch = Scratch(spark, "t")
    path = scratch.path("warc")
    html = lambda i: f"page {i} " + (MAGIC + "x" * 40 + record(i, b"inner").decode() if i % 5 == 0 else "y" * 4000)
    write_warc(spark.range(2000).coalesce(1).selectExpr("id as page_id", "'u' as url").join(spark.createDataFrame([(i, html(i)) for i in range(2000)], "page_id long, html string"), "page_id").repartition(3), path, scratch)
    conf = {"spark.sql.files.openCostInBytes": "65536", "spark.sql.files.minPartitionNum": "8"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        read = read_warc(spark, path, scratch)
        spark.conf.set("spark.sql.files.minPartitionNum", "12")
        got = {r.page_id: r.payload_digest for r in read.collect()}
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert got == {i: hashlib.sha256(html(i).encode()).hexdigest() for i in range(2000)}


def test_long_lengths(spark, tmp_path):
    raw = record(1, b"first") + record(2, b"cut short").replace(b"Content-Length: 28", b"Content-Length: 3000000000")
    assert b"3000000000" in raw
    assert records(spark, tmp_path, raw) == [(1, "first", 5, False), (2, "cut short" + GAP, 13, True)]
