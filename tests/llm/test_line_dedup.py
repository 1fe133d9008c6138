import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from wattloom.llm import line_dedup
from wattloom.llm.common import Scratch
from wattloom.llm.line_dedup import OP12_SQL, Cuckoo, LineIndex, op12_line_dedup

SCHEMA = "doc_id long, text string, pos int, k1 string, own_id int"


def plain(rows):
    """The contract, a line at a time."""
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    last, held = 1 << 63, {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= 10 and len(held[key(x)]) > 1 and (last if i is None else i) != min(held[key(x)]) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def some(seed, first, n):
    rng = random.Random(seed)
    common = [f"common line number {k}" for k in range(40)] + ["  A Line With Blanks\t", "a line with blanks", "ÄÖÜ ärger über", "ÄÖÜ ÄRGER ÜBER", "short", "0123456789", "012345678", "é" * 9, "é" * 10, "\x0bquite long enough\x0c", "quite long enough\r", " quite long enough", ""]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.random()}" for _ in range(rng.randrange(8))]
        rows.append((first + i, "\n".join(["the licence line of all", *lines])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)


def result(index, docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in index.dedup(docs).collect()), key=str)


ODD = [(None, "the licence line of all\nonly here, twice\nonly here, twice"), (None, "another without an id\ncommon line number 3"), (5000, None), (5001, ""), (5002, "\n\n"), (5003, "only in here, twice\nonly in here, twice"), (5004, "a repeated row\nthe licence line of all"), (5004, "a repeated row\nthe licence line of all"), (5005, "one id, two texts"), (5005, "one id, two texts\nmore of it"), (5006, "long line " * 100_000 + "\n" * 3000), (5007, "long line " * 100_000)]


def test_like_plain(spark):
    rows = some(1, 0, 300) + ODD
    docs = table(spark, rows)
    assert result(LineIndex(Scratch(spark, "t")).insert(docs), docs) == plain(rows)


@pytest.mark.parametrize("keys, generations", [(1 << 16, 8), (40, 1)])
def test_insertions_and_deletions(spark, monkeypatch, keys, generations):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(line_dedup, "GENERATIONS", generations)
    first, second = some(1, 1000, 60), some(2, 0, 200) + ODD
    index = LineIndex(Scratch(spark, "t")).insert(table(spark, first))
    both = index.insert(table(spark, second))
    rows = first + second
    assert result(both, table(spark, rows)) == plain(rows)
    assert result(index, table(spark, first)) == plain(first)  # the state before is still there
    gone = {i for i, _ in rows if i is None or i % 3 == 0}
    less = both.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert result(less, table(spark, left)) == plain(left)
    again = less.insert(table(spark, [r for r in rows if r[0] in gone]))
    assert result(again, table(spark, rows)) == plain(rows)
    want = {(r.k1, r.k2, r.n, r.least, r.greatest) for r in both.current().collect()}
    assert {(r.k1, r.k2, r.n, r.least, r.greatest) for r in again.current().collect()} == want


def test_filter_copies():
    rng = np.random.default_rng(3)
    k1, k2 = rng.integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    copies = rng.integers(1, 3, 20_000)
    found = Cuckoo.of(k1, k2, copies)
    assert (found.count(k1, k2) >= copies).all()
    assert (found.table != 0).sum() == copies.sum() and found.table.size < 3 * copies.sum()
    other = rng.integers(0, 1 << 64, (2, 20_000), dtype=np.uint64)
    assert (found.count(*other) > 0).mean() < 0.001
    found.remove(np.repeat(k1[:9000], copies[:9000]), np.repeat(k2[:9000], copies[:9000]))
    assert (found.table != 0).sum() == copies[9000:].sum()
    assert (found.count(k1[9000:], k2[9000:]) >= copies[9000:]).all() and (found.count(k1[:9000], k2[:9000]) > 0).mean() < 0.001
    with pytest.raises(ValueError):
        found.remove(*other)
    full = Cuckoo(4)
    assert not full.insert(k1[:17], k2[:17])


def test_filters_spare_lookups(spark):
    scratch = Scratch(spark, "t")
    index = LineIndex(scratch).insert(table(spark, some(1, 0, 50)))
    new = line_dedup.references(table(spark, [(900, f"never seen {k}\nthe licence line of all") for k in range(500)])).select("k1", "k2").distinct()
    assert 1 <= index.probe(new, 1).count() <= 3


def test_empty_table(spark):
    docs = table(spark, [])
    assert result(LineIndex(Scratch(spark, "t")).insert(docs), docs) == []


def test_sql(spark, tmp_path):
    rows = [r for r in some(4, 0, 200) + ODD if r[0] is None or r[0] < 5006]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op12_line_dedup(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == got == plain(rows)
