import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from wattloom.llm import substring_dedup
from wattloom.llm.common import Scratch, load
from wattloom.llm.substring_dedup import remove_repeats, repeats, report
from wattloom.llm.suffix_array import suffix_array


@given(st.lists(st.integers(0, 4), max_size=40) | st.lists(st.integers(0, 300), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(rows):
    """rows in order of (doc_id, text): bytes to remove, by windows seen before."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(6)]
    out = ["", "short", "x" * 99, "x" * 100, "x" * 500, "ab" * 300, passage[0], passage[0], passage[0][:130], "q" + passage[0][:99], "q" + passage[0][:100] + "z"]
    for i in range(160):
        p = rng.choice(passage)
        a = rng.randrange(len(p) - 120)
        b = a + rng.randrange(80, 140) if i % 2 else len(p)
        out.append(" ".join(word() for _ in range(rng.randrange(60))) + p[a:b] + " ".join(word() for _ in range(rng.randrange(40))))
    for _ in range(40):
        base = out[rng.randrange(12, len(out))].split()
        for _ in range(3):
            base[rng.randrange(len(base))] = word()
        out.append(" ".join(base))
    out += [f"{i} " + passage[1][:60] + f" {i * 7919}" * 12 for i in range(60)]  # a common line under 100 bytes
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 3])  # groups are compared, or dealt again by window
def test_equals_brute_force(spark, hot):
    rows = [(i * 5, t) for i, t in enumerate(texts())] + [(10**6, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in random.Random(1).sample(rows, len(rows))], "doc_id long, text string, row string, start int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in report(docs, hot).collect()}
    if hot == 3:
        near = repeats(docs, scratch := Scratch(spark, "t"), hot)
        assert near.count() and spark.read.parquet(f"{scratch.root}/2-later").count()
    want = dict(zip([r[0] for r in rows], brute(rows), strict=True))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 1000


def test_given_documents(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in report(docs).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(rows), strict=True))


def test_text_stage_keeps_columns_and_edges(spark):
    rng = random.Random(3)
    p = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(1, p, 3, "row"), (2, "é" + p + "tail", 3, "row"), (3, None, None, None), (None, "", 0, "q"), (2, p, 3, "row"), (2, p, 3, "row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string")
    got = sorted(map(tuple, remove_repeats(docs).collect()), key=str)
    assert got == sorted([(1, p, 150, "row"), (2, "étail", 5, "row"), (3, None, None, None), (None, "", 0, "q"), (2, "", 0, "row"), (2, "", 0, "row")], key=str)
    assert remove_repeats(docs).schema.names == docs.schema.names and remove_repeats(docs.limit(0)).count() == 0
    assert report(docs).count() == 6


def test_repeated_rows_without_an_earlier_copy_keep_their_text(spark):
    rng = random.Random(4)
    p, q, r = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (150, 400, 300))
    rows = [(7, p), (7, p), (None, q), (None, q), (8, r), (9, r), (9, r)]
    for parts in (1, 7):  # repeated rows in one batch, and in tasks of their own
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in report(docs).collect())
        assert got == [(0, 400, 0), (0, 400, 0), (7, 150, 0), (7, 150, 0), (8, 300, 0), (9, 300, 300), (9, 300, 300)]
        assert sorted(r.text for r in remove_repeats(docs).collect()) == sorted([p, p, q, q, r, "", ""])


def test_many_texts_without_an_id_are_told_apart(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = word(130)
    texts = [f"{i} {word(rng.randrange(20, 60))}#{common}|{i} {word(130)}" for i in range(1500)]
    null = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    hashes = null.selectExpr("text", "xxhash64(text) as h").collect()
    assert len({r.h & 0xFFFF for r in hashes}) < len(texts)
    rows = [(None, r.text) for r in sorted(hashes, key=lambda r: r.h)] + [(i, t[-120:]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r)[1:] for r in report(docs).collect())
    assert got == sorted(brute(rows))
