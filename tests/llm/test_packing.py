import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wattloom.llm.common import Scratch, load
from wattloom.llm.packing import LENGTH, Plan, best_pattern, op5_packing, pack, plan_pieces, solve

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(rng.choice(np.arange(1, 13), 4, replace=False))
        prices = rng.random(4)
        worth, pattern = best_pattern(prices, sizes, 12)
        most = max(np.dot(prices, c) for c in itertools.product(range(13), repeat=4) if np.dot(sizes, c) <= 12)
        assert abs(worth - most) < 1e-9 and np.dot(sizes, pattern) <= 12 and abs(np.dot(prices, pattern) - worth) < 1e-9


def test_program_reaches_its_bound():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 129)
    counts = rng.integers(1, 400, 128).astype(float)
    patterns, copies = solve(sizes, counts, 128)
    assert np.allclose(copies @ patterns, counts, atol=1e-5) and (patterns @ sizes <= 128).all()
    assert copies.sum() <= np.dot(sizes, counts) / 128 * 1.02
    patterns, copies = solve(np.array([129, 130]), np.array([10.0, 4.0]), 256)
    assert abs(copies.sum() - 14) < 1e-6


def check(pieces, tokens):
    """pieces by document cover it once; sequences are gapless; returns padding."""
    docs, sequences = {}, {}
    for key, start, length, sequence, offset in pieces:
        docs.setdefault(key, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    for key, n in tokens.items():
        at = 0
        for start, length in sorted(docs[key]):
            assert start == at and length > 0
            at += length
        assert at == n
    assert len(docs) == len(tokens)
    padding = 0
    for cut in sequences.values():
        at = 0
        for offset, length in sorted(cut):
            assert offset == at
            at += length
        assert at <= LENGTH
        padding += 0 if at & (at - 1) == 0 else LENGTH - at
    return padding


@pytest.mark.parametrize("many", [0, 1, 40, 6000])
def test_plan(spark, many):
    rng = np.random.default_rng(3)
    n = np.maximum(1, rng.lognormal(6.5, 1.2, many).astype(int)).tolist() + ([2048, 4096, 1, 2047, 100_000] if many > 1 else [])
    n += [700] * (many // 2)  # a third of all in one class
    rows = [(i % 7, i, x) for i, x in enumerate(n)]
    got = plan_pieces(spark.createDataFrame(rows, "part int, pos long, n_tokens long"), Scratch(spark, "t")).collect()
    padding = check([((r.part, r.pos), r.start, r.length, r.sequence_id, r.offset) for r in got], {(p, i): x for p, i, x in rows})
    assert padding <= max(LENGTH, 0.001 * sum(n))


def test_plan_without_documents():
    assert Plan({}).sequences == 0


def test_pieces_hold_the_ids(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    got = op5_packing(spark, "/root/testdata/sf0.01").collect()
    t = Tokenizer.from_file(PATH)
    rows = docs.select("doc_id", "text").collect()
    ids = {r.doc_id: [*e.ids, 1] for r, e in zip(rows, t.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True)}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert check([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], {k: len(v) for k, v in ids.items()}) <= LENGTH


def test_edges(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (1, ""), (4, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, part int, ids string")
    got = pack(docs, PATH).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("d")).agg(F.sum("length").alias("n")).collect()
    assert {r.d: r.n for r in got} == {1: 3, -1: 3, 4: 4}
    assert pack(docs.limit(0), PATH).collect() == []
