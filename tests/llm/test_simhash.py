import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from wattloom.llm import simhash as wattloom_simhash
from wattloom.llm.common import Scratch, connected_components, lists
from wattloom.llm.simhash import CHOICES, links, looked_up, crossing, near_duplicates, positions, shared_bytes, shingle_set, similar, simhash, spanning, tallied

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_equals_the_plain_one():
    for text in ["", "one", "One two", "A b c", "a\tb\nC d e Ä f", "x " * 500, "Ab " * 3 + "\x0b\x0cq", "  a b\x1cc d"]:
        assert simhash(text.encode()) == slow_print(text)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(400))
    texts = [None, "", " \n", "a", "A", "a b", base, base, base.upper()]
    for _ in range(150):
        words = base.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(40))) for _ in range(100)]
    rows = [(i * 3 + 1, t, "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    prints = {i: slow_print(t) for i, t, *_ in rows}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = slow_components(prints, linked)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("long", [2048, 60, 2])  # lists are tallied, or dealt again by finer keys
def test_dense_lists_lose_no_link(spark, monkeypatch, long):
    monkeypatch.setattr(wattloom_simhash, "LONG", long)
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)}
    values |= {centre ^ x << 3 for x in range(700)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    scratch = Scratch(spark, "t")
    roots = connected_components(scratch, links(spark.createDataFrame([(v,) for v in signed], "fp long"), scratch)).collect()
    got = {}
    for r in roots:
        got.setdefault(r.root, set()).add(r.node)
    v = np.array(sorted(values), np.uint64)
    linked = [(int(a), int(v[j])) for i, a in enumerate(v) for j in np.nonzero(np.bitwise_count(v ^ a) <= 2)[0] if j > i]
    want = {}
    for n, r in slow_components([int(x) for x in v], linked).items():
        want.setdefault(r, set()).add(n - (1 << 64) if n >> 63 else n)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_chains_and_empty_tables(spark):
    scratch = Scratch(spark, "t")
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(scratch, edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[900] == roots[901] != roots[0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5)]


def test_every_two_positions_leave_a_key_alone():
    assert all(any(not {a, b} & set(c) for c in CHOICES) for a, b in itertools.combinations(range(8), 2))


def test_tally_and_lookup_give_the_pairs_within_two_bits():
    rng = np.random.default_rng(3)
    for _ in range(20):
        centre = rng.integers(0, 1 << 63, dtype=np.uint64)
        own = np.unique(centre ^ (rng.integers(0, 1 << 16, 400).astype(np.uint64) & rng.integers(0, 1 << 16, 400).astype(np.uint64)))
        want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if int(own[i] ^ own[j]).bit_count() <= 2}
        assert set(zip(*map(np.ndarray.tolist, tallied(own, 2)), strict=True)) == want
        assert set(zip(*map(np.ndarray.tolist, looked_up(own, 2)), strict=True)) == want
    a, b = np.array([0x0102030405060708], np.uint64), np.array([0x0102FF0405060709], np.uint64)
    assert shared_bytes(a, b).tolist() == [6]


def test_lists_hold_no_long_run():
    rng = random.Random(7)
    for most in (1, 3, 10):
        for least in (1, 20):
            keys = sorted(rng.choice([rng.randrange(30), 5, 5]) for _ in range(300))
            batches, at = [], 0
            while at < len(keys):
                n = rng.randrange(0, 7)
                batches.append(pa.record_batch({"key": pa.array(keys[at : at + n], pa.int64())}))
                at += n
            seen = []
            for t, long in lists(iter(batches), "key", most, least):
                own = t.column("key").to_pylist()
                if long:
                    assert len(set(own)) == 1 and len(own) <= 2 * most
                seen.append((own, long))
            assert sorted(k for own, _ in seen for k in own) == keys
            passed = {own[0] for own, long in seen if long}
            whole = [set(own) for own, long in seen if not long]
            assert sum(map(len, whole)) == len(set().union(*whole)) and not passed & set().union(*whole)
            assert all(keys.count(k) <= most for own in whole for k in own)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard_components(rows, similarity=0.8):
    """Brute force: all pairs of texts by their whole shingle sets."""
    sets = {i: shingles(t) for i, t in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return slow_components(sets, linked)


def edited(rng, words, n):
    words = words[:]
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_texts_are_grouped_as_by_brute_force(spark):
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 400]))]
        rows.append((i := i + 1, " ".join(base)))
        for _ in range(rng.randrange(6)):
            n = rng.choice([0, 1, len(base) // 60, len(base) // 35, len(base) // 20])
            rows.append((i := i + 1, edited(rng, base, n).upper() if n == 0 else edited(rng, base, n)))
    rows += [(1000, ""), (1001, None), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "a b c d e"), (1006, "a b c d e")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rng.sample(rows, len(rows))], "doc_id long, text string, gid string, key int").repartition(5)
    got = {r.doc_id: r.component_id for r in similar(docs).collect()}
    want = jaccard_components(rows)
    assert len(set(want.values())) < 0.8 * len(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(want[got[i]] == want[i] for i in want)  # never two that no chain of similar pairs connects


def test_similar_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (9, text + " x"), (None, "other words of no kin at all"), (7, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in similar(docs).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
    assert similar(docs.limit(0)).collect() == []


@pytest.mark.parametrize("together", [1024, 40])
def test_a_large_group_of_near_copies(spark, monkeypatch, together):
    monkeypatch.setattr(wattloom_simhash, "TOGETHER", together)
    rng = random.Random(12)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, edited(rng, base, 1)) for i in range(700)] + [(1000 + i, edited(rng, base, 60)) for i in range(100)]
    got = {r.doc_id: r.component_id for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(700)] == [0] * 700 and all(got[i] == i for i in range(1000, 1100))


def test_positions_agree_as_often_as_sets_are_similar():
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    for n in (20, 60, 200):
        a, b = " ".join(base), edited(rng, base, n)
        share = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert len(shingle_set(a.encode())) == len(shingles(a))
        assert abs((positions(shingle_set(a.encode())) == positions(shingle_set(b.encode()))).mean() - share) < 0.12


def test_the_forest_keeps_the_best_links():
    rng = np.random.default_rng(14)
    sketch = rng.integers(0, 3, (60, 30)).astype(np.uint8)
    i, j = spanning(sketch, 12)
    shared = (sketch[:, None] == sketch).sum(axis=2)
    tally = shared[i, j]
    assert (tally >= 12).all()
    for least in range(12, 25):  # connected at a bound as by all pairs
        want = slow_components(range(60), [(a, b) for a, b in itertools.combinations(range(60), 2) if shared[a, b] >= least])
        assert slow_components(range(60), [(min(a, b), max(a, b)) for a, b, n in zip(i.tolist(), j.tolist(), tally.tolist(), strict=True) if n >= least]) == want


def test_pairs_between_groups():
    rng = np.random.default_rng(15)
    for n in (1, 2, 90):
        sketch, group = rng.integers(0, 3, (n, 30)).astype(np.uint8), rng.integers(0, 5, n) * 7
        shared = (sketch[:, None] == sketch).sum(axis=2)
        want = {(a, b) for a, b in itertools.combinations(range(n), 2) if group[a] != group[b] and shared[a, b] >= 12}
        i, j, more = crossing(sketch, group, 12, 10**6)
        assert len(i) == len(want) and {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and not more
        i, j, more = crossing(sketch, group, 12, 3)
        best = {}
        for a, b in want:
            best.setdefault(frozenset((group[a], group[b])), []).append(shared[a, b])
        assert more == any(len(x) > 3 for x in best.values())
        got = {}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            got.setdefault(frozenset((group[a], group[b])), []).append(shared[a, b])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[-3:] for k, v in best.items()}


def near(rng, base, want):
    """base with single words exchanged, which takes five shingles each, until its similarity is just ``want`` or less."""
    words, own = base[:], shingles(" ".join(base))
    for at in rng.sample(range(len(base)), len(base)):
        words[at] = f"z{rng.randrange(10**9)}"
        other = shingles(" ".join(words))
        if len(own & other) / len(own | other) <= want:
            return words
    raise AssertionError


def test_a_failing_pair_never_stands_in_for_one_that_holds(spark):
    """Triples k, x, y: x and y are similar to k and to each other's neighbour only by a pair near the threshold."""
    rng, rows = random.Random(16), []
    for t in range(60):
        k = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        x = near(rng, k, 0.97)
        rows += [(3 * t, " ".join(k)), (3 * t + 1, " ".join(x)), (3 * t + 2, " ".join(near(rng, x, 0.805)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar(docs).collect()}
    want = jaccard_components(rows)
    assert all(want[got[i]] == want[i] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 1  # a pair at the threshold may be in no list or under the tally's bound


@pytest.mark.parametrize("together, at_once", [(16, 64), (1024, 1)])
def test_blocks_and_rounds_change_no_group(spark, monkeypatch, together, at_once):
    rng, rows = random.Random(17), []
    for f in range(6):  # families around the threshold
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(100 * f + i, " ".join(near(rng, base, rng.choice([0.99, 0.9, 0.86])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in similar(docs).collect()}
    monkeypatch.setattr(wattloom_simhash, "TOGETHER", together)
    monkeypatch.setattr(wattloom_simhash, "PAIRS_AT_ONCE", at_once)
    assert {r.doc_id: r.component_id for r in similar(docs).collect()} == want
    brute = jaccard_components(rows)
    assert sum(want[i] != brute[i] for i in brute) <= 2 and all(brute[want[i]] == brute[i] for i in brute)
