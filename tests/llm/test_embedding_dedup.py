import numpy as np
import pytest
from wattloom.llm import embedding_dedup
from wattloom.llm.embedding_dedup import grow, near_duplicates, route

SCHEMA = "vec_id long, embedding array<float>, label int, n int, leaf string"


def brute(rows, cosine=0.98):
    n = {r[0]: 0 for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for label in {r[2] for r in rows} - {None}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], np.float32).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        g = (x @ x.T) / (norm[:, None] * norm)
        for a, b in zip(*np.nonzero(np.triu(g >= cosine, 1)), strict=True):
            a, b = own[a][0], own[b][0]
            n[a] += 1
            n[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i), find(i) == i) for i in n}


def clouds(seed, many):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.standard_normal((12, 16))
    for i in range(many):
        base = centres[rng.integers(12)] if rng.random() < 0.3 else rng.standard_normal(16)
        rows.append((i * 2 + 1, (base + 0.07 * rng.standard_normal(16)).tolist(), int(rng.integers(2)), 0, ""))
    centre = rng.standard_normal(16)
    rows += [(i * 2 + 2, (centre + 0.01 * rng.standard_normal(16)).tolist(), 0, 0, "") for i in range(700)]
    rows += [(i * 2 + 2, centre.tolist(), 0, 0, "") for i in range(700, 730)]
    return rows


@pytest.mark.parametrize("leaf", [256, 40])
def test_links_equal_brute_force(spark, leaf):
    rows = clouds(1, 900)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), leaf=leaf).collect()}
    want = brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the threshold, none twice
    assert sum(g[0] for g in got.values()) >= 0.999 * sum(w[0] for w in want.values())
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.998 * len(want)


def test_edges(spark):
    one, nan = [1.0, 2.0], float("nan")
    rows = [(1, one, None), (2, one, None), (3, None, 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [], 1), (13, [float("inf"), 1.0], 1), (14, [float("inf"), 1.0], 1), (15, one, 1), (16, [2.0, 4.0], 1), (17, [1.0, 2.0, 0.0], 1), (18, one, 2), (19, one, 2), (19, one, 2), (None, one, 2), (None, [5.0, 0.0], 3)]
    rows = [(*r, 1, "x") for r in rows]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.vec_id)
    alone = [(i, 0, i, True) for i in [*range(1, 15), 17]]
    assert got == sorted([*alone, (15, 1, 15, True), (16, 1, 15, False), (18, 3, 18, True), (19, 3, 18, False), (19, 3, 18, False)])
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def comparisons(n, leaf):
    """Pairs compared per vector in one tree over n vectors, grown by rounds as leaves_of does; and rows per vector."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes, pairs, held = [(1, np.arange(n))], 0, 0
    while nodes:
        seed, rows = nodes.pop()
        if len(rows) <= leaf:
            pairs, held = pairs + len(rows) ** 2, held + len(rows)
            continue
        sample = rng.choice(rows, min(len(rows), 512), replace=False)
        tree = grow(x[sample], seed, len(rows) / len(sample), 0.98, leaf, least=8)
        for number, final, found in route(tree, seed, x, rows, 0.98):
            if final:
                pairs, held = pairs + len(found) ** 2, held + len(found)
            else:
                nodes.append(((seed * 131 + number) % (1 << 62), found))
    return pairs / n, held / n


def test_comparisons_per_vector_do_not_grow_with_the_table():
    # what counts is leaves: 2 thousand to 131 thousand vectors in leaves of 16 are as 32 thousand to 2 million in leaves of 256
    small, middle, large = comparisons(1 << 11, 16), comparisons(1 << 14, 16), comparisons(1 << 17, 16)
    assert large[0] <= 16 * large[1] and large[0] / small[0] < 2
    assert large[1] / middle[1] < 1.6  # spill adds a constant share a level


def test_narrow_margins_and_many_trees_find_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal(x[:400].shape)
    off -= (off * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x[400:800] = 0.981 * x[:400] + np.sqrt(1 - 0.981**2) * off  # cosines just above the threshold
    met = np.zeros(400, bool)
    for t in range(embedding_dedup.TREES):
        nodes = [(t * 7919 + 1, np.arange(len(x)))]
        while nodes:
            seed, rows = nodes.pop()
            if len(rows) <= 256:
                own = np.zeros(len(x), bool)
                own[rows] = True
                met |= own[:400] & own[400:800]
                continue
            tree = grow(x[rng.choice(rows, min(len(rows), 4096), replace=False)], seed, max(1, len(rows) / 4096), 0.98)
            nodes += [((seed * 131 + n) % (1 << 62), found) for n, final, found in route(tree, seed, x, rows, 0.98) if len(found) < len(rows)]
    assert met.mean() >= 0.995


def test_a_cloud_is_a_leaf_and_a_cluster_in_the_middle_is_passed_by():
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cloud = unit(rng.standard_normal(64) + 0.05 * rng.standard_normal((3000, 64)))
    tree = grow(cloud, 5, 1.0, 0.98)
    assert sum(len(r) for _, _, r in route(tree, 5, cloud, np.arange(3000), 0.98)) <= 3 * 3000
    mixed = unit(np.concatenate([cloud, rng.standard_normal((3000, 64))]))  # half of all in one place
    tree = grow(mixed, 6, 1.0, 0.98)
    leaves = list(route(tree, 6, mixed, np.arange(6000), 0.98))
    assert len(leaves) > 4 and sum(len(r) for _, _, r in leaves) <= 3 * 6000
