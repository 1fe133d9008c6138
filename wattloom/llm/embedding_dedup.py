"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Only vectors of equal label and length compare. Exact copies are first counted as one. Each tree
splits recursively on a random projection, near its middle where fewest vectors are close; vectors within a margin of the split go
both ways, so that a pair at the threshold parts only if its projections differ by more than
twice the margin. Many trees with a narrow margin miss a pair only if each of them parts it.

Trees grow by rounds. A round counts the rows of each node; nodes above LEAF each get a subtree, fitted
on a sample of their own vectors (at most SAMPLE a node, by hash) and applied by a join on the node, until
no node splits any more. So leaves hold at most LEAF vectors whatever the corpus; what stays larger is a
cloud that no split parts without sending over SPILL of it both ways, whose vectors are near copies: it becomes
pairs of blocks in tasks of their own. Leaves and pairs of blocks are compared by matrix products.

A pair that meets in several leaves counts in the first one only, which each task tells from the
leaves that its vectors carry; so link counts add up without a list of pairs. For components,
each task emits a spanning forest.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or
whose label is null, links with nothing and is its own component; copies link with each other;
repeated vec_ids are vectors of their own; a null vec_id never is the smallest id and is not kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, connected_components, load

COSINE = 0.98
TREES = 6
#: Margin of a split, in standard deviations of the projected distance of a pair at the threshold.
MARGIN = 0.5
LEAF = 256
#: Vectors of a node that its subtree is fitted on, the fewest that a split is fitted on, and levels of a subtree.
SAMPLE = 4096
LEAST_FIT = 32
DEPTH = 6
#: Directions that a split tries, and the most of a node's vectors that may go both ways.
TRIES = 4
SPILL = 0.25
BLOCK = 1024
#: Marks in a subtree: a leaf that a later round may split, and one that none does.
OPEN, FINAL = np.float32(np.nan), np.float32(np.inf)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _direction(seed: tuple[int, ...], size: int) -> np.ndarray:
    r = np.random.default_rng(seed).standard_normal(size)
    return r / np.linalg.norm(r)


def _margin(size: int, cosine: float) -> float:
    return MARGIN * float(np.sqrt(2 - 2 * cosine) / np.sqrt(size))


def grow(x: np.ndarray, seed: int, scale: float, cosine: float, leaf: int = LEAF, least: int = LEAST_FIT) -> np.ndarray:
    """A subtree over sample vectors x of a node, each of which stands for ``scale`` vectors.

    A heap of thresholds, its root at 1, and which direction each split took: these are drawn from the node's seed,
    the split's number and the try.
    """
    tree, m = np.full((2, 2 << DEPTH), OPEN), _margin(x.shape[1], cosine)

    def split(number: int, x: np.ndarray) -> None:
        if len(x) * scale <= leaf:
            tree[0, number] = FINAL
        if len(x) * scale <= leaf or len(x) < least or number >> DEPTH:
            return  # with few vectors of the sample left, the next round samples this node anew
        best = (SPILL, 0, np.float32(0), x[:, 0])
        for t in range(TRIES):
            p = x @ _direction((seed, number, t), x.shape[1])
            ordered = np.sort(p)
            at = ordered[np.unique(np.linspace(len(p) // 4, len(p) * 3 // 4, 33).astype(int))].astype(np.float32)
            both = (np.searchsorted(ordered, at + m, "right") - np.searchsorted(ordered, at - m, "left")) / len(p)
            both = np.where(np.maximum(np.searchsorted(ordered, at + m, "right"), len(p) - np.searchsorted(ordered, at - m, "left")) <= 0.9 * len(p), both, np.inf)
            k = int(np.argmin(both + np.abs(np.linspace(-0.02, 0.02, len(at)))))  # of equals the one nearest the middle
            if both[k] < best[0]:
                best = (float(both[k]), t, at[k], p)
            if best[0] <= SPILL / 2:
                break
        if best[0] >= SPILL:
            tree[0, number] = FINAL  # a cloud that no split parts
            return
        _, t, at, p = best
        tree[:, number] = at, t
        for i, side in enumerate((x[p <= at + m], x[p >= at - m])):
            split(2 * number + i, side)

    split(1, x)
    return tree


def route(tree: np.ndarray, seed: int, x: np.ndarray, rows: np.ndarray, cosine: float, number: int = 1) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(leaf's number, whether it is final, rows in it) for unit vectors x; a root that does not split is final."""
    at, attempt = tree[:, number]
    if not np.isfinite(at) or not len(rows):
        yield number, bool(np.isinf(at)) or number == 1, rows
        return
    p = x[rows] @ _direction((seed, number, int(attempt)), x.shape[1])
    m = _margin(x.shape[1], cosine)
    for i, side in enumerate((p <= at + m, p >= at - m)):
        yield from route(tree, seed, x, rows[side], cosine, 2 * number + i)


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.nonzero(linked)
    root = np.arange(len(linked))
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    i = np.nonzero(root != np.arange(len(root)))[0]
    return i, root[i]


def _compare(cosine: float):
    def run(table):
        """One leaf, or two blocks of one: link counts (b null) and the links of a forest."""
        import pyarrow as pa

        gid, n, block = (table.column(c).to_numpy() for c in ("gid", "n", "block"))
        first, second, leaf = (table.column(c)[0].as_py() for c in ("i", "j", "leaf"))
        raw = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(gid), -1)
        norm = np.linalg.norm(raw, axis=1)
        got = (raw @ raw.T) / (norm[:, None] * norm)
        linked = got >= cosine
        for a, b in zip(*np.nonzero(np.abs(got - cosine) < 1e-12), strict=True):  # at the edge, one plain sum decides
            linked[a, b] = np.dot(raw[a], raw[b]) / (norm[a] * norm[b]) >= cosine
        np.fill_diagonal(linked, False)
        if first != second:
            linked &= block[:, None] != block
        places: dict[int, int] = {}
        met = [[places.setdefault(k, len(places)) for k in ids if k < leaf] for ids in table.column("leaves").to_pylist()]
        earlier = np.zeros((len(gid), max(1, len(places))), np.float32)
        for row, ids in enumerate(met):
            earlier[row, ids] = 1
        counted = linked & ~(earlier @ earlier.T > 0)
        links = counted @ n
        some = np.nonzero(links)[0]
        a, b = _forest(np.triu(linked))
        return pa.table(
            {"a": pa.array(np.concatenate([gid[some], gid[a]]), pa.int64()), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(gid[b], pa.int64())]), "n": pa.array(np.concatenate([links[some], np.zeros(len(a), links.dtype)]), pa.int64())}
        )

    return run


def leaves_of(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(gid, leaf) of each distinct vector (gid, label, v) in each tree: a vector has a leaf or, by spill, several a tree."""
    kind = F.xxhash64("label", F.size("v"))
    node = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, kind)))
    here = scratch.save(vectors.select("gid", node.alias("node")), "roots")
    done = None

    def fit(table):
        import pyarrow as pa

        node, size = table.column("node")[0].as_py(), table.column("size")[0].as_py()
        x = _unit(np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1))
        tree = grow(x, node & (1 << 63) - 1, size / len(x), cosine, leaf)
        return pa.table({"node": pa.array([node], pa.int64()), "tree": pa.array([tree.tobytes()], pa.binary())})

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            gids, nodes, blobs, lists = (batch.column(c) for c in ("gid", "node", "tree", "v"))
            out: list[tuple] = []
            same: dict[int, list[int]] = {}
            for i, k in enumerate(nodes.to_pylist()):
                same.setdefault(k, []).append(i)
            for k, members in same.items():
                tree = np.frombuffer(blobs[members[0]].as_py(), np.float32).reshape(2, -1)
                own, x = gids.take(pa.array(members)).to_numpy(), _unit(np.array(lists.take(pa.array(members)).flatten(), np.float64).reshape(len(members), -1))
                for number, final, found in route(tree, k & (1 << 63) - 1, x, np.arange(len(members)), cosine):
                    name = int.from_bytes(xxhash.xxh3_64_digest(b"%d/%d" % (k, number)), signed=True)
                    out += [(g, name, final) for g in own[found].tolist()]
            g, name, final = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(name, pa.int64()), pa.array(final, pa.bool_())], ["gid", "node", "final"])

    while True:
        sizes = scratch.save(here.groupBy("node").agg(F.count("*").alias("size")), "sizes")
        large = sizes.where(F.col("size") > leaf)
        if not large.limit(1).count():
            break
        kept = here.join(sizes.where(F.col("size") <= leaf).select("node"), "node").select("gid", "node")
        rows = scratch.save(here.join(large, "node").join(vectors.select("gid", "v"), "gid"), "large")
        few = F.pmod(F.xxhash64("gid", "node"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("size")
        fitted = scratch.save(rows.where(few).groupBy("node").applyInArrow(fit, "node long, tree binary"), "trees")
        dealt = scratch.save(rows.join(fitted, "node").select("gid", "node", "tree", "v").mapInArrow(deal, "gid long, node long, final boolean"), "dealt")
        scratch.drop(rows)
        kept = scratch.save(kept.unionByName(dealt.where("final").select("gid", "node")), "done")
        done = kept if done is None else done.unionByName(kept)
        here = dealt.where("not final").select("gid", "node")
    out = here.select("gid", "node") if done is None else done.unionByName(here.select("gid", "node"))
    return out.withColumnRenamed("node", "leaf")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind == "array<float>" else "array<double>"  # singles move as they came; all sums are in double precision
    v = F.col("v")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))
    keyed = rows.select("vec_id", "label", F.when(sound, v).alias("v"), F.when(sound, F.xxhash64("label", v)).alias("k1"), F.when(sound, F.xxhash64(F.lit(7), v, "label")).alias("k2"))
    copies = keyed.where("v is not null").groupBy("k1", "k2").agg(F.first(F.col("v").cast(kind)).alias("v"), F.first("label").alias("label"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = scratch.save(copies.withColumn("gid", F.monotonically_increasing_id()), "distinct")

    leaves = scratch.save(leaves_of(distinct.select("gid", "label", "v"), scratch, cosine, trees, leaf), "leaves")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    sizes = scratch.save(leaves.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    carried = leaves.groupBy("gid").agg(F.collect_list("leaf").alias("leaves"))
    dealt = distinct.select("gid", "n", "v").join(carried, "gid").withColumn("leaf", F.explode("leaves"))
    placed = dealt.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("gid"), blocks).cast("int"))
    # in a leaf of several blocks, a block meets each other one; alone it is one pair of itself
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    spread = placed.withColumn("pair", F.explode(pairs)).select("leaf", "pair.i", "pair.j", "gid", "n", "v", "leaves", "block")
    found = scratch.save(spread.groupBy("leaf", "i", "j").applyInArrow(_compare(cosine), "a long, b long, n long"), "found")

    links = found.where("b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("links"))
    roots = connected_components(scratch, found.where("b is not null").select("a", "b")).withColumnsRenamed({"node": "gid"})
    of = distinct.select("gid", "k1", "k2", "n", "least").join(roots, "gid", "left").join(links, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.save(of.join(least, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "of")
    out = keyed.select("vec_id", "k1", "k2").join(of, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


OP6_SQL = """
with recursive e as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98
), r as (
  select vec_id as a, vec_id as b from e union select r.a, l.b from r join l on r.b = l.a
), c as (
  select a, min(b) as component_id from r group by a
), n as (
  select a, count(*) as n_links from l group by a
)
select c.a as vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, c.a = c.component_id as kept
from c left join n on n.a = c.a
"""
