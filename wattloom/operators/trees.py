"""Boosted trees that never fall along chosen features: one model of all rows, grown from histograms.

A tree's split is found from counts and sums of residuals by bin of each feature, so growing needs histograms and no
rows. Of a table of LOCAL rows or less one task counts them; of a larger one, Spark does: rows are binned and written once, and
for each wave of leaves one aggregate sums the residuals of their left children by feature and bin (the right child is
the parent less the left one). Both ways grow the same trees; what reaches the driver are some thousand sums a wave.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.session import shared_dir

#: Rows that one task takes.
LOCAL = 200_000
#: Bins of a feature, the share of rows (in pct, by hash) that says when to stop, and rounds between writes of the predictions.
BINS, CHECK_PCT, WRITE_EVERY = 64, 15, 8

#: A leaf's way from the root: (feature, bin, whether left) a step.
Path = tuple[tuple[int, int, bool], ...]
#: Counts and sums of residuals, each (features, BINS).
Histogram = tuple[np.ndarray, np.ndarray]


@dataclass
class Tree:
    """One boosted ensemble over binned features; a value beyond the last edge, or a missing one, is in the last bin."""

    features: list[str]
    increasing: frozenset[str]
    rounds: int = 500
    rate: float = 0.05
    leaves: int = 15
    leaf: int = 10
    l2: float = 0.1
    patience: int = 25
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def boost(self, grow: Callable[[], list], error: Callable[[], float | None]) -> Tree:
        """Adds trees until the error of the checked rows has not fallen for some rounds; later trees go again."""
        best, since, self.trees = math.inf, 0, []
        for _ in range(self.rounds):
            self.trees.append(grow())
            now = error()
            if now is not None:
                since = 0 if now < best - 1e-12 else since + 1
                best = min(best, now)
                if since >= self.patience:
                    self.trees = self.trees[:-since]
                    break
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Tree:
        """On rows at hand; ``check`` marks those that only say when to stop."""
        bins, own = self.bins(x), ~check
        self.base = float(y[own].mean())
        at = np.full(len(y), self.base)

        def histograms(paths: list[Path]) -> list[Histogram]:
            out = []
            for path in paths:
                rows = own.copy()
                for j, cut, left in path:
                    rows &= (bins[:, j] <= cut) == left
                r = (y - at)[rows]
                out.append(tuple(np.array([np.bincount(b, w, BINS) for b in bins[rows].T]) for w in (None, r)))
            return out

        def grow():
            tree = self._grow(histograms)
            at[:] += self.rate * self._eval(tree, bins)
            return tree

        return self.boost(grow, lambda: float(np.mean((y[check] - at[check]) ** 2)) if check.any() else None)

    def _split(self, histogram: Histogram, low: float, high: float):
        """The best split: (gain, feature, bin, left value, right value), or none."""
        counts, sums = histogram
        n, total = counts[0].sum(), sums[0].sum()
        value, best = float(np.clip(total / (n + self.l2), low, high)), None
        if n < 2 * self.leaf:
            return None
        for j, e in enumerate(self.edges):
            if not len(e):
                continue
            count, s = counts[j].cumsum()[: len(e)], sums[j].cumsum()[: len(e)]
            ok = (count >= self.leaf) & (n - count >= self.leaf)
            left, right = np.clip(s / (count + self.l2), low, high), np.clip((total - s) / (n - count + self.l2), low, high)
            if self.features[j] in self.increasing:
                ok &= left <= right
            gain = np.where(ok, s * left + (total - s) * right - total * value, -np.inf)
            k = int(gain.argmax())
            if gain[k] > (best[0] if best else 1e-9):
                best = (float(gain[k]), j, k, float(left[k]), float(right[k]))
        return best

    def _grow(self, histograms: Callable[[list[Path]], list[Histogram]]) -> list:
        """Best-first: the leaf whose split gains most splits next, until there are enough leaves.

        When a leaf's children are needed, those of all leaves that could split are counted with them.
        """
        [whole] = histograms([()])
        n, total = whole[0][0].sum(), whole[1][0].sum()
        root = [float(total / (n + self.l2))]
        waiting = [(self._split(whole, -np.inf, np.inf), root, (), whole, -np.inf, np.inf)]
        left_of: dict[Path, Histogram] = {}
        leaves = 1
        while leaves < self.leaves:
            k = max(range(len(waiting)), key=lambda i: waiting[i][0][0] if waiting[i][0] else -1.0)
            found, node, path, own, low, high = waiting.pop(k)
            if found is None:
                break
            if path not in left_of:
                asked = [(path, found), *((p, f) for f, _, p, *_ in waiting if f and p not in left_of)]
                left_of |= zip([p for p, _ in asked], histograms([(*p, (f[1], f[2], True)) for p, f in asked]), strict=True)
            _, j, cut, left, right = found
            sides = left_of[path], tuple(a - b for a, b in zip(own, left_of[path], strict=True))
            middle = (left + right) / 2
            bounds = [(low, middle), (middle, high)] if self.features[j] in self.increasing else [(low, high)] * 2
            below = [[left], [right]]
            node[:] = [j, cut, *below]
            for child, at_left, side, (lo, hi) in zip(below, (True, False), sides, bounds, strict=True):
                waiting.append((self._split(side, lo, hi), child, (*path, (j, cut, at_left)), side, lo, hi))
            leaves += 1
        return root

    def _eval(self, node, bins):
        if len(node) == 1:
            return np.full(len(bins), node[0])
        go = bins[:, node[0]] <= node[1]
        out = np.empty(len(bins))
        out[go], out[~go] = self._eval(node[2], bins[go]), self._eval(node[3], bins[~go])
        return out

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.base + self.rate * sum((self._eval(t, bins) for t in self.trees), np.zeros(len(x)))

    def predict(self) -> Column:
        """The prediction as a column over the features' columns."""
        model = self

        @F.pandas_udf("double")
        def run(columns):
            import pandas as pd

            return pd.Series(model.predict_array(columns.to_numpy(float)))

        return run(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))


def by_fold(models: dict[str, Tree], fold: str) -> Column:
    """Each row's prediction by the model of its fold."""

    @F.pandas_udf("double")
    def run(columns):
        import pandas as pd

        out = pd.Series(np.full(len(columns), np.nan))
        for b, own in columns.groupby(fold):
            out[own.index] = models[b].predict_array(own.drop(columns=fold).to_numpy(float))
        return out

    features = next(iter(models.values())).features
    return F.nanvl(run(F.struct(F.col(fold), *[F.col(c).cast("double").alias(c) for c in features])), F.lit(None).cast("double"))


def _leaves(node: list, path: Path = ()):
    """(path, value) of each leaf."""
    if len(node) == 1:
        yield path, node[0]
    else:
        for side, left in ((node[2], True), (node[3], False)):
            yield from _leaves(side, (*path, (node[0], node[1], left)))


def _under(path: Path) -> Column:
    out = F.lit(True)
    for j, cut, left in path:
        out = out & ((F.col(f"b{j}") <= cut) if left else (F.col(f"b{j}") > cut))
    return out


def _value(tree: list) -> Column:
    out = F.lit(0.0)
    for path, value in _leaves(tree):
        out = F.when(_under(path), F.lit(value)).otherwise(out)
    return out


def checked(features: list[str], target: str) -> Column:
    """Whether a row only says when to stop; by hash, so that any dealing of rows gives the same."""
    return F.pmod(F.xxhash64(F.lit(15), *features, target), F.lit(100)) >= 100 - CHECK_PCT


def fit(df: DataFrame, features: list[str], increasing: set[str], target: str, rounds: int = 500) -> Tree:
    """Trees on all rows with a target."""
    x = [F.col(c).cast("double").alias(c) for c in features]
    rows = df.where(F.col(target).isNotNull()).select(*x, F.col(target).cast("double").alias(target)).withColumn("check", checked(features, target))
    # a thousandth of a rank is finer than the bins
    quantiles = rows.where(~F.col("check")).approxQuantile(features, [k / BINS for k in range(1, BINS)], 0.001)
    edges = [np.unique(np.array(q, float)) for q in quantiles]
    tree = Tree(features, frozenset(increasing) & set(features), rounds, edges=edges)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("check")).alias("own"), F.avg(F.when(~F.col("check"), F.col(target))).alias("mean")).first()
    if not sizes.own:
        raise ValueError("no rows with a target to fit on")
    if sizes.n <= LOCAL:
        return _fit_in_task(rows.withColumn("fold", F.lit("")), tree, target)[""]
    return _fit_by_histograms(rows, tree, target, sizes.mean)


def fit_folds(df: DataFrame, features: list[str], increasing: set[str], target: str, fold: str, names: list[str], rounds: int = 500) -> dict[str, Tree]:
    """A model for each fold, on all rows of other folds: side by side in tasks where they are small, else one after another."""
    if df.count() > LOCAL:
        return {b: fit(df.where(F.col(fold) != b), features, increasing, target, rounds) for b in names}
    x = [F.col(c).cast("double").alias(c) for c in features]
    rows = df.where(F.col(target).isNotNull()).select(*x, F.col(target).cast("double").alias(target), F.col(fold).alias("own_")).withColumn("check", checked(features, target))
    quantiles = rows.where(~F.col("check")).approxQuantile(features, [k / BINS for k in range(1, BINS)], 0.001)
    tree = Tree(features, frozenset(increasing) & set(features), rounds, edges=[np.unique(np.array(q, float)) for q in quantiles])
    # LOCAL rows a fold at most; folds are builds
    dealt = rows.withColumn("fold", F.explode(F.array(*[F.lit(b) for b in names]))).where(F.col("fold") != F.col("own_")).drop("own_")
    return _fit_in_task(dealt, tree, target)


def _fit_in_task(rows: DataFrame, tree: Tree, target: str) -> dict[str, Tree]:
    import pickle

    features = tree.features

    def run(table):
        import pandas as pd

        got = table.sort_values([*features, target], kind="stable")
        model = replace(tree).fit(got[features].to_numpy(float), got[target].to_numpy(float), got["check"].to_numpy(bool))
        return pd.DataFrame({"fold": [table["fold"].iloc[0]], "model": [pickle.dumps(model)]})

    return {r.fold: pickle.loads(r.model) for r in rows.groupBy("fold").applyInPandas(run, "fold string, model binary").collect()}  # a model a fold


def _fit_by_histograms(rows: DataFrame, tree: Tree, target: str, mean: float) -> Tree:
    spark, k = rows.sparkSession, len(tree.features)
    root = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    features = tree.features
    schema = "y double, check boolean, at double, " + ", ".join(f"b{j} int" for j in range(k))
    tree.base = mean

    def binned(batches):
        import pyarrow as pa

        for batch in batches:
            bins = tree.bins(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features])).astype(np.int32)
            columns = [batch.column(target), batch.column("check"), pa.array(np.full(batch.num_rows, mean)), *(pa.array(b) for b in bins.T)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    def saved(df: DataFrame) -> DataFrame:
        nonlocal written
        written += 1
        df.write.parquet(f"{root}/{written}")
        return spark.read.schema(schema).parquet(f"{root}/{written}")

    written, fresh = 0, 0
    table = saved(rows.mapInArrow(binned, schema))
    pairs = F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f"b{j}").alias("bin")) for j in range(k)])

    def histograms(paths: list[Path]) -> list[Histogram]:
        node = F.lit(None).cast("int")
        for i, p in enumerate(paths):
            node = F.when(_under(p), i).otherwise(node)
        own = table.where(~F.col("check")).select(node.alias("node"), (F.col("y") - F.col("at")).alias("r"), F.inline(pairs)).where("node is not null")
        counts, sums = np.zeros((len(paths), k, BINS)), np.zeros((len(paths), k, BINS))
        for r in own.groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("r").alias("s")).collect():  # leaves x features x bins
            counts[r.node, r.feature, r.bin], sums[r.node, r.feature, r.bin] = r.n, r.s
        return list(zip(counts, sums, strict=True))

    def grow():
        nonlocal table, fresh
        new = tree._grow(histograms)
        table, fresh = table.withColumn("at", F.col("at") + tree.rate * _value(new)), fresh + 1
        if fresh == WRITE_EVERY:  # the plan stays short, and a lost executor costs a few trees
            table, fresh = saved(table), 0
        return new

    return tree.boost(grow, lambda: table.where("check").agg(F.avg((F.col("y") - F.col("at")) ** 2)).first()[0])
