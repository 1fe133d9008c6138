"""Build-validated power models: linear ones by Gram matrices, monotone boosted trees (``trees.py``), scores, intervals and what-if.

A linear fit is one distributed aggregate of cross products (k x k numbers a build); only that
reaches the driver, whatever the rows. Leave-one-build-out folds are the total less a build, with each
fold's own medians for missing values: these enter through indicator columns, so one pass serves all folds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import Config
from wattloom.functions.expr import natural_key
from wattloom.operators import trees
from wattloom.operators.derive import rescale_estimate, with_features
from wattloom.operators.ranks import Ask, quantiles
from wattloom.operators.stats import prediction_metrics, whole_metrics
from wattloom.session import kept

#: The kinds of models by name, with the setting that lists a kind's features (scaled has the baseline's alone); register one by adding it.
KINDS = {"scaled": "baseline_feature", "linear": "linear_features", "physics": "physics_features", "datamove": "datamove_features", "tree": "tree_features"}
#: Which kind stands in for one that is not there.
PREFERENCE = ["datamove", "physics", "linear", "scaled", "tree"]
#: What the terms of the datamove model attribute power to.
PARTS = {"cell_dyn_term": "compute_mw", "wire_dyn_term": "wire_mw", "move_term": "movement_mw", "leak_term": "leakage_mw"}
TARGET = "be_mw"


@dataclass
class Linear:
    kind: str
    intercept: float
    coefficients: dict[str, float]
    fill: dict[str, float] = field(default_factory=dict)

    def terms(self) -> dict[str, Column]:
        return {c: F.coalesce(F.col(c), F.lit(self.fill.get(c, 0.0))) * w for c, w in self.coefficients.items()}

    def predict(self) -> Column:
        return sum(self.terms().values(), F.lit(self.intercept))


#: Fixed: features along which a tree's prediction never falls.
INCREASING = {
    "fe_physical_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "dyn_term", "leak_term", "total_cap_pf", "activity", "frequency_ghz", "voltage_v",
    "wire_cap_fraction", "cell_dyn_term", "wire_dyn_term", "move_term", "bits_per_cycle", "wire_length_um", "avg_net_length_um",
}
Model = Linear | trees.Tree


def features_of(kind: str, cfg: Config | None = None) -> list[str]:
    found = getattr(cfg or Config(), KINDS[kind])
    return [found] if isinstance(found, str) else list(found)


def baseline(cfg: Config | None = None) -> Linear:
    return Linear("baseline", 0.0, {(cfg or Config()).baseline_feature: 1.0})


def _tree_features(df: DataFrame, cfg: Config | None) -> list[str]:
    """The tree's features that the rows have, with some value."""
    names = [c for c in features_of("tree", cfg) if c in df.columns]
    row = df.agg(*[F.count(c).alias(c) for c in names]).first() if names else {}
    names = [c for c in names if row[c]]
    if not names:
        raise ValueError("too few features for tree")
    return names


def _fills(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Training medians; features without any value are left out."""
    found = quantiles(df, {c: F.col(c) for c in features}, [Ask(c, 0.5) for c in features])
    return {c: x for c, x in zip(features, found, strict=True) if x is not None}


def grams(df: DataFrame, features: list[str], missing: list[str] = ()) -> dict[str, np.ndarray]:
    """Per build: cross products of (1, features or 0, whether each of ``missing`` is missing, target) over rows with a target."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    x = [F.lit(1.0), *[value(c) for c in features], *[F.col(c).isNull().cast("double") for c in missing], F.col(TARGET)]
    k = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)]
    out = {}
    for row in df.where(F.col(TARGET).isNotNull()).groupBy("build").agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).collect():
        g, n = np.zeros((k, k)), 0
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = row[f"s{n}"]
                n += 1
        out[row.build] = g
    return out


def filled(g: np.ndarray, features: list[str], missing: list[str], fill: dict[str, float]) -> np.ndarray:
    """The Gram matrix of (1, features, target) with missing values filled, from one with indicators."""
    k = len(features)
    to = np.zeros((k + 2, len(g)))
    to[: k + 1, : k + 1] = np.eye(k + 1)
    to[-1, -1] = 1
    for n, c in enumerate(missing):
        to[1 + features.index(c), 1 + k + n] = fill[c]
    return to @ g @ to.T


def _missing(df: DataFrame, features: list[str]) -> list[str]:
    row = df.where(F.col(TARGET).isNotNull()).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def solve(kind: str, g: np.ndarray, features: list[str], fill: dict[str, float]) -> Linear:
    """Least squares with intercept from a Gram matrix; scaled, and of minimum norm where rank lacks."""
    n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
    if n == 0:
        raise ValueError("no rows with a target to fit on")
    mean, target = sx / n, sy / n
    cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    sd[sd <= 1e-12] = 1.0
    w = np.linalg.lstsq(cov / np.outer(sd, sd), (g[1:-1, -1] - n * mean * target) / sd, rcond=None)[0] / sd
    return Linear(kind, float(target - mean @ w), {c: float(v) for c, v in zip(features, w, strict=True)}, fill)


def fit(df: DataFrame, kind: str, cfg: Config | None = None) -> Model:
    if kind == "baseline":
        return baseline(cfg)
    if kind == "tree":
        names = _tree_features(df, cfg)
        return trees.fit(df, names, INCREASING, TARGET)
    wanted = [c for c in features_of(kind, cfg) if c in df.columns]
    fill = _fills(df, wanted)
    features = [c for c in wanted if c in fill]
    if not features or kind == "datamove" and len(features) < 2:
        raise ValueError(f"too few features for {kind}")
    missing = _missing(df, features)
    return solve(kind, filled(sum(grams(df, features, missing).values()), features, missing, fill), features, fill)


def builds_in_order(df: DataFrame) -> list[str]:
    """Build names over all designs, in natural order; as many as builds, not rows."""
    return [r.build for r in df.select("build").distinct().orderBy(natural_key(F.col("build")), "build").collect()]


def split_by_build(df: DataFrame, fraction: float = 0.2) -> tuple[DataFrame, DataFrame, list[str]]:
    """Earlier builds to train on, the latest to test on."""
    names = builds_in_order(df)
    if len(names) < 2:
        raise ValueError("a split needs two builds")
    held = names[-min(len(names) - 1, max(1, math.ceil(len(names) * fraction))) :]
    return df.where(~F.col("build").isin(held)), df.where(F.col("build").isin(held)), held


def leave_one_build_out(df: DataFrame, kind: str, least: int | None = None, cfg: Config | None = None) -> dict[str, Model]:
    """A model per held-out build, linear ones all from one pass: the total Gram matrix less the build's, its own medians filled in."""
    least = (cfg or Config()).cv_min_builds if least is None else least
    names = builds_in_order(df)
    if len(names) < least:
        raise ValueError(f"cross-validation needs {least} builds")
    if kind == "baseline":
        return {b: baseline(cfg) for b in names}
    if kind == "tree":
        own = _tree_features(df, cfg)
        return trees.fit_folds(df, own, INCREASING, TARGET, "build", names)
    features = [c for c in features_of(kind, cfg) if c in df.columns]
    missing = _missing(df, features)
    # medians over all rows, and one a fold and feature with gaps: all in the same rounds
    gaps = [(n, b, c) for n, b in enumerate(names) for c in missing]
    found = quantiles(df, {c: F.col(c) for c in features}, [Ask(c, 0.5) for c in features] + [Ask(c, 0.5, but=b) for _, b, c in gaps], part="build")
    whole = {c: x for c, x in zip(features, found, strict=False) if x is not None}
    medians = {f"{c}/{n}": x for (n, _, c), x in zip(gaps, found[len(features) :], strict=True)}
    features = [c for c in features if c in whole]
    missing = [c for c in missing if c in features]
    by = grams(df, features, missing)
    total, out = sum(by.values()), {}
    for n, b in enumerate(names):
        fill = whole | {c: medians[f"{c}/{n}"] for c in missing}
        own = [c for c in features if fill[c] is not None]  # a feature that only the held-out build has
        at = [0, *[1 + features.index(c) for c in own], *[1 + len(features) + missing.index(c) for c in missing if c in own], -1]
        gaps = [c for c in missing if c in own]
        g = (total - by.get(b, 0 * total))[np.ix_(at, at)]
        out[b] = solve(kind, filled(g, own, gaps, fill), own, {c: fill[c] for c in own})
    return out


def score_folds(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Per held-out build: error metrics; each row is predicted by its build's model."""
    return _with_fold_predictions(df, models).groupBy("build").agg(*prediction_metrics(F.col(TARGET), F.col("predicted_")))


def _with_fold_predictions(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    if any(isinstance(m, trees.Tree) for m in models.values()):
        return df.withColumn("predicted_", trees.by_fold(models, "build"))
    names = sorted({c for m in models.values() for c in m.coefficients})
    rows = [(b, m.intercept, *[float(m.coefficients.get(c, 0.0)) for c in names], *[float(m.fill.get(c, 0.0)) for c in names]) for b, m in models.items()]
    w = df.sparkSession.createDataFrame(rows, ", ".join(["build string", "w0_ double", *[f"w_{c} double" for c in names], *[f"fill_{c} double" for c in names]]))
    p = sum((F.coalesce(F.col(c), F.col(f"fill_{c}")) * F.col(f"w_{c}") for c in names), F.col("w0_"))
    return df.join(F.broadcast(w), "build").withColumn("predicted_", p).drop("w0_", *[f"w_{c}" for c in names], *[f"fill_{c}" for c in names])  # a row a build


def cross_validate(df: DataFrame, kinds: list[str] | None = None, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(folds: kind, build, metrics), (summary: kind, MAPE's mean, spread and worst, mean R2, and percentiles of the error in pct)."""
    rows = None
    for kind in kinds or ["baseline", *KINDS]:
        part = _with_fold_predictions(df, leave_one_build_out(df, kind, cfg=cfg)).select(F.lit(kind).alias("kind"), "build", TARGET, "predicted_")
        rows = part if rows is None else rows.unionByName(part)
    folds = rows.groupBy("kind", "build").agg(*prediction_metrics(F.col(TARGET), F.col("predicted_")))
    off = F.when(F.col(TARGET) != 0, (F.col("predicted_") - F.col(TARGET)) / F.col(TARGET) * 100)
    kinds, places = kinds or ["baseline", *KINDS], (5, 50, 95)
    found = iter(quantiles(rows, {"off": off}, [Ask("off", q / 100, only=k) for k in kinds for q in places], part="kind"))
    limits = df.sparkSession.createDataFrame([(k, *[next(found) for _ in places]) for k in kinds], "kind string, " + ", ".join(f"p{q:02d} double" for q in places))
    spread = rows.groupBy("kind").agg(F.count(off).alias("n")).join(limits, "kind")
    summary = folds.groupBy("kind").agg(F.avg("mape").alias("mape_mean"), F.stddev_pop("mape").alias("mape_std"), F.max("mape").alias("mape_worst"), F.avg("r2").alias("r2_mean"), F.count("*").alias("n_folds"))
    return folds, summary.join(spread, "kind")


def score(df: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(kind, error metrics) of several models over the same rows, in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), m.predict().alias("p")) for k, m in models.items()])
    rows = df.select(TARGET, pairs.alias("pairs")).select(TARGET, F.inline("pairs"))
    return whole_metrics(rows, F.col(TARGET), F.col("p"), "kind", list(models))


@dataclass
class Trained:
    """Models fitted on all builds, and how models of the earlier builds scored on the held-out ones."""

    models: dict[str, Model]
    held_out: list[str]
    metrics: dict[str, dict]
    metrics_train: dict[str, dict]
    notes: list[str]

    @property
    def best(self) -> str:
        return best_model(self.metrics)


def _metrics(scored: DataFrame) -> dict[str, dict]:
    return {r.kind: {k: v for k, v in r.asDict().items() if k != "kind"} for r in scored.collect()}  # a row a kind


def train(df: DataFrame, kinds: list[str] | None = None, cfg: Config | None = None) -> Trained:
    """Fits on the earlier builds, scores on the latest, then fits again on all for use."""
    cfg = cfg or Config()
    early, late, held = split_by_build(df, cfg.test_fraction)
    fitted, notes = {}, []
    for kind in kinds or ["baseline", *KINDS]:
        try:
            fitted[kind] = fit(early, kind, cfg)
        except ValueError as e:
            notes.append(f"{kind} skipped: {e}")
    n = len(builds_in_order(df))
    if n < cfg.min_builds_warn:
        notes.append(f"only {n} builds: scores on {len(held)} of them are noisy")
    return Trained({k: fit(df, k, cfg) for k in fitted}, held, _metrics(score(late, fitted)), _metrics(score(early, fitted)), notes)


def described(model: Model) -> dict:
    """What a file of models says of one: a linear one's weights, the size of a tree's."""
    if isinstance(model, trees.Tree):
        return {"features": model.features, "trees": len(model.trees), "base": model.base}
    return {"intercept": model.intercept, "coefficients": model.coefficients, "fill": model.fill}


def evaluate(df: DataFrame, trained: Trained) -> dict[str, dict]:
    """Models in use scored on the builds once held out: in sample, as they were fitted on all builds."""
    rows = df.where(F.col("build").isin(trained.held_out))
    if not rows.limit(1).count():
        raise ValueError("none of the held-out builds is in these rows")
    return _metrics(score(rows, trained.models))


def best_model(metrics: dict[str, dict]) -> str:
    return min(metrics, key=lambda k: (metrics[k]["mape"] if metrics[k]["mape"] is not None else math.inf, k))


def improvement_pct(base: dict, other: dict, key: str = "mape") -> float | None:
    if base.get(key) in (None, 0) or other.get(key) is None:
        return None
    return (base[key] - other[key]) / base[key] * 100


def pick_model(models: dict, wanted: str | None = None, trees: bool = False) -> str:
    """The wanted kind if it is there, else the first by preference."""
    if wanted in models:
        return wanted
    for k in PREFERENCE:
        if k in models and (trees or k != "tree"):
            return k
    raise ValueError("no model to use")


def decompose(df: DataFrame, model: Linear) -> DataFrame:
    """Each part's share of the predicted power (parts clip at 0, the prediction does not), and energy per bit and mm moved."""
    terms = model.terms()
    parts = {PARTS.get(c, f"{c}_mw"): F.greatest(t, F.lit(0.0)) for c, t in terms.items()}
    whole = sum(parts.values(), F.lit(0.0))
    out = {**parts, **{f"{c}_share": F.when(whole > 0, t / whole) for c, t in parts.items()}, "intercept_mw": F.lit(model.intercept), "predicted_mw": model.predict()}
    if "movement_mw" in parts:
        moved = F.col("bits_per_cycle") * F.col("frequency_ghz") * 1e9 * F.col("avg_net_length_um") / 1000
        out["pj_per_bit_mm"] = F.when(moved > 0, parts["movement_mw"] * 1e-3 / moved * 1e12)
    return df.withColumns(out)


def decomposition_totals(parts: DataFrame) -> DataFrame:
    names = [c for c in PARTS.values() if c in parts.columns]
    return parts.groupBy("design", "workload", "operating_point").agg(*[F.sum(F.col(c).cast("decimal(28,9)")).cast("double").alias(c) for c in (*names, "predicted_mw", TARGET)])


#: Short names for overrides.
ALIASES = {"v": "voltage_v", "voltage": "voltage_v", "vdd": "voltage_v", "f": "frequency_ghz", "freq": "frequency_ghz", "frequency": "frequency_ghz", "wire": "wire_cap_pf", "wire-cap": "wire_cap_pf", "wire_cap": "wire_cap_pf", "cell": "cell_cap_pf", "cell-cap": "cell_cap_pf", "cell_cap": "cell_cap_pf", "act": "activity", "bits": "bits_per_cycle", "length": "avg_net_length_um", "fe": "fe_physical_mw", "fe-physical": "fe_physical_mw", "fe_physical": "fe_physical_mw"}


def parse_override(text: str, scale: bool = False) -> tuple[str, float | str]:
    """``feature=value`` with short names; a factor if ``scale``."""
    name, equals, value = text.partition("=")
    if not equals:
        raise ValueError(f"expected feature=value, not {text!r}")
    return ALIASES.get(name.strip(), name.strip()), f"x{float(value)}" if scale else float(value)


def what_if(df: DataFrame, model: Linear, overrides: dict[str, float | str], interval: tuple[float, float] | None = None) -> DataFrame:
    """Predictions before and after: a number sets a feature, a string like x1.2 scales it; bounds by a cross-validated error in pct."""
    changed = {ALIASES.get(k, k): v for k, v in overrides.items()}
    if unknown := set(changed) - set(df.columns):
        raise ValueError(f"no such feature: {sorted(unknown)}")
    now = with_features(df).withColumns({"current_mw": model.predict(), "cur_dyn_term": F.col("dyn_term")})
    value = lambda c, v: F.col(c) * float(v[1:]) if isinstance(v, str) else F.lit(float(v))
    then = with_features(now.withColumns({c: value(c, v) for c, v in changed.items()}))
    then = rescale_estimate(then, set(changed)).withColumn("proposed_mw", model.predict())
    if interval is not None:
        then = then.withColumns({"proposed_low_mw": F.col("proposed_mw") * (1 + interval[0] / 100), "proposed_high_mw": F.col("proposed_mw") * (1 + interval[1] / 100)})
    return then.withColumn("delta_pct", F.try_divide(F.col("proposed_mw") - F.col("current_mw"), F.col("current_mw")) * 100).drop("cur_dyn_term")


def what_if_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Summed predictions before and after, and their change."""
    sums = rows.groupBy(*by).agg(F.sum("current_mw").alias("current_mw"), F.sum("proposed_mw").alias("proposed_mw"))
    return sums.withColumn("delta_pct", F.try_divide(F.col("proposed_mw") - F.col("current_mw"), F.col("current_mw")) * 100)


#: Parts that find a front of their own before the fronts meet.
FRONTS = 256


def _front(rows: DataFrame, key: list[Column]) -> DataFrame:
    """Rows (power_, speed_) that no row of the same key beats: by falling speed, a running minimum of power tells domination."""
    by = Window.partitionBy(*key)
    faster = F.min("power_").over(by.orderBy(F.col("speed_").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # least power among rows at least as fast, and the speed of the fastest that have it
    rows = rows.withColumn("least_", faster)
    return rows.where(F.col("power_") == F.col("least_")).withColumn("top_", F.max("speed_").over(Window.partitionBy(*key, "power_"))).where(F.col("speed_") == F.col("top_")).drop("least_", "top_")


def mark_pareto(rows: DataFrame, power: str = "power_mw", speed: str = "throughput_gops", by: list[str] | None = None) -> DataFrame:
    """``pareto``: feasible, with a speed, and no feasible row of the same ``by`` beats it; ties stay.

    Distinct points are dealt by hash and each part finds its own front; only these fronts, which are short, come together
    for the front of all, whose points mark the rows that have them. No task sees all rows, even without ``by``.

    The rows are written first: points meet their rows by equality, and a sum that is computed again may differ in its last bits.
    """
    by, rows = by or [], kept(rows)
    able = F.coalesce(F.col("feasible"), F.lit(False)) & F.col(power).isNotNull() & F.col(speed).isNotNull()
    # 0 is -0: a join and a group tell them apart no more than a comparison
    points = rows.where(able).select(*[F.col(c).alias(f"by_{c}") for c in by], (F.col(power).cast("double") + 0.0).alias("power_"), (F.col(speed).cast("double") + 0.0).alias("speed_")).distinct()
    key = [F.col(f"by_{c}") for c in by]
    local = _front(points.withColumn("part_", F.pmod(F.xxhash64("power_", "speed_"), F.lit(FRONTS))), [*key, F.col("part_")]).drop("part_")
    front = _front(local, key).withColumn("pareto", F.lit(True))
    same = (rows[power].cast("double") == front.power_) & (rows[speed].cast("double") == front.speed_)
    for c in by:
        same = same & rows[c].eqNullSafe(front[f"by_{c}"])
    marked = rows.join(front, same, "left")
    return marked.withColumn("pareto", F.coalesce(able & F.col("pareto"), F.lit(False))).drop("power_", "speed_", *[f"by_{c}" for c in by])


#: Buckets of a row's hash in which it is ranked; a rank is its place in the bucket and the rows of the buckets before.
RANK_BITS = 12


def _ranked(rows: DataFrame, copy: str) -> DataFrame:
    """rows (copy, h_) with ``i_``: each copy's rows numbered from 1 by their hash, without a task that holds a copy."""
    rows = rows.withColumn("bucket_", F.shiftrightunsigned("h_", 64 - RANK_BITS))
    before = Window.partitionBy(copy).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    starts = rows.groupBy(copy, "bucket_").agg(F.count("*").alias("n_")).withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    place = F.row_number().over(Window.partitionBy(copy, "bucket_").orderBy("h_"))
    return rows.withColumn("place_", place).join(starts, [copy, "bucket_"]).withColumn("i_", F.col("start_") + F.col("place_")).drop("bucket_", "place_", "start_", "h_")


def permutation_importance(df: DataFrame, model: Linear, seed: int = 42, shuffles: int = 5) -> DataFrame:
    """Per feature: its share of how much MAPE grows on average when its values go to other rows, over the whole table.

    One job: every shuffle of every feature is a copy of that feature's column, numbered in a random order of its own and
    joined to the rows by number; only the feature's own term of a prediction changes.
    """
    names = list(model.coefficients)
    key = ["design", "build", "fub", "workload", "operating_point"]
    base = df.where(F.col(TARGET) != 0)
    rows = base.select(F.col(TARGET).alias("y"), model.predict().alias("p"), F.array(*model.terms().values()).alias("terms"), F.lit(0).alias("copy"), F.xxhash64(F.lit(seed), *key).alias("h_"))
    copies = F.array(*[F.struct(F.lit(1 + k + n * len(names)).alias("copy"), F.lit(k).alias("feature"), F.lit(seed + 1 + k + n * len(names)).alias("salt"), t.alias("moved")) for n in range(shuffles) for k, t in enumerate(model.terms().values())])
    moved = base.select(*key, F.inline(copies)).select("copy", "feature", "moved", F.xxhash64("salt", *key).alias("h_"))
    left, right = _ranked(rows, "copy").drop("copy"), _ranked(moved, "copy")
    off = lambda p: F.avg(F.abs((p - F.col("y")) / F.col("y")) * 100)
    shuffled = left.join(right, "i_").groupBy("copy", "feature").agg(off(F.col("p") - F.element_at("terms", F.col("feature") + 1) + F.col("moved")).alias("mape"))
    start = rows.agg(off(F.col("p")).alias("start"))
    gains = shuffled.groupBy("feature").agg(F.avg("mape").alias("mape")).crossJoin(F.broadcast(start)).withColumn("gain", F.greatest(F.col("mape") - F.col("start"), F.lit(0.0)))  # one row
    whole = F.sum("gain").over(Window.partitionBy(F.lit(1)))  # a row a feature
    share = F.when(whole > 0, F.col("gain") / whole).otherwise(0.0)
    return gains.select(F.element_at(F.array(*[F.lit(c) for c in names]), F.col("feature") + 1).alias("feature"), share.alias("importance"))
