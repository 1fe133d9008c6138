"""How well estimates predict signoff: error metrics, correlations, summaries, tool qualification."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.expr import natural_key, pearson, ratio
from wattloom.operators.ranks import Ask, quantiles


def prediction_metrics(actual: Column, predicted: Column, percentiles: bool = True) -> list[Column]:
    """Aggregates over finite pairs; missing where nothing is defined. ``percentiles`` meet in one task a group."""
    both = actual.isNotNull() & predicted.isNotNull()
    y, p = F.when(both, actual), F.when(both, predicted)
    error = p - y
    share = F.when(y != 0, error / y)
    ape = F.abs(share) * 100
    total = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(ape).alias("mape"),
        (F.avg(share) * 100).alias("mean_error_pct"),
        F.when(total > 0, 1 - F.sum(error * error) / total).alias("r2"),
        *([F.percentile(ape, F.lit(0.5)).alias("p50_ape"), F.percentile(ape, F.lit(0.95)).alias("p95_ape")] if percentiles else []),
    ]


def whole_metrics(df: DataFrame, actual: Column, predicted: Column, part: str | None = None, parts: list[str | None] | None = None) -> DataFrame:
    """prediction_metrics over the whole table, or each of a few named parts of it, without a task that holds all errors."""
    out = df.groupBy(*([part] if part else [])).agg(*prediction_metrics(actual, predicted, percentiles=False))
    ape = F.when(actual != 0, F.abs((predicted - actual) / actual)) * 100
    names = [None] if part is None else list(parts)
    asks = [Ask("ape", q, only=n) for n in names for q in (0.5, 0.95)]
    found = quantiles(df, {"ape": ape}, asks, part)
    rows = [(n, *found[2 * i : 2 * i + 2]) for i, n in enumerate(names)]
    if part is None:
        return out.withColumns({c: F.lit(x).cast("double") for c, x in zip(("p50_ape", "p95_ape"), rows[0][1:], strict=True)})
    return out.join(df.sparkSession.createDataFrame(rows, f"{part} string, p50_ape double, p95_ape double"), part)


def stage_metrics(df: DataFrame, stage: str, by: list[str] | None = None) -> DataFrame:
    actual, predicted = F.col("be_mw"), F.col(f"fe_{stage}_mw")
    return df.groupBy(*by).agg(*prediction_metrics(actual, predicted)) if by else whole_metrics(df, actual, predicted)


def top_errors(df: DataFrame, stage: str, by: str, n: int = 10) -> DataFrame:
    """The n rows of largest absolute error, in mW or pct; ties by key."""
    key = ["design", "build", "fub", "workload", "operating_point"]
    return df.select(*key, f"{stage}_error_mw", f"{stage}_error_pct").orderBy(F.abs(f"{stage}_error_{by}").desc_nulls_last(), *key).limit(n)


def error_trend(df: DataFrame, stage: str) -> DataFrame:
    """Per design: slope of the mean error in pct (positive: the estimate is too low) over builds in natural order, and its word."""
    share = F.when(F.col("be_mw") != 0, (F.col("be_mw") - F.col(f"fe_{stage}_mw")) / F.col("be_mw") * 100)
    by = df.groupBy("design", "build").agg(F.avg(share).alias("e")).where("e is not null")
    order = Window.partitionBy("design").orderBy(natural_key(F.col("build")))
    ranked = by.withColumn("i", F.row_number().over(order).cast("double"))
    first, last = F.min_by("e", "i"), F.max_by("e", "i")
    word = F.when(F.abs(last - first) < 2, "is roughly stable").when(last > first, "grows").otherwise("shrinks")
    return ranked.groupBy("design").agg(F.count("*").alias("n_builds"), F.regr_slope("e", "i").alias("slope"), first.alias("first_pct"), last.alias("last_pct"), word.alias("trend")).where("n_builds >= 3")


def associations(df: DataFrame, target: str, candidates: list[str]) -> DataFrame:
    """(feature, n, r), strongest first: all pairs in one aggregate."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1)).alias("n"), pearson(F.col(c).cast("double"), F.col(target)).alias("r")) for c in candidates])
    return df.agg(rows.alias("rows")).select(F.inline("rows")).orderBy(F.abs("r").desc_nulls_last(), "feature")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair in order, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation of n pairs: I_x((n - 2) / 2, 1 / 2) at x = 1 - r * r."""
    if r is None or n < 3:
        return None
    a, b, x = (n - 2) / 2, 0.5, max(0.0, 1 - r * r)
    if n == 2 or x == 0 or a == 0:
        return 0.0
    if x == 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p(found: DataFrame) -> DataFrame:
    """Associations (r, n) with their p-values; a row a feature."""

    @F.pandas_udf("double")
    def of(r, n):
        import pandas as pd

        return pd.Series([pearson_p(None if pd.isna(x) else float(x), int(k)) for x, k in zip(r, n, strict=True)], dtype="float64")

    return found.withColumn("p", of("r", "n"))


def strength_word(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.9, "very strongly").when(a >= 0.7, "strongly").when(a >= 0.5, "moderately").when(a >= 0.3, "weakly").otherwise("not meaningfully")


#: Features whose missing values a summary counts.
COUNTED = ["wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "frequency_ghz"]


def missing_features(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, n) of features that miss some value."""
    names = [c for c in features or COUNTED if c in df.columns]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("n")) for c in names])
    return df.agg(rows.alias("rows")).select(F.inline("rows")).where("n > 0")


def summarize(df: DataFrame) -> DataFrame:
    be = F.col("be_mw")
    median, p05, p95 = (F.lit(x).cast("double") for x in quantiles(df, {"be_mw": be}, [Ask("be_mw", q) for q in (0.5, 0.05, 0.95)]))
    distinct = lambda *c: F.countDistinct(F.struct(*c))
    return df.agg(
        F.count("*").alias("n_rows"), F.count(be).alias("n_be"), F.avg(be).alias("mean"), median.alias("median"), p05.alias("p05"), p95.alias("p95"),
        F.min(be).alias("min"), F.max(be).alias("max"), F.sum(be.cast("decimal(28,9)")).cast("double").alias("total"),
        F.countDistinct("design").alias("n_designs"), distinct("design", "build").alias("n_builds"), distinct("design", "fub").alias("n_fubs"),
    )


def qualify(df: DataFrame, engine: str = "be_voltus_mw", by: list[str] | None = None, tolerance: float = 5.0) -> DataFrame:
    """A second engine against signoff: errors, bias of sums, correlation, and the verdict."""
    y, p = F.col("be_mw"), F.col(engine)
    both = y.isNotNull() & p.isNotNull()
    ape = F.when(y != 0, F.abs(p - y) / F.abs(y) * 100)
    p95 = F.percentile(ape, F.lit(0.95)) if by else F.lit(quantiles(df.where(both), {"ape": ape}, [Ask("ape", 0.95)])[0]).cast("double")
    out = df.where(both).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(ape).alias("mape"), p95.alias("p95"), F.sum(y).alias("sum_be"), F.sum(p).alias("sum_engine"), pearson(p, y).alias("r"))
    return out.withColumn("bias_pct", ratio(F.col("sum_engine") - F.col("sum_be"), F.col("sum_be")) * 100).withColumn("passed", (F.col("mape") <= tolerance) & (F.col("p95") <= 2 * tolerance))
