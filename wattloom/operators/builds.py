"""From build to build: deltas, the power-frequency frontier, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.expr import fmax, ratio
from wattloom.operators.select import with_rank

POWER_TOLERANCE_PCT, TIMING_TOLERANCE_PS = 0.5, 1.0


def classify(power_pct: Column, timing_ps: Column) -> Column:
    """What a move between builds is; missing timing is asked first."""
    p, t = POWER_TOLERANCE_PCT, TIMING_TOLERANCE_PS
    less, more, faster, slower = power_pct < -p, power_pct > p, timing_ps > t, timing_ps < -t
    return (
        F.when(timing_ps.isNull(), "timing unknown")
        .when(power_pct.isNull(), "power unknown")
        .when(~less & ~more & ~faster & ~slower, "neutral")
        .when((less & ~slower) | (faster & ~more), "pareto improvement")
        .when((more & ~faster) | (slower & ~less), "regression")
        .when(faster & more, "power-for-performance trade")
        .otherwise("performance-for-power trade")
    )


#: What deltas are told of, where the rows have it.
DELTA_METRICS = ["be_mw", "fe_physical_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "wire_length_um"]


def _pairs(df: DataFrame) -> DataFrame:
    """Blocks in two consecutive builds of a design: one row with ``from`` and ``to`` values."""
    metrics = [c for c in [*DELTA_METRICS, "wns_ps"] if c in df.columns]
    speed = fmax(F.col("clock_period_ps"), F.col("wns_ps"))
    ranked = with_rank(df).select("design", "build", "build_rank", "model_root", "fub", "partition", speed.alias("fmax_ghz"), *metrics)
    later = ranked.select("design", "model_root", (F.col("build_rank") - 1).alias("build_rank"), F.struct("build", "fmax_ghz", *metrics).alias("to"))
    return ranked.withColumn("from", F.struct("build", "fmax_ghz", *metrics)).select("design", "model_root", "fub", "partition", "build_rank", "from").join(later, ["design", "model_root", "build_rank"])


def _exact(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(28,9)")).cast("double")


def _pct(a: str, b: str) -> Column:
    return ratio(F.col(b) - F.col(a), F.col(a)) * 100


def build_deltas(df: DataFrame) -> DataFrame:
    """Per pair of consecutive builds of a design: totals over blocks in both, worst timing, and the move's class."""
    metrics = [c for c in DELTA_METRICS if c in df.columns]
    sums = [_exact(f"{side}.{m}").alias(f"{side}_{m}") for m in metrics for side in ("from", "to")]
    worst = [F.min(f"{side}.{m}").alias(f"{side}_{m}") for m in ("wns_ps", "fmax_ghz") for side in ("from", "to")]
    out = _pairs(df).groupBy("design", F.col("from.build").alias("from_build"), F.col("to.build").alias("to_build")).agg(F.count("*").alias("n_fubs"), *sums, *worst)
    out = out.withColumns({f"{m}_pct": _pct(f"from_{m}", f"to_{m}") for m in metrics})
    return out.withColumn("move", classify(F.col("be_mw_pct"), F.col("to_wns_ps") - F.col("from_wns_ps")))


def partition_deltas(df: DataFrame) -> DataFrame:
    """The same per partition, whose timing is one value a build."""
    out = _pairs(df).where("partition is not null").groupBy("design", F.col("from.build").alias("from_build"), F.col("to.build").alias("to_build"), "partition").agg(_exact("from.be_mw").alias("from_mw"), _exact("to.be_mw").alias("to_mw"), F.min("from.wns_ps").alias("from_wns_ps"), F.min("to.wns_ps").alias("to_wns_ps"))
    out = out.withColumn("power_pct", _pct("from_mw", "to_mw"))
    return out.withColumn("move", classify(F.coalesce("power_pct", F.lit(0.0)), F.col("to_wns_ps") - F.col("from_wns_ps")))


def movers(df: DataFrame, n: int = 5) -> DataFrame:
    """Per design, the blocks whose power changed most, in pct, between its last two builds."""
    pairs = _pairs(df)
    last = pairs.groupBy("design").agg(F.max("build_rank").alias("last_"))
    rows = pairs.join(last, "design").where(F.col("build_rank") == F.col("last_")).select("design", "model_root", F.col("from.be_mw").alias("from_mw"), F.col("to.be_mw").alias("to_mw")).withColumn("power_pct", _pct("from_mw", "to_mw"))
    order = Window.partitionBy("design").orderBy(F.abs("power_pct").desc_nulls_last(), "model_root")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def frontier(df: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Per design and build: power, speed, whether another build is no worse in both and better in one, and the move since the build before.

    Domination is a running minimum: builds by falling speed, by rank so that equal speeds are one step.
    """
    speed = fmax(F.col("clock_period_ps"), F.col("wns_ps"))
    points = df.groupBy("design", "build", "workload", "operating_point").agg(F.sum(F.col("be_mw").cast("decimal(28,9)")).cast("double").alias("power_mw"), F.min(speed).alias("fmax_ghz"), F.min("wns_ps").alias("wns_ps"))
    keys = ["design", "build", "workload", "operating_point"]
    if performance is None:
        points = points.withColumn("throughput_gops", F.lit(None).cast("double"))
    else:
        points = points.join(performance.groupBy(*keys).agg(F.min("throughput_gops").alias("throughput_gops")), keys, "left")
    same = Window.partitionBy("design", "fmax_ghz")
    ranked = points.withColumn("rank_", F.dense_rank().over(Window.partitionBy("design").orderBy(F.col("fmax_ghz").desc_nulls_last())))
    before = Window.partitionBy("design").orderBy("rank_").rangeBetween(Window.unboundedPreceding, -1)
    dominated = (F.min("power_mw").over(before) <= F.col("power_mw")) | (F.min("power_mw").over(same) < F.col("power_mw"))
    pareto = F.col("fmax_ghz").isNotNull() & ~F.coalesce(dominated, F.lit(False))
    order = Window.partitionBy("design").orderBy("build_rank")
    out = with_rank(ranked.withColumn("pareto", pareto).drop("rank_"))
    prev_mw, prev_wns = F.lag("power_mw").over(order), F.lag("wns_ps").over(order)
    move = F.when(F.col("wns_ps").isNotNull() & prev_wns.isNotNull(), classify(F.coalesce(ratio(F.col("power_mw") - prev_mw, prev_mw) * 100, F.lit(0.0)), F.col("wns_ps") - prev_wns)).otherwise("")
    return out.withColumn("status", move).drop("workload", "operating_point", "build_rank")


def hotspots(df: DataFrame, share_pct: float = 2.0, density_quantile: float = 0.8) -> DataFrame:
    """Blocks of one build and corner a design: share, density, change since the build before, flags."""
    ranked = with_rank(df)
    key = ["design", "model_root"]
    earlier = ranked.select(*key, (F.col("build_rank") + 1).alias("build_rank"), F.col("be_mw").alias("prev_mw"))
    top = Window.partitionBy("design")
    now = ranked.withColumn("last_", F.max("build_rank").over(top)).where("build_rank = last_").join(earlier, [*key, "build_rank"], "left")
    share = ratio(F.col("be_mw"), F.sum("be_mw").over(top)) * 100
    density = F.when(F.col("area") > 0, F.col("be_mw") / F.col("area"))
    out = now.withColumns({"share_pct": share, "density": density, "delta_pct": F.when(F.col("prev_mw") > 0, (F.col("be_mw") - F.col("prev_mw")) / F.col("prev_mw") * 100)})
    out = out.withColumn("cut_", F.percentile("density", F.lit(density_quantile)).over(top))
    return out.withColumns({"hotspot": (F.col("share_pct") >= share_pct) & (F.col("density") >= F.col("cut_")), "regressed": F.coalesce(F.col("delta_pct") > 5, F.lit(False)), "low_cg": F.coalesce((F.col("cg_efficiency") < 0.6) & (F.col("share_pct") >= 1), F.lit(False))}).drop("last_", "cut_")


def hotspot_partitions(spots: DataFrame) -> DataFrame:
    """Partitions of the hotspot table: sums, density, and the change of their summed power."""
    out = spots.where("partition is not null").groupBy("design", "partition").agg(F.count("*").alias("n_fubs"), F.sum("be_mw").alias("power_mw"), F.sum("share_pct").alias("share_pct"), F.sum("area").alias("area"), F.sum(F.col("hotspot").cast("long")).alias("n_hotspots"), F.sum("prev_mw").alias("prev_mw"))
    return out.withColumns({"density": F.when(F.col("area") > 0, F.col("power_mw") / F.col("area")), "delta_pct": F.when(F.col("prev_mw") > 0, (F.col("power_mw") - F.col("prev_mw")) / F.col("prev_mw") * 100)}).drop("prev_mw")
