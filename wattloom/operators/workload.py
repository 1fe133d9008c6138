"""Workloads: design power, energy per operation, sensitivity, and the curves behind exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import Config
from wattloom.functions.expr import pearson, ratio
from wattloom.operators.select import latest_builds


def design_power(df: DataFrame) -> DataFrame:
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,9)")).cast("double")
    return df.groupBy("design", "build", "workload", "operating_point").agg(F.count("*").alias("n_fubs"), exact("be_mw").alias("be_mw"), exact("fe_physical_mw").alias("fe_physical_mw"), F.avg("activity").alias("activity"), F.max("frequency_ghz").alias("frequency_ghz"), F.max("voltage_v").alias("voltage_v"))


def with_corner_values(performance: DataFrame, df: DataFrame) -> DataFrame:
    """Performance rows with frequency and voltage of their design, build and operating point, where they lack them."""
    need = [c for c in ("frequency_ghz", "voltage_v") if c not in performance.columns]
    if not need:
        return performance
    values = df.groupBy("design", "build", "operating_point").agg(*[F.min(c).alias(c) for c in need])
    return performance.join(values, ["design", "build", "operating_point"], "left")


def energy_per_op(power: DataFrame, performance: DataFrame) -> DataFrame:
    """mW over Gops/s is pJ an operation."""
    keys = ["design", "build", "workload", "operating_point"]
    rows = power.join(performance.select(*keys, *[c for c in ("ipc", "throughput_gops") if c in performance.columns]), keys, "left")
    return rows.withColumn("energy_pj_per_op", F.when(F.col("throughput_gops") > 0, ratio(F.col("be_mw"), F.col("throughput_gops"))))


def best_operating_point(energy: DataFrame) -> DataFrame:
    """Per design and workload, at the design's latest build: where an operation costs least."""
    latest = energy.join(latest_builds(energy), ["design", "build"], "left_semi")
    order = F.struct("energy_pj_per_op", "operating_point")
    return latest.where("energy_pj_per_op is not null").groupBy("design", "workload").agg(F.min_by("operating_point", order).alias("best_op"), F.min("energy_pj_per_op").alias("pj_per_op"))


def sensitivity(df: DataFrame) -> DataFrame:
    """Per block: least and largest mean power by workload and their ratio, over the builds that are some design's latest."""
    latest = df.join(latest_builds(df).select("build").distinct(), "build", "left_semi")
    means = latest.groupBy("design", "fub", "workload").agg(F.avg("be_mw").alias("p"))
    out = means.groupBy("design", "fub").agg(F.min("p").alias("min_mw"), F.max("p").alias("max_mw"), F.count("p").alias("n_workloads"))
    return out.withColumn("dynamic_range", F.when(F.col("min_mw") > 0, F.col("max_mw") / F.col("min_mw")))


def activity_association(df: DataFrame) -> DataFrame:
    """Per design: correlation of activity with power, and with signoff over estimate."""
    share = F.when(F.col("fe_physical_mw") > 0, F.col("be_mw") / F.col("fe_physical_mw"))
    n = F.count(F.when(F.col("activity").isNotNull() & F.col("be_mw").isNotNull(), 1))
    return df.groupBy("design").agg(n.alias("n"), pearson(F.col("activity"), F.col("be_mw")).alias("r_power"), pearson(F.col("activity"), share).alias("r_ratio"))


def _fit(y: Column, x: Column) -> list[Column]:
    flat = F.var_pop(y) > 0
    return [F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.when(flat, F.regr_r2(y, x)).alias("r2")]


def perf_model(performance: DataFrame) -> DataFrame:
    """log throughput over log frequency per design and workload; exponent 1 through the means where frequency is one."""
    rows = performance.where("throughput_gops > 0 and frequency_ghz > 0").withColumns({"lt": F.ln("throughput_gops"), "lf": F.ln("frequency_ghz")})
    single = F.ln(F.avg("throughput_gops")) - F.ln(F.avg("frequency_ghz"))
    out = rows.groupBy("design", "workload").agg(*_fit(F.col("lt"), F.col("lf")), single.alias("single"), F.countDistinct("frequency_ghz").alias("points"))
    one = F.col("points") < 2
    return out.select("design", "workload", "n", F.when(one, 1.0).otherwise(F.col("slope")).alias("exponent"), F.when(one, F.col("single")).otherwise(F.col("intercept")).alias("intercept"), F.when(~one, F.col("r2")).alias("r2"))


def dvfs_curve(df: DataFrame) -> DataFrame:
    """Voltage over frequency per design, on distinct points; constant where frequency is one."""
    points = df.select("design", "frequency_ghz", "voltage_v").where("frequency_ghz is not null and voltage_v is not null").distinct()
    out = points.groupBy("design").agg(*_fit(F.col("voltage_v"), F.col("frequency_ghz")), F.avg("voltage_v").alias("mean"), F.countDistinct("frequency_ghz").alias("f"))
    one = F.col("f") < 2
    return out.select("design", "n", F.when(one, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(one, F.col("mean")).otherwise(F.col("intercept")).alias("intercept"))


def timing_model(df: DataFrame) -> DataFrame:
    """log delay over log voltage per design and partition: delay = exp(intercept) * voltage ** slope.

    Points are the distinct ones of the latest build over all designs. Where it has fewer than two voltages, all
    builds give the slope, and the latest build's own point (if it has one; its least delay) the
    intercept. Where there is but one voltage at all, the slope is 0 through the mean delay.
    """
    rows = df.select("design", "partition", "build", "voltage_v", "clock_period_ps", "wns_ps").where("partition is not null and voltage_v is not null and clock_period_ps is not null and wns_ps is not null")
    last = latest_builds(rows.withColumn("design", F.lit("all"))).select(F.col("build").alias("last_"))
    points = rows.withColumn("delay", F.col("clock_period_ps") - F.col("wns_ps")).groupBy("design", "partition", "build", "voltage_v", "delay").agg(F.lit(1).alias("one"))
    points = points.crossJoin(F.broadcast(last)).withColumn("now", F.col("build") == F.col("last_"))  # last is one row
    at = points.where("now").groupBy("design", "partition").agg(F.countDistinct("voltage_v").alias("volts"), F.min(F.struct("voltage_v", "delay")).alias("anchor"))
    joined = points.join(at, ["design", "partition"], "left").where("now or coalesce(volts, 0) < 2")
    sound = joined.select("design", "partition", "volts", "anchor", "voltage_v", "delay").where("voltage_v > 0 and delay > 0").distinct()
    logs = sound.withColumns({"ld": F.ln("delay"), "lv": F.ln("voltage_v")})
    fitted = logs.groupBy("design", "partition").agg(*_fit(F.col("ld"), F.col("lv")), F.ln(F.avg("delay")).alias("mean_"), F.countDistinct("voltage_v").alias("v_"), F.max("volts").alias("volts"), F.max("anchor").alias("anchor"))
    anchored = F.ln("anchor.delay") - F.col("slope") * F.ln("anchor.voltage_v")
    one = F.col("v_") < 2
    intercept = F.when(one, F.col("mean_")).when(F.col("volts") == 1, anchored).otherwise(F.col("intercept"))
    return fitted.select("design", "partition", "n", F.when(one, 0.0).otherwise(F.col("slope")).alias("slope"), intercept.alias("intercept"), F.when(~one, F.col("r2")).alias("r2"))


def timing_fmax(model: DataFrame, voltage: float) -> DataFrame:
    """GHz that each design's slowest partition reaches at a voltage."""
    ghz = 1000 / F.exp(F.col("intercept") + F.coalesce("slope", F.lit(0.0)) * F.ln(F.lit(voltage)))
    return model.withColumn("ghz", ghz).groupBy("design").agg(F.min("ghz").alias("fmax_ghz"), F.min_by("partition", F.struct(F.round("ghz", 9), "partition")).alias("limited_by"))


PROFILE_KEYS = ["design", "build", "workload", "operating_point"]


#: Rows of a profile that share a time bucket, on average.
BUCKET_ROWS = 1_000_000


def profile_summary(profile: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per design, build, workload and operating point: time-weighted mean, extremes, steepest step and energy of a power profile.

    profile: windows (PROFILE_KEYS, t_start, t_end, profile_total_mw, event_id to break ties); times in ns. A profile is cut into
    buckets of time, each summed up by itself; the step into a bucket's first row is taken from the last row of the bucket
    before, so a long profile spreads over tasks and only a row a bucket comes together.
    """
    at, end = (F.unix_micros(F.to_timestamp_ltz(c)) for c in ("t_start", "t_end"))
    rows = profile.select(*PROFILE_KEYS, "event_id", at.alias("at"), ((end - at) * 1000.0).alias("dt"), F.col("profile_total_mw").alias("power"))
    spans = rows.groupBy(*PROFILE_KEYS).agg(F.min("at").alias("from_"), F.max("at").alias("to_"), F.ceil(F.count("*") / bucket_rows).alias("buckets_"))
    share = (F.col("at") - F.col("from_")) / F.when(F.col("to_") > F.col("from_"), F.col("to_") - F.col("from_")).otherwise(1)
    same = [rows[c].eqNullSafe(spans[c]) for c in PROFILE_KEYS]
    rows = rows.join(spans, same).drop(*[spans[c] for c in PROFILE_KEYS]).withColumn("bucket", F.coalesce(F.least(F.floor(share * F.col("buckets_")), F.col("buckets_") - 1), F.lit(-1).cast("long")))
    timed = F.when(F.col("dt") > 0, F.col("dt"))
    step = lambda before: ratio(F.abs(F.col("power") - before), timed)
    rows = rows.withColumn("step", step(F.lag("power").over(Window.partitionBy(*PROFILE_KEYS, "bucket").orderBy("at", "event_id"))))
    peak, order = F.struct("power", -F.col("at"), -F.col("event_id")), F.struct(F.col("at").isNotNull(), "at", "event_id")
    steepest = lambda step: F.max(F.when(step.isNotNull(), F.struct(step.alias("step"), (-F.col("event_id")).alias("later"))))
    parts = rows.groupBy(*PROFILE_KEYS, "bucket").agg(
        F.count("*").alias("n"), F.sum(timed).alias("duration"), F.sum(F.when(timed.isNotNull(), F.col("power")) * timed).alias("area"), F.max("power").alias("high"), F.min("power").alias("low"),
        F.max(peak).alias("peak"), steepest(F.col("step")).alias("inside"), F.min_by(F.struct("power", "dt", "event_id"), order).alias("first"), F.max_by(F.struct("power"), order).alias("last"),
    )
    into = F.lag("last.power").over(Window.partitionBy(*PROFILE_KEYS).orderBy("bucket"))  # a row a bucket
    parts = parts.withColumn("before", into).select("*", "first.power", "first.dt", "first.event_id").withColumn("edge", step(F.col("before")))
    parts = parts.withColumn("edge", F.when(F.col("edge").isNotNull(), F.struct(F.col("edge").alias("step"), (-F.col("event_id")).alias("later"))))
    out = parts.groupBy(*PROFILE_KEYS).agg(
        F.sum("n").alias("n_windows"), F.sum("duration").alias("duration_ns"), F.sum("area").alias("area_"), F.max("high").alias("peak_mw"), F.min("low").alias("min_mw"),
        F.max("peak").alias("peak_"), F.greatest(F.max("inside"), F.max("edge")).alias("step_"),
    ).where("duration_ns > 0")
    avg = ratio(F.col("area_"), F.col("duration_ns"))
    out = out.withColumns({"peak_at": -F.col("peak_.col3"), "max_step_mw_per_ns": F.col("step_.step"), "step_at": -F.col("step_.later"), "avg_mw": avg})
    return out.withColumns({"energy_uj": F.col("area_") * 1e-6, "peak_to_avg": F.when(F.col("avg_mw") > 0, F.col("peak_mw") / F.col("avg_mw"))}).drop("area_", "peak_", "step_")


def reconcile(summary: DataFrame, df: DataFrame, performance: DataFrame | None = None, cfg: Config | None = None) -> DataFrame:
    """A profile's mean against the power that the wide table sums up, and energy per operation; a missing side is no fault."""
    expected = df.groupBy(*PROFILE_KEYS).agg(F.sum(F.col("be_mw").cast("decimal(28,9)")).cast("double").alias("reported_avg_mw"))
    gap = F.when(F.col("reported_avg_mw") > 0, (F.col("avg_mw") - F.col("reported_avg_mw")) / F.col("reported_avg_mw") * 100)
    out = summary.join(expected, PROFILE_KEYS, "left").withColumn("avg_gap_pct", gap)
    out = out.withColumn("profile_ok", ~F.coalesce(F.abs("avg_gap_pct") > (cfg or Config()).anomaly_profile_tol_pct, F.lit(False)))
    if performance is None:
        return out.withColumn("energy_pj_per_op", F.lit(None).cast("double"))
    speed = performance.groupBy(*PROFILE_KEYS).agg(F.min("throughput_gops").alias("gops_"))
    return out.join(speed, PROFILE_KEYS, "left").withColumn("energy_pj_per_op", F.when(F.col("gops_") > 0, F.col("avg_mw") / F.col("gops_"))).drop("gops_")
