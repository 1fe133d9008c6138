"""Exploration of operating points, and compact models that leave the engine as one JSON document a design.

Scenarios are a small table that meets the rows of the latest builds in one job, however many they are:
each scenario's rows are changed, features derived again, and predicted power summed. Speed, voltage and
feasibility come from the fitted curves (see workload.py).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import workload
from wattloom.operators.derive import TRIGGERS, with_features
from wattloom.operators.models import Linear, mark_pareto
from wattloom.operators.select import latest_builds

#: How far above the fitted limit a frequency still counts as feasible.
SLACK = 1.005
#: What scenarios may change.
FEATURES = ["fe_physical_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "frequency_ghz", "voltage_v", "activity", "bits_per_cycle", "avg_net_length_um"]


@dataclass(frozen=True)
class Scenario:
    """``frequency_ghz`` takes the voltage that the design's curve gives, unless ``voltage_v`` is given; sets and scales change features."""

    name: str
    design: str
    workload: str = "typical"
    operating_point: str | None = None
    frequency_ghz: float | None = None
    voltage_v: float | None = None
    sets: dict[str, float] = field(default_factory=dict, hash=False)
    scales: dict[str, float] = field(default_factory=dict, hash=False)
    baseline: str | None = None  # the scenario that changes are told against


SCHEMA = "place int, name string, design string, workload string, at_op string, f_ double, v_ double, sets map<string, double>, scales map<string, double>, baseline string"


def scenario_table(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    for s in scenarios:
        if unknown := (set(s.sets) | set(s.scales)) - set(FEATURES):
            raise ValueError(f"no such feature: {sorted(unknown)}")
    number = lambda d: {k: float(v) for k, v in d.items()}
    opt = lambda x: None if x is None else float(x)
    rows = [(i, s.name, s.design, s.workload, s.operating_point, opt(s.frequency_ghz), opt(s.voltage_v), number(s.sets), number(s.scales), s.baseline) for i, s in enumerate(scenarios)]
    return spark.createDataFrame(rows, SCHEMA)


def evaluate(df: DataFrame, scenarios: DataFrame, model: Linear, performance: DataFrame | None = None, interval: tuple[float, float] | None = None) -> DataFrame:
    """A row a scenario that has rows: its corner, power (and its bounds), speed, energy, feasibility, changes against its baseline, and Pareto mark."""
    rows = df.join(latest_builds(df), ["design", "build"], "left_semi")
    defaults = rows.groupBy("design", "workload").agg(F.coalesce(F.max(F.when(F.col("operating_point") == "nom", F.col("operating_point"))), F.min("operating_point")).alias("default_op"))
    rows = rows.join(scenarios, ["design", "workload"]).join(defaults, ["design", "workload"]).where(F.col("operating_point") == F.coalesce("at_op", "default_op"))
    rows = rows.join(workload.dvfs_curve(df).select("design", F.col("slope").alias("c1_"), F.col("intercept").alias("c0_")), "design", "left")  # a row a design
    rows = with_features(rows).withColumn("cur_dyn_term", F.col("dyn_term"))
    follow = F.coalesce("v_", F.when(F.col("f_").isNotNull(), F.col("c0_") + F.col("c1_") * F.col("f_")), "voltage_v")
    rows = rows.withColumns({"voltage_v": follow, "frequency_ghz": F.coalesce("f_", "frequency_ghz")})
    at = lambda m, c: F.try_element_at(m, F.lit(c))
    changed = {c: F.coalesce(at("sets", c), F.col(c) * F.coalesce(at("scales", c), F.lit(1.0))) for c in FEATURES if c in rows.columns}
    rows = with_features(rows.withColumns(changed))
    named = lambda c: F.coalesce(F.map_contains_key("sets", c), F.lit(False)) | F.coalesce(F.map_contains_key("scales", c), F.lit(False))
    moved = F.col("f_").isNotNull() | F.col("v_").isNotNull()
    for c in TRIGGERS:
        moved = moved | named(c)
    by = F.when(moved & ~named("fe_physical_mw"), F.coalesce(F.try_divide(F.col("dyn_term"), F.col("cur_dyn_term")), F.lit(1.0))).otherwise(1.0)
    rows = rows.withColumn("fe_physical_mw", F.col("fe_physical_mw") * by)
    keys = ["place", "name", "design", "workload", "baseline"]
    out = rows.groupBy(*keys).agg(F.min("frequency_ghz").alias("frequency_ghz"), F.min("voltage_v").alias("voltage_v"), F.sum(model.predict()).alias("power_mw"))
    if performance is None:
        out = out.withColumn("throughput_gops", F.lit(None).cast("double"))
    else:
        speed = workload.perf_model(workload.with_corner_values(performance, df)).select("design", "workload", "exponent", F.col("intercept").alias("a_"))
        out = out.join(speed, ["design", "workload"], "left").withColumn("throughput_gops", F.when(F.col("frequency_ghz") > 0, F.exp(F.col("a_") + F.col("exponent") * F.ln("frequency_ghz")))).drop("a_", "exponent")
    out = _with_limit(out, workload.timing_model(df).select("design", "partition", F.col("slope").alias("k_"), F.col("intercept").alias("a_")))
    low, high = (F.lit(None).cast("double"),) * 2 if interval is None else (F.col("power_mw") * (1 + interval[0] / 100), F.col("power_mw") * (1 + interval[1] / 100))
    out = out.withColumns({"power_low_mw": low, "power_high_mw": high, "energy_pj": F.when(F.col("throughput_gops") > 0, F.col("power_mw") / F.col("throughput_gops"))})
    base = out.select(F.col("name").alias("baseline"), F.col("power_mw").alias("p_"), F.col("throughput_gops").alias("t_"), F.col("energy_pj").alias("e_"))
    out = out.join(base, "baseline", "left")
    pct = lambda a, b: F.coalesce(F.try_divide(F.col(a) - F.col(b), F.col(b)) * 100, F.when(F.col("baseline").isNull(), 0.0))
    out = out.withColumns({"delta_power_pct": pct("power_mw", "p_"), "delta_perf_pct": pct("throughput_gops", "t_"), "delta_energy_pct": pct("energy_pj", "e_")})
    return mark_pareto(out.drop("p_", "t_", "e_"))


def _with_limit(rows: DataFrame, timing: DataFrame) -> DataFrame:
    """rows (design, voltage_v, frequency_ghz) with the slowest partition's limit at that voltage, and whether the frequency is within it."""
    ghz = 1000 / F.exp(F.col("a_") + F.col("k_") * F.ln("voltage_v"))
    limits = rows.where("voltage_v > 0").select("design", "voltage_v").distinct().join(timing, "design").withColumn("ghz_", ghz)
    worst = limits.groupBy("design", "voltage_v").agg(F.min("ghz_").alias("fmax_ghz"), F.min_by("partition", F.struct(F.round("ghz_", 9), "partition")).alias("critical_partition"))
    out = rows.join(worst, ["design", "voltage_v"], "left")
    within = F.col("fmax_ghz").isNull() | (F.col("frequency_ghz") <= F.col("fmax_ghz") * SLACK)
    return out.withColumn("feasible", F.coalesce(within, F.lit(True)))


def sweep(design: str, at: str, feature: str, values: list[float], scale: bool = False, operating_point: str | None = None, fixed_voltage: bool = False) -> list[Scenario]:
    """A baseline, then one scenario a value; a swept frequency takes its voltage along unless that is fixed."""
    base = f"{design} baseline"
    out = [Scenario(base, design, at, operating_point)]
    for v in values:
        own = {"baseline": base, "operating_point": operating_point}
        if feature == "frequency_ghz" and not scale and not fixed_voltage:
            out.append(Scenario(f"{design} f={v:g}", design, at, frequency_ghz=v, **own))
        elif scale:
            out.append(Scenario(f"{design} {feature}x{v:g}", design, at, scales={feature: v}, **own))
        else:
            out.append(Scenario(f"{design} {feature}={v:g}", design, at, sets={feature: v}, **own))
    return out


def operating_map(df: DataFrame, design: str, at: str, candidates: list[tuple[float, float]] = ()) -> list[Scenario]:
    """Each measured operating point, the first by name being the baseline, then candidate (voltage, frequency) points."""
    points = sorted(r.operating_point for r in df.where(F.col("design") == design).select("operating_point").distinct().collect())  # a row a point
    base = f"{design} {points[0]} (measured)" if points else None
    out = [Scenario(f"{design} {p} (measured)", design, at, p, baseline=base) for p in points]
    return out + [Scenario(f"{design} V={v:g} f={f:g}", design, at, frequency_ghz=f, voltage_v=v, baseline=base) for v, f in candidates]


def with_baselines(scenarios: list[Scenario]) -> list[Scenario]:
    """One baseline for each design, workload and operating point, before the first scenario there."""
    out, known = [], set()
    for s in scenarios:
        name = f"baseline {s.design}/{s.workload}/{s.operating_point or 'default'}"
        if name not in known:
            known.add(name)
            out.append(Scenario(name, s.design, s.workload, s.operating_point))
        out.append(Scenario(**{**s.__dict__, "baseline": name}))
    return out


def from_control_file(found: list[dict]) -> list[Scenario]:
    """Scenarios as config.read_scenarios gives them."""
    out = []
    for s in found:
        changes = s["overrides"]
        own = {k: v for k, v in changes.items() if k in ("frequency_ghz", "voltage_v") and not isinstance(v, str)}
        sets = {k: v for k, v in changes.items() if not isinstance(v, str) and k not in own}
        scales = {k: float(v[1:]) for k, v in changes.items() if isinstance(v, str)}
        out.append(Scenario(s["name"], s["design"], s.get("workload") or "typical", s.get("operating_point"), own.get("frequency_ghz"), own.get("voltage_v"), sets, scales))
    return out


#: Features of a block that do not vary with the workload, and those that do.
PHYSICAL = ["wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "net_count", "wire_length_um", "avg_net_length_um"]
ACTIVITY = ["activity", "bits_per_cycle"]
#: Terms that are derived from them at a corner.
TERMS = ["total_cap_pf", "wire_cap_fraction", "dyn_term", "leak_term", "cell_dyn_term", "wire_dyn_term", "move_term"]
DOCUMENT = "struct<format: string, version: int, design: string, latest_build: string, model_kind: string, intercept: double, coefficients: map<string, double>, fill: map<string, double>, error_interval_pct: struct<p05: double, p95: double>, operating_points: map<string, struct<voltage_v: double, frequency_ghz: double>>, fubs: array<struct<model_root: string, fub: string, partition: string, physical: map<string, double>, workloads: array<struct<workload: string, activity: double, bits_per_cycle: double>>>>, dvfs: struct<c0: double, c1: double>, perf: map<string, struct<a: double, b: double, r2: double>>, timing: map<string, struct<a: double, k: double>>>"


def _literal(d: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))]) if d else F.create_map().cast("map<string, double>")


def export_compact(df: DataFrame, model: Linear, performance: DataFrame | None = None, interval: tuple[float, float] | None = None) -> DataFrame:
    """(design, document): what evaluates the model away from here. A document grows with a design's blocks."""
    last = latest_builds(df)
    rows = df.join(last, ["design", "build"], "left_semi")
    entries = lambda pairs: F.map_from_entries(F.sort_array(F.collect_list(pairs)))
    by = rows.groupBy("design", "model_root", "workload").agg(*[F.avg(c).alias(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ACTIVITY], F.min("fub").alias("fub"), F.min("partition").alias("partition"), *[F.min(c).alias(c) for c in PHYSICAL if c in df.columns])
    measured = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in PHYSICAL if c in df.columns]), F.array(*[F.min(c) for c in PHYSICAL if c in df.columns])), lambda k, v: v.isNotNull())
    blocks = by.groupBy("design", "model_root").agg(F.min("fub").alias("fub"), F.min("partition").alias("partition"), measured.alias("physical"), F.sort_array(F.collect_list(F.struct("workload", *ACTIVITY))).alias("workloads"))
    fubs = blocks.groupBy("design").agg(F.sort_array(F.collect_list(F.struct("model_root", "fub", "partition", F.map_entries("physical").alias("physical"), "workloads"))).alias("fubs"))
    fubs = fubs.withColumn("fubs", F.transform("fubs", lambda f: F.struct(f["model_root"].alias("model_root"), f["fub"].alias("fub"), f["partition"].alias("partition"), F.map_from_entries(f["physical"]).alias("physical"), f["workloads"].alias("workloads"))))
    points = rows.groupBy("design", "operating_point").agg(F.struct(F.min("voltage_v").alias("voltage_v"), F.min("frequency_ghz").alias("frequency_ghz")).alias("at")).groupBy("design").agg(entries(F.struct("operating_point", "at")).alias("operating_points"))
    curve = workload.dvfs_curve(df).select("design", F.struct(F.col("intercept").alias("c0"), F.col("slope").alias("c1")).alias("dvfs"))
    timing = workload.timing_model(df).groupBy("design").agg(entries(F.struct("partition", F.struct(F.col("intercept").alias("a"), F.col("slope").alias("k")))).alias("timing"))
    out = last.join(fubs, "design").join(points, "design", "left").join(curve, "design", "left").join(timing, "design", "left")
    if performance is None:
        out = out.withColumn("perf", F.lit(None).cast("map<string, struct<a: double, b: double, r2: double>>"))
    else:
        speed = workload.perf_model(workload.with_corner_values(performance, df))
        out = out.join(speed.groupBy("design").agg(entries(F.struct("workload", F.struct(F.col("intercept").alias("a"), F.col("exponent").alias("b"), "r2"))).alias("perf")), "design", "left")
    bounds = F.lit(None).cast("struct<p05: double, p95: double>") if interval is None else F.struct(F.lit(float(interval[0])).alias("p05"), F.lit(float(interval[1])).alias("p95"))
    whole = F.struct(
        F.lit("wattloom-compact-power-model").alias("format"), F.lit(1).alias("version"), "design", F.col("build").alias("latest_build"), F.lit(model.kind).alias("model_kind"), F.lit(float(model.intercept)).alias("intercept"),
        _literal(model.coefficients).alias("coefficients"), _literal(model.fill).alias("fill"), bounds.alias("error_interval_pct"), "operating_points", "fubs", "dvfs", "perf", "timing",
    )
    return out.select("design", F.to_json(whole).alias("document"))


def read_compact(documents: DataFrame) -> DataFrame:
    return documents.select("design", F.from_json("document", DOCUMENT).alias("m"))


def compact_power(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (row, design, workload, frequency_ghz, voltage_v, activity_scale) with ``power_mw``: summed over the design's blocks, without clipping.

    A workload that a block does not know counts as its first one.
    """
    m = read_compact(documents).select("design", F.col("m.intercept").alias("intercept_"), F.col("m.coefficients").alias("coefficients_"), F.col("m.fill").alias("fill_"), F.explode("m.fubs").alias("f_"))
    keyed = rows.join(m, "design")
    known = F.filter("f_.workloads", lambda w: w["workload"] == F.col("workload"))
    at = F.when(F.size(known) > 0, F.try_element_at(known, F.lit(1))).otherwise(F.try_element_at(F.col("f_.workloads"), F.lit(1)))
    keyed = keyed.withColumns({"w_": at, **{c: F.try_element_at(F.col("f_.physical"), F.lit(c)) for c in PHYSICAL}})
    keyed = keyed.withColumns({c: F.col(f"w_.{c}") * F.col("activity_scale") for c in ACTIVITY})
    featured = with_features(keyed)
    known_terms = [c for c in (*TERMS, *PHYSICAL, *ACTIVITY, "frequency_ghz", "voltage_v") if c in featured.columns]
    weight = lambda c: F.coalesce(F.try_element_at("coefficients_", F.lit(c)), F.lit(0.0))
    power = sum((weight(c) * F.coalesce(F.col(c), F.try_element_at("fill_", F.lit(c)), F.lit(0.0)) for c in known_terms), F.col("intercept_"))
    rest = F.map_filter("coefficients_", lambda k, _: ~k.isin(known_terms))
    others = F.aggregate(F.map_entries(rest), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at("fill_", e["key"]), F.lit(0.0)))
    return featured.groupBy("row").agg(F.sum(power + others).alias("power_mw"))


def run_trace(documents: DataFrame, trace: DataFrame) -> DataFrame:
    """A trace (design, interval_no, duration_s, workload; operating_point or frequency_ghz and voltage_v; activity_scale) over compact models.

    Per interval: corner, power, throughput, energy, operations, pJ an operation, and whether timing holds. A frequency
    alone takes its voltage from the design's curve.
    """
    for c, kind in (("operating_point", "string"), ("frequency_ghz", "double"), ("voltage_v", "double"), ("activity_scale", "double")):
        if c not in trace.columns:
            trace = trace.withColumn(c, F.lit(None).cast(kind))
    m = read_compact(documents)
    rows = trace.join(m.select("design", "m.operating_points", "m.dvfs", "m.perf"), "design").withColumn("point_", F.try_element_at("operating_points", F.col("operating_point")))
    given = F.col("operating_point").isNotNull()
    f = F.when(given, F.col("point_.frequency_ghz")).otherwise(F.col("frequency_ghz"))
    rows = rows.withColumn("frequency_ghz", f).withColumn("voltage_v", F.when(given, F.col("point_.voltage_v")).otherwise(F.coalesce("voltage_v", F.col("dvfs.c0") + F.col("dvfs.c1") * F.col("frequency_ghz"))))
    curve = F.try_element_at("perf", F.col("workload"))
    rows = rows.withColumns({"activity_scale": F.coalesce("activity_scale", F.lit(1.0)), "throughput_gops": F.when(F.col("frequency_ghz") > 0, F.exp(curve["a"] + curve["b"] * F.ln("frequency_ghz")))})
    rows = rows.drop("operating_points", "dvfs", "perf", "point_").withColumn("row", F.xxhash64("design", "interval_no", "workload", "operating_point", "frequency_ghz", "voltage_v", "activity_scale"))
    corners = rows.select("row", "design", "workload", "frequency_ghz", "voltage_v", "activity_scale").dropDuplicates(["row"])
    rows = rows.join(compact_power(documents, corners), "row", "left").drop("row")
    timing = m.select("design", F.explode("m.timing").alias("partition", "t")).select("design", "partition", F.col("t.a").alias("a_"), F.col("t.k").alias("k_"))
    rows = _with_limit(rows, timing).withColumnRenamed("feasible", "timing_ok")
    out = rows.withColumns({"energy_mj": F.col("power_mw") * F.col("duration_s"), "ops": F.col("throughput_gops") * 1e9 * F.col("duration_s")})
    return out.withColumn("energy_pj_per_op", F.when(F.col("throughput_gops") > 0, F.col("power_mw") / F.col("throughput_gops")))


def trace_totals(timeline: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Time, energy, operations, mean and peak power, pJ an operation and intervals beyond the timing limit."""
    sums = timeline.groupBy(*(by or [])).agg(F.sum("duration_s").alias("duration_s"), F.sum("energy_mj").alias("energy_mj"), F.sum("ops").alias("ops"), F.max("power_mw").alias("peak_power_mw"), F.count_if(~F.col("timing_ok")).alias("timing_violations"))
    return sums.withColumns({"avg_power_mw": F.try_divide("energy_mj", "duration_s"), "energy_pj_per_op": F.when(F.col("ops") > 0, F.col("energy_mj") * 1e9 / F.col("ops"))})


def trace_shares(timeline: DataFrame) -> DataFrame:
    """Per workload: shares of time and energy."""
    whole = timeline.agg(F.sum("duration_s").alias("t_"), F.sum("energy_mj").alias("e_"))
    by = timeline.groupBy("workload").agg(F.sum("duration_s").alias("time_s"), F.sum("energy_mj").alias("energy_mj"), F.sum("ops").alias("ops"))
    return by.crossJoin(F.broadcast(whole)).withColumns({"share_time": F.try_divide("time_s", "t_"), "share_energy": F.try_divide("energy_mj", "e_")}).drop("t_", "e_")  # whole is one row
