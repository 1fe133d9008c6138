"""The Markdown report: what the stored tables say, section by section; and sentences that interpret the numbers.

Each section is a small table computed where the data are; its first rows reach the driver. A section that
fails is a note in the report, not the end of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import ingest
from wattloom.config import Config
from wattloom.operators import anomalies, builds, closure, identity, models, quality, stats, workload
from wattloom.operators.select import latest_builds, select_slice

#: Rows of a section that the report shows.
SHOWN = 20
#: Fixed texts.
STAGES = {"logical": "FE logical", "physical": "FE physical"}


def percent(x: float | None, signed: bool = False) -> str:
    return "n/a" if x is None else f"{x:+.1f}%" if signed else f"{x:.1f}%"


def plain(x) -> str:
    if x is None:
        return ""
    if isinstance(x, float):
        return f"{x:,.3f}" if abs(x) < 1e6 else f"{x:.4g}"
    if isinstance(x, list):
        return ", ".join(map(plain, x))
    return str(x).replace("|", "\\|")


def table(df: DataFrame, n: int = SHOWN) -> str:
    rows = df.limit(n + 1).collect()
    if not rows:
        return "(none)"
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *("| " + " | ".join(map(plain, r)) + " |" for r in rows[:n])]
    return "\n".join(lines + (["", f"(first {n} rows)"] if len(rows) > n else []))


def strength_word(r: float | None) -> str:
    a = abs(r) if r is not None else 0.0
    return next((w for limit, w in ((0.9, "very strongly"), (0.7, "strongly"), (0.5, "moderately"), (0.3, "weakly")) if a >= limit), "not meaningfully")


def interpret(df: DataFrame, stage: str = "physical", features: list[str] | None = None) -> list[str]:
    """Sentences on a stage's error: its direction and size, what it goes with, and its drift over builds."""
    m = stats.stage_metrics(df, stage).first()
    if not m.n:
        return ["No rows with both an estimate and signoff power."]
    bias = -(m.mean_error_pct or 0.0)
    out = [f"{STAGES[stage]} power {'underestimates' if bias > 0 else 'overestimates'} signoff power by {percent(abs(bias))} on average (MAPE {percent(m.mape)}, P95 {percent(m.p95_ape)}, R2 {plain(m.r2)})."]
    features = [c for c in features or [*quality.FEATURES, "wire_cap_fraction"] if c in df.columns]
    for unit, said in (("pct", "Percentage error is most strongly associated with"), ("mw", "Absolute error (mW) is most associated with")):
        top = stats.associations(df, f"{stage}_error_{unit}", features).first() if f"{stage}_error_{unit}" in df.columns and features else None
        if top is not None and top.r is not None:
            out.append(f"{said} {top.feature} (r={top.r:.2f}, {strength_word(top.r)}): an association in these data, not a cause.")
    trends = stats.error_trend(df, stage).orderBy("design").collect()
    out += [f"{t.design}: mean error {t.trend} across builds ({percent(t.first_pct, True)} -> {percent(t.last_pct, True)}, {t.slope:+.1f} points a build)." for t in trends]
    return out if trends else [*out, "Too few builds to tell whether the error drifts."]


def compare_stages(df: DataFrame) -> str:
    """Which estimate predicts signoff better."""
    logical, physical = (stats.stage_metrics(df, s).first() for s in ("logical", "physical"))
    if logical.mape is None or physical.mape is None:
        return "Too few data to compare the stages."
    if physical.mape < logical.mape:
        less = (logical.mape - physical.mape) / logical.mape * 100 if logical.mape else 0.0
        return f"FE physical power is more predictive of signoff power than FE logical power (MAPE {percent(physical.mape)} vs {percent(logical.mape)}, {percent(less)} less; R2 {plain(physical.r2)} vs {plain(logical.r2)})."
    return f"FE logical power is at least as predictive as FE physical power (MAPE {percent(logical.mape)} vs {percent(physical.mape)}). Check that the physical estimate has the same activity."


def sections(spark: SparkSession, out: str, cfg: Config, budgets: list | None = None) -> dict[str, Callable[[], str]]:
    raw, rows = ingest.load_dataset(spark, out, raw=True, cfg=cfg), ingest.load_dataset(spark, out, cfg=cfg)
    stored = lambda name: ingest.load_table(spark, out, name)
    corner = select_slice(rows, latest=False)
    performance = stored("performance")
    found = {
        "Summary": lambda: table(stats.summarize(rows)),
        "Missing features": lambda: table(stats.missing_features(rows)),
        "Estimates against signoff": lambda: "\n\n".join([compare_stages(rows), table(stats.stage_metrics(rows, "physical", ["design"]).orderBy("design"))]),
        "Logical estimate": lambda: "\n\n".join(interpret(rows, "logical")),
        "Physical estimate": lambda: "\n\n".join(interpret(rows, "physical")),
        "Error by build": lambda: table(stats.stage_metrics(rows, "physical", ["build"]).orderBy("build")),
        "Largest errors": lambda: table(stats.top_errors(rows, "physical", "pct", cfg.top_n_errors)),
        "Correlation with signoff power": lambda: table(stats.with_p(stats.associations(rows, "be_mw", [c for c in [*quality.FEATURES, "fe_logical_mw", "fe_physical_mw"] if c in rows.columns]))),
        "Data quality": lambda: "\n\n".join([table(quality.quality_report(quality.sanitize(raw, cfg, stored("lineage"), stored("power_intent")))), table(quality.flag_counts(quality.sanitize(raw, cfg, stored("lineage"), stored("power_intent"))).orderBy("flag"))]),
        "Trust in metrics": lambda: table(quality.metric_quality(raw, long=stored("measurements_long")).orderBy("metric")),
        "Records by source": lambda: table(stored("measurements_long").groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("source_file").alias("files")).orderBy("source")),
        "Lineage": lambda: table(stored("lineage").select(F.explode("lineage_issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy("issue")),
        "Unmapped objects": lambda: table(stored("unmapped").groupBy("object", "object_kind").agg(F.count("*").alias("n")).orderBy("object")),
        "Power intent": lambda: table(identity.intent_summary(stored("power_intent")).orderBy("design", "build")),
        "Second engine": lambda: table(stats.qualify(rows, tolerance=cfg.qualify_tolerance_pct)),
        "Builds": lambda: table(builds.build_deltas(corner).orderBy("design", "from_build")),
        "Partitions between builds": lambda: table(builds.partition_deltas(corner).orderBy("design", "from_build", "partition")),
        "Largest movers": lambda: table(builds.movers(corner).orderBy("design", "place")),
        "Power and speed": lambda: table(builds.frontier(corner, performance).orderBy("design", "build")),
        "Hotspots": lambda: table(builds.hotspots(corner).select("design", "build", "model_root", "be_mw", "share_pct", "density", "delta_pct", "hotspot", "regressed", "low_cg").orderBy(F.col("be_mw").desc())),
        "Hotspots by partition": lambda: table(builds.hotspot_partitions(builds.hotspots(corner)).orderBy(F.col("power_mw").desc())),
        "Anomalies": lambda: table(anomalies.report(rows, cfg=cfg).orderBy("design", "place")),
        "Rules without a verdict": lambda: table(anomalies.skipped(rows, cfg).orderBy("design", "rule")),
        "Anomalies by owner": lambda: table(anomalies.by_owner(anomalies.report(rows, cfg=cfg).where("status <> 'cleared'")).orderBy(F.col("high").desc(), F.col("findings").desc())),
        "Energy per operation": lambda: table(workload.energy_per_op(workload.design_power(rows), performance).orderBy("design", "build", "workload", "operating_point")),
        "Best operating points": lambda: table(workload.best_operating_point(workload.energy_per_op(workload.design_power(rows), performance)).orderBy("design", "workload")),
        "Range over workloads": lambda: table(workload.sensitivity(rows).orderBy(F.col("dynamic_range").desc_nulls_last())),
        "Curves": lambda: "\n\n".join([table(workload.dvfs_curve(rows).orderBy("design")), table(workload.timing_model(rows).orderBy("design", "partition"))]),
        "Models by held-out build": lambda: table(models.cross_validate(rows, ["baseline", *(k for k in models.KINDS if k != "tree")], cfg)[1].orderBy("mape_mean")),
        "Power over time": lambda: table(stored("power_profile").groupBy("design", "build", "workload", "operating_point").agg(F.count("*").alias("windows"), F.max("profile_total_mw").alias("peak_mw")).orderBy("design", "build")),
    }
    if budgets:
        asked = closure.budget_table(spark, budgets)
        found["Budgets"] = lambda: table(closure.budget_status(closure.budget_history(raw, asked), closure.ranks_of(raw), stored("lineage")).orderBy("budget"))
        found["Convergence"] = lambda: table(closure.converge(closure.budget_history(raw, asked), closure.ranks_of(raw)).orderBy("budget"))
        found["Closure plan"] = lambda: table(closure.closure_plan(rows, asked, closure.converge(closure.budget_history(raw, asked), closure.ranks_of(raw)))[0].orderBy("budget", "rank"))
    return found


def write_report(spark: SparkSession, out: str, cfg: Config | None = None, budgets: list | None = None) -> str:
    """The report as Markdown text."""
    cfg = cfg or Config()
    last = latest_builds(ingest.load_dataset(spark, out, raw=True, cfg=cfg)).orderBy("design").collect()  # a row a design
    lines = ["# Power report", "", "Latest builds: " + ", ".join(f"{r.design} {r.build}" for r in last), ""]
    for title, make in sections(spark, out, cfg, budgets).items():
        try:
            body = make()
        except Exception as e:  # noqa: BLE001  a section is worth a note, not the report
            body = f"(not available: {type(e).__name__}: {str(e).splitlines()[0][:160]})"
        lines += [f"## {title}", "", body, ""]
    return "\n".join(lines)
