"""Budgets, convergence to them, and techniques that save power.

Nothing here runs a job: sides of a few rows (budgets, corners, latest builds) are joined plainly, and adaptive execution
broadcasts what it has measured to be small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.functions.expr import ratio
from wattloom.operators.select import build_ranks, latest_builds

#: Fixed tolerances in pct by milestone.
MILESTONES = {"rtl": 25.0, "synthesis": 15.0, "placement": 10.0, "route": 5.0, "signoff": 0.0}
#: Fixed: the metrics that budgets are set on, and the component of power that each follows.
METRICS = {"cdyn_pf": "dynamic", "be_leakage_mw": "leakage", "be_dynamic_mw": "dynamic", "be_mw": "total"}
#: Fixed effects of techniques.
GATING_EFFECT, GATING_TARGET, POWER_GATING, DUTY, WIRE_PCT, VT_EFFECT, VT_SLACK_PS, DEFAULT_LEAKAGE = 0.35, 0.90, 0.9, 0.5, 10.0, 0.4, 20.0, 0.15
FLAT = 1e-12
BUDGET = ["budget", "design", "scope", "member", "metric", "target"]


@dataclass(frozen=True)
class Budget:
    """A target; without a workload or an operating point its scope's default corner is meant."""

    design: str
    scope: str  # design, partition:x, fub:x or model_root:x
    metric: str
    target: float
    workload: str | None = None
    operating_point: str | None = None
    tolerance_pct: dict[str, float] = field(default_factory=lambda: dict(MILESTONES), hash=False)
    owner: str | None = None
    note: str | None = None


def budget_table(spark: SparkSession, budgets: list[Budget]) -> DataFrame:
    for b in budgets:
        if b.scope.partition(":")[0] not in ("design", "partition", "fub", "model_root"):
            raise ValueError(f"unknown scope {b.scope}")
    rows = [(i, b.design, *b.scope.partition(":")[::2], b.metric, float(b.target), b.workload, b.operating_point, b.tolerance_pct, b.owner) for i, b in enumerate(budgets)]
    return spark.createDataFrame(rows, "budget int, design string, scope string, member string, metric string, target double, at_workload string, at_op string, tolerance_pct map<string, double>, owner_ string")


def classify_status(actual: Column, target: Column, tolerance: Column) -> Column:
    limit = target * (1 + tolerance / 100)
    margin = ratio(limit - actual, target) * 100
    return F.when(actual > limit, "OVER").when(margin < F.greatest(tolerance, F.lit(2.0)) * 0.5, "AT RISK").otherwise("ON TRACK")


def _with_budgets(df: DataFrame, budgets: DataFrame, member: bool = True) -> DataFrame:
    """Rows of each budget's design and scope at its workload and operating point, by default of that scope."""
    names = [c for c in budgets.columns if c != "design"]
    rows = df.drop(*names).join(budgets, "design")
    if member:
        inside = F.when(F.col("scope") == "design", F.lit(True))
        for c in ("partition", "fub", "model_root"):
            if c in df.columns:
                inside = inside.when(F.col("scope") == c, F.col(c) == F.col("member"))
        rows = rows.where(inside)
    preferred = lambda c, value: F.coalesce(F.max(F.when(F.col(c) == value, F.col(c))), F.min(c))
    defaults = rows.groupBy("budget").agg(preferred("workload", "typical").alias("default_workload"), preferred("operating_point", "nom").alias("default_op"))
    rows = rows.join(defaults, "budget")  # a row a budget
    return rows.where((F.col("workload") == F.coalesce("at_workload", "default_workload")) & (F.col("operating_point") == F.coalesce("at_op", "default_op")))


def _metric() -> Column:
    out = F.lit(None).cast("double")
    for m in METRICS:
        out = F.when(F.col("metric") == m, F.col(m)).otherwise(out)
    return out


def budget_history(df: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget and build: the sum over its scope (missing if all are), the build's milestone and tolerance, margin and status."""
    rows = _with_budgets(df, budgets).withColumn("value_", _metric())
    milestone = F.max("milestone") if "milestone" in df.columns else F.lit(None).cast("string")
    sums = rows.groupBy(*BUDGET, "build").agg(F.sum(F.col("value_").cast("decimal(28,9)")).cast("double").alias("actual"), F.countDistinct("fub").alias("n_fubs"), F.coalesce(milestone, F.lit("signoff")).alias("milestone"), F.first("tolerance_pct").alias("by_milestone")).where("actual is not null")
    tolerance = F.coalesce(F.try_element_at("by_milestone", F.col("milestone")), F.lit(0.0))
    out = sums.withColumn("tolerance_pct", tolerance).drop("by_milestone")
    limit = F.col("target") * (1 + F.col("tolerance_pct") / 100)
    return out.withColumns({"margin_pct": ratio(limit - F.col("actual"), F.col("target")) * 100, "status": classify_status(F.col("actual"), F.col("target"), F.col("tolerance_pct"))})


def _latest(history: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per budget: its last build's row, and the slope of ``actual`` over builds where there are three."""
    order = Window.partitionBy("budget").orderBy("build_rank")
    rows = history.join(ranks, ["design", "build"]).withColumn("i", F.row_number().over(order).cast("double"))
    at = F.struct("build", "milestone", "actual", "tolerance_pct", "margin_pct", "status", "n_fubs")
    out = rows.groupBy(*BUDGET).agg(F.max_by(at, "i").alias("at"), F.count("*").alias("n_builds"), F.regr_slope("actual", "i").alias("slope"))
    return out.select(*BUDGET, "at.*", "n_builds", F.when(F.col("n_builds") >= 3, F.col("slope")).alias("trend"))


def budget_status(history: DataFrame, ranks: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Per budget: status at the last build, trend in pct of the target a build, and blocks measured of those expected.

    lineage (design, build, fub, partition, model_root) tells which blocks a scope has; 0 expected without it.
    """
    out = _latest(history, ranks).withColumn("trend_pct", ratio(F.col("trend"), F.col("target")) * 100).drop("trend").withColumnRenamed("n_fubs", "fubs_measured")
    if lineage is None:
        return out.withColumn("fubs_expected", F.lit(0).cast("long"))
    inside = F.when(F.col("scope") == "design", F.lit(True)).when(F.col("scope") == "partition", F.col("l.partition") == F.col("member")).when(F.col("scope") == "fub", F.col("l.fub") == F.col("member")).otherwise(F.col("l.model_root") == F.col("member"))
    near = out.select("budget", "design", "build", "scope", "member")  # a row a budget
    known = lineage.alias("l").join(near, ["design", "build"]).where(inside)
    return out.join(known.groupBy("budget").agg(F.countDistinct("l.fub").alias("fubs_expected")), "budget", "left").fillna(0, ["fubs_expected"])


def converge(history: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per budget: gap, the cut of the actual that closes it, trend a build, verdict and builds to go (0 if there, infinite if never)."""
    out = _latest(history, ranks)
    gap, trend = F.col("actual") - F.col("target"), F.col("trend")
    verdict = F.when(gap <= 0, "CONVERGED").when(trend.isNull() | (F.abs(trend) < FLAT), "FLAT").when(trend < 0, "CONVERGING").otherwise("DIVERGING")
    cut = F.when(F.col("actual") > 0, F.greatest(gap, F.lit(0.0)) / F.col("actual") * 100).otherwise(0.0)
    out = out.withColumns({"gap": gap, "gap_pct": ratio(gap, F.col("target")) * 100, "required_cut_pct": cut, "verdict": verdict})
    builds = F.when(F.col("verdict") == "CONVERGING", F.col("gap") / -F.col("trend")).when(F.col("verdict") == "CONVERGED", 0.0).otherwise(float("inf"))
    return out.withColumn("builds_to_target", builds)


def dyn_leak(df: DataFrame, decomposition: DataFrame | None = None) -> DataFrame:
    """Dynamic and leakage parts: measured leakage, else (where none is measured) a decomposition's, else an assumed share."""
    assumed = F.col("be_mw") * DEFAULT_LEAKAGE
    if "be_leakage_mw" in df.columns and (decomposition is None or df.where("be_leakage_mw is not null").limit(1).count()):
        leak = F.least(F.coalesce("be_leakage_mw", assumed), F.col("be_mw"))
    elif decomposition is not None:
        on = [c for c in ("design", "build", "model_root", "workload", "operating_point") if c in decomposition.columns]
        look = decomposition.groupBy(*on).agg(F.min("leakage_mw").alias("leakage_"))
        df, leak = df.join(look, on, "left"), F.coalesce("leakage_", assumed)
    else:
        leak = assumed
    return df.withColumn("leak", leak).withColumn("dyn", F.col("be_mw") - F.col("leak")).drop("leakage_")


def _saving(df: DataFrame, technique: str, saving: Column, dynamic: Column | float, leakage: Column | float) -> DataFrame:
    keys = [c for c in ("budget", "design", "build", "fub") if c in df.columns]
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(*keys, F.lit(technique).alias("technique"), saving.alias("saving_mw"), part(dynamic).alias("dynamic_mw"), part(leakage).alias("leakage_mw")).where("saving_mw > 0")


def clock_gating(rows: DataFrame) -> DataFrame:
    s = F.col("dyn") * GATING_EFFECT * F.greatest(GATING_TARGET - F.col("cg_efficiency"), F.lit(0.0))
    return _saving(dyn_leak(rows), "clock_gating", s, s, 0.0)


def power_gating(idle_rows: DataFrame, duty: float = DUTY) -> DataFrame:
    """Toward convergence only the leakage part counts: idle dynamic power is none at the target's workload."""
    return _saving(dyn_leak(idle_rows), "power_gating", F.col("be_mw") * duty * POWER_GATING, 0.0, F.col("leak") * duty * POWER_GATING)


def wire_cap_reduction(rows: DataFrame, pct: float = WIRE_PCT) -> DataFrame:
    total = F.col("wire_cap_pf") + F.col("cell_cap_pf")
    s = F.col("dyn") * F.when(total > 0, F.col("wire_cap_pf") / total) * pct / 100
    return _saving(dyn_leak(rows), "wire_cap_reduction", s, s, 0.0)


def vt_swap(rows: DataFrame, slack_ps: float = VT_SLACK_PS) -> DataFrame:
    s = F.col("leak") * VT_EFFECT
    return _saving(dyn_leak(rows).where(F.col("wns_ps") > slack_ps), "vt_swap", s, 0.0, s)


def dvfs(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per design: the operating points of least and most power per GHz, and the power between them. rows: one build and workload."""
    by = by or ["design"]
    points = rows.groupBy(*by, "operating_point").agg(F.sum(F.col("be_mw").cast("decimal(28,9)")).cast("double").alias("power_mw"), F.max("frequency_ghz").alias("f")).withColumn("cost", ratio(F.col("power_mw"), F.col("f")))
    order = F.struct("cost", "f", "operating_point")
    last = F.struct("cost", -F.col("f"), "operating_point")
    out = points.where("cost is not null").groupBy(*by).agg(F.count("*").alias("n_points"), F.min_by(F.struct("operating_point", "power_mw", "cost"), order).alias("a"), F.max_by(F.struct("operating_point", "power_mw", "cost"), last).alias("b"))
    return out.select(*by, "n_points", F.col("a.operating_point").alias("best_op"), F.col("b.operating_point").alias("worst_op"), F.col("a.cost").alias("best_mw_per_ghz"), F.col("b.cost").alias("worst_mw_per_ghz"), F.greatest(F.col("b.power_mw") - F.col("a.power_mw"), F.lit(0.0)).alias("saving_mw"))


@dataclass(frozen=True)
class Technique:
    """What saves power: the columns that it needs, and its savings from the rows that ``at`` names.

    ``corner``: a budget's rows at its workload and operating point; ``idle``: those at the idle workload; ``points``: those at all
    operating points of its workload.
    """

    needs: list[str]
    savings: Callable[[DataFrame], DataFrame]
    at: str = "corner"


def _dvfs_savings(rows: DataFrame) -> DataFrame:
    moved = dvfs(rows, ["budget"]).where("n_points > 1")
    none = F.lit(None).cast("double")
    return moved.select("budget", F.lit("dvfs").alias("technique"), "saving_mw", none.alias("dynamic_mw"), none.alias("leakage_mw"))


#: The techniques by name; register one by adding it.
TECHNIQUES = {
    "clock_gating": Technique(["be_mw", "cg_efficiency"], clock_gating),
    "wire_cap_reduction": Technique(["wire_cap_pf", "cell_cap_pf"], wire_cap_reduction),
    "vt_swap": Technique(["wns_ps"], vt_swap),
    "power_gating": Technique(["be_mw"], power_gating, "idle"),
    "dvfs": Technique(["voltage_v", "frequency_ghz"], _dvfs_savings, "points"),
}
NAMES = {"clock_gating": "Clock gating", "power_gating": "Power gating", "dvfs": "Voltage and frequency scaling", "wire_cap_reduction": "Wire capacitance reduction", "vt_swap": "Vt swap", "operand_isolation": "Operand isolation", "glitch_reduction": "Glitch reduction", "memory_low_power": "Memory low-power modes"}
NOT_ASSESSABLE = {"operand_isolation": "toggle counts with datapath enables", "glitch_reduction": "a glitch-aware power report", "memory_low_power": "memory instances and their mode power"}


def idle_workload(df: DataFrame) -> DataFrame:
    """One row (idle): ``idle`` if there is one, else the workload of least power; null where there is but one workload."""
    found = df.groupBy("workload").agg(F.sum("be_mw").alias("p"))
    least = F.min_by("workload", F.struct(F.col("p").isNull(), "p", "workload"))
    named = F.max(F.when(F.col("workload") == "idle", F.col("workload")))
    return found.agg(F.when(F.count("*") > 1, F.coalesce(named, least)).alias("idle"))


def assess_all(df: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per budget, at its design's latest build and corner: (savings by technique and component), and (technique, needs) of those not assessable."""
    spark = df.sparkSession
    latest = df.join(latest_builds(df), ["design", "build"], "left_semi")
    idle = idle_workload(df)
    at_idle = budgets.crossJoin(F.broadcast(idle.where("idle is not null"))).withColumn("at_workload", F.col("idle")).drop("idle")  # one row
    rows = {
        "corner": _with_budgets(latest, budgets, member=False),
        "idle": _with_budgets(latest, at_idle, member=False),
        "points": _at_workload(latest, budgets),
    }
    needs, out = dict(NOT_ASSESSABLE), None
    for name, technique in TECHNIQUES.items():
        absent = [c for c in technique.needs if c not in df.columns]
        if absent:
            needs[name] = ", ".join(absent)
            continue
        found = technique.savings(rows[technique.at]).select("budget", "technique", "saving_mw", "dynamic_mw", "leakage_mw")
        out = found if out is None else out.unionByName(found)
    exact = lambda c: F.sum(F.round(c, 8).cast("decimal(28,8)")).cast("double").alias(c)
    sums = out.groupBy("budget", "technique").agg(exact("saving_mw"), exact("dynamic_mw"), exact("leakage_mw"))
    no_idle = [n for n, t in TECHNIQUES.items() if t.at == "idle" and n not in needs]
    lost = idle.where("idle is null").select(F.explode(F.array(*[F.lit(n) for n in no_idle]).cast("array<string>")).alias("technique"), F.lit("an idle workload").alias("needs"))
    return sums, spark.createDataFrame(list(needs.items()), "technique string, needs string").unionByName(lost)


def _at_workload(latest: DataFrame, budgets: DataFrame) -> DataFrame:
    """Each budget's design at all operating points of its workload."""
    rows = latest.drop(*[c for c in budgets.columns if c != "design"]).join(budgets.withColumn("at_op", F.lit(None).cast("string")), "design")
    preferred = rows.groupBy("budget").agg(F.coalesce(F.max(F.when(F.col("workload") == "typical", F.col("workload"))), F.min("workload")).alias("default_workload"))
    return rows.join(preferred, "budget").where(F.col("workload") == F.coalesce("at_workload", "default_workload"))


def closure_plan(df: DataFrame, budgets: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, skipped) per budget: techniques by what they save of the target's own component and unit, largest first.

    gaps: of ``converge``. A line has its running total, the share of the gap that it covers, and what is left after all.
    """
    savings, _ = assess_all(df, budgets)
    scoped = _with_budgets(df.join(latest_builds(df), ["design", "build"], "left_semi"), budgets)
    corner = scoped.groupBy("budget").agg(F.max("voltage_v").alias("v"), F.max("frequency_ghz").alias("f"))
    component = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    at = budgets.select("budget", "at_op").join(gaps.select(*BUDGET, "gap"), "budget")
    rows = savings.join(at, "budget").join(corner, "budget", "left").withColumn("component", component[F.col("metric")])
    mw = F.when(F.col("component") == "total", F.col("saving_mw")).when(F.col("component") == "dynamic", F.col("dynamic_mw")).otherwise(F.col("leakage_mw"))
    rows = rows.withColumn("mw", F.coalesce(mw, F.lit(0.0)))
    rows = rows.withColumn("saving", F.when(F.col("metric") == "cdyn_pf", ratio(F.col("mw"), F.col("v") * F.col("v") * F.col("f"))).otherwise(F.col("mw")))
    reason = F.when((F.col("technique") == "dvfs") & ((F.col("component") != "total") | F.col("at_op").isNotNull()), F.lit("changes the corner")).when(F.col("mw") <= 0, F.concat(F.lit("no "), "component", F.lit(" saving"))).when(F.col("saving").isNull(), F.lit("no voltage and frequency"))
    rows = rows.withColumn("reason", reason)
    order = Window.partitionBy("budget").orderBy(F.col("saving").desc(), "technique")
    whole = Window.partitionBy("budget")
    lines = rows.where("reason is null").withColumns({"rank": F.row_number().over(order), "cumulative": F.sum("saving").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total_": F.sum("saving").over(whole)})
    covers = F.when(F.col("gap") > 0, F.col("saving") / F.col("gap") * 100)
    lines = lines.select(*BUDGET, "technique", "saving", "rank", "cumulative", covers.alias("covers_pct"), F.greatest(F.col("gap") - F.col("total_"), F.lit(0.0)).alias("remainder"))
    return lines, rows.where("reason is not null").select(*BUDGET, "technique", "reason")


def ranks_of(df: DataFrame) -> DataFrame:
    return build_ranks(df)
