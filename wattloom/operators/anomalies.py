"""Power anomaly rules over all builds at once, in one pass; a report compares the latest build with the one before.

Rules are columns, not queries: each adds what it needs to the rows of the reference corner (workload ``typical`` and
operating point ``nom`` where a design has them, else the first by name), mostly over windows that rules share, and
judges a row by them. What was found is exploded at the end, so the rows are read once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattloom.config import Config
from wattloom.functions.expr import ratio
from wattloom.operators.select import build_ranks, with_rank

#: Fixed thresholds that no setting changes.
ROBUST_Z, LEAKAGE_SHARE, LEAST_BLOCKS = 3.0, 0.25, 8
IDLE = "idle"
ID = ["design", "build", "model_root", "fub", "partition", "owner"]
FINDING = [*ID, "rule", "severity", "value", "threshold", "unit", "evidence", "technique", "workload", "operating_point"]


@dataclass(frozen=True)
class Found:
    """What a rule says of a row: whether it is a finding, and the finding's figures."""

    hit: Column
    value: Column
    threshold: Column
    evidence: Column
    workload: Column | None = None


@dataclass(frozen=True)
class Rule:
    """How a rule is called, what it needs, what it may point at, and how it judges rows.

    ``judge`` tells of each row at its design's reference corner what was found, from the context's columns and those that the
    rule adds before: ``over_workloads`` to all rows at the reference operating point, then one ``stages`` after the other
    to those at the reference workload. Windows of one shape are computed once a stage for all rules.
    """

    name: str
    label: str
    severity: str
    unit: str
    technique: str | None
    needs: tuple[str, ...]
    judge: Callable[[Config], Found]
    stages: Callable[[Config], list[dict[str, Column]]] = lambda cfg: []
    over_workloads: Callable[[Config], dict[str, Column]] = lambda cfg: {}


def context(df: DataFrame) -> DataFrame:
    """The rows with their build's rank and their design's reference corner; both come from one narrow aggregate."""
    preferred = lambda c, value: F.coalesce(F.max(F.when(F.col(c) == value, F.col(c))), F.min(c))
    points = df.select("design", "build", "workload", "operating_point").distinct()
    corners = points.groupBy("design").agg(preferred("workload", "typical").alias("ref_workload"), preferred("operating_point", "nom").alias("ref_op"))
    for c in ("partition", "owner"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.join(build_ranks(points), ["design", "build"]).join(corners, "design")


def _say(text: str, *values: Column) -> Column:
    return F.format_string(text, *[F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in values])


def _of_block() -> WindowSpec:
    return Window.partitionBy("design", "model_root").orderBy("build_rank")


def _of_build(*more: str) -> WindowSpec:
    return Window.partitionBy("design", "build", *more)


def _idle_dynamic(cfg: Config) -> Found:
    """Blocks that burn dynamic power while idle."""
    v = F.when((F.col("ref_") > 0) & (F.col("ref_workload") != IDLE) & (F.col("first_") == 1), ratio(F.col("idle_"), F.col("ref_")))
    said = F.concat(_say("idle dynamic %,.1f mW is %.0f%% of ", F.col("idle_"), v * 100), F.col("ref_workload"), _say(" (%,.1f mW)", F.col("ref_")))
    return Found(v > cfg.anomaly_idle_ratio, v, F.lit(cfg.anomaly_idle_ratio), said, F.lit(IDLE))


def _over_workloads(cfg: Config) -> dict[str, Column]:
    by = Window.partitionBy(*ID, "operating_point")
    at = lambda w: F.max(F.when(F.col("workload") == w, F.col("be_dynamic_mw"))).over(by)
    first = F.row_number().over(Window.partitionBy(*ID, "operating_point").orderBy(F.col("workload") != F.col("ref_workload")))
    return {"idle_": at(F.lit(IDLE)), "ref_": at(F.col("ref_workload")), "first_": first}


def _activity_power_mismatch(cfg: Config) -> Found:
    """Dynamic power per activity, capacitance and corner far above the blocks' median, in robust z of logarithms."""
    mad = F.col("mad_")
    z = (F.col("log_") - F.col("mid_")) / F.when(mad > 0, mad).otherwise(1e-9)
    v = F.exp(F.col("log_") - F.col("mid_"))
    said = _say("dynamic power per activity, capacitance and corner is %.1fx the design median (robust z %.1f); activity %.2f, dynamic %,.1f mW", v, z, F.col("activity"), F.col("be_dynamic_mw"))
    return Found((F.col("n_log_") >= LEAST_BLOCKS) & (v >= cfg.anomaly_eff_ratio) & (z >= ROBUST_Z), v, F.lit(cfg.anomaly_eff_ratio), said)


def _efficiency(cfg: Config) -> list[dict[str, Column]]:
    drive = F.col("activity") * (F.col("wire_cap_pf") + F.col("cell_cap_pf")) * F.col("voltage_v") * F.col("voltage_v") * F.col("frequency_ghz")
    eff = F.when(drive > 0, F.col("be_dynamic_mw") / drive)
    return [{"log_": F.when(eff > 0, F.ln(eff))}, {"mid_": F.median("log_").over(_of_build()), "n_log_": F.count("log_").over(_of_build())}, {"mad_": F.median(F.abs(F.col("log_") - F.col("mid_"))).over(_of_build()) * 1.4826}]


def _unexplained_regression(cfg: Config) -> Found:
    """Growth of dynamic power since a block's last build beyond what its capacitance and activity (else its area) explain."""
    pct = lambda c: ratio(F.col(c) - F.col(f"prev_{c}"), F.col(f"prev_{c}")) * 100
    growth = F.when(F.col("prev_be_dynamic_mw") > 0, pct("be_dynamic_mw"))
    drivers, area = F.when(F.col("prev_cap_") > 0, pct("driver_")), F.when(F.col("prev_area") > 0, pct("area"))
    explained = F.coalesce(drivers, area, F.lit(0.0))
    named = F.when(drivers.isNotNull(), "activity and capacitance").when(area.isNotNull(), "area").otherwise("no driver")
    v = growth - explained
    said = F.concat(_say("dynamic %,.1f -> %,.1f mW (%+.1f%%) vs ", F.col("prev_be_dynamic_mw"), F.col("be_dynamic_mw"), growth), F.col("prev_build"), F.lit("; "), named, _say(" explain %+.1f%%", explained))
    return Found((growth > cfg.anomaly_regression_pct) & (v > cfg.anomaly_regression_pct), v, F.lit(cfg.anomaly_regression_pct), said)


def _previous(cfg: Config) -> list[dict[str, Column]]:
    cap = F.col("wire_cap_pf") + F.col("cell_cap_pf")
    first = {"cap_": cap, "driver_": cap * F.when(F.col("activity") > 0, F.col("activity")).otherwise(1.0)}
    return [first, {f"prev_{c}": F.lag(c).over(_of_block()) for c in ("be_dynamic_mw", "driver_", "cap_", "area", "build")}]


def _creeping_growth(cfg: Config) -> Found:
    """Strict growth of dynamic power over the last builds in a row that adds up."""
    n = cfg.anomaly_creep_builds
    steps = [F.col("be_dynamic_mw")] + [F.col(f"back_{k}") for k in range(1, n + 1)]
    rising = (F.col("build_rank") - F.col("rank_back_") == n) & (steps[-1] > 0)
    for a, b in zip(steps, steps[1:], strict=False):
        rising = rising & (a > b)
    v = ratio(steps[0] - steps[-1], steps[-1]) * 100
    said = _say(f"dynamic rose in {n} builds in a row: %,.0f -> %,.0f mW", steps[-1], steps[0])
    return Found(rising & (v > cfg.anomaly_creep_pct), v, F.lit(cfg.anomaly_creep_pct), said)


def _steps(cfg: Config) -> list[dict[str, Column]]:
    n = cfg.anomaly_creep_builds
    # beside the regression's lags, which come in the second stage, as one window
    return [{}, {f"back_{k}": F.lag("be_dynamic_mw", k).over(_of_block()) for k in range(1, n + 1)} | {"rank_back_": F.lag("build_rank", n).over(_of_block())}]


def _clock_dominant(cfg: Config) -> Found:
    gated = F.when(F.col("cg_efficiency").isNotNull(), _say("; clock gating efficiency %.0f%%", F.col("cg_efficiency") * 100)).otherwise("")
    said = F.concat(_say("clock network is %.0f%% of dynamic power (%,.1f of %,.1f mW)", F.col("clock_fraction") * 100, F.col("be_clock_mw"), F.col("be_dynamic_mw")), gated)
    return Found((F.col("clock_fraction") > cfg.anomaly_clock_fraction) & (F.col("be_dynamic_mw") > 0), F.col("clock_fraction"), F.lit(cfg.anomaly_clock_fraction), said)


def _replica_divergence(cfg: Config) -> Found:
    """Instances (name@i) of one block whose dynamic power differs; a finding on the largest."""
    v = F.when((F.col("measured_") >= 2) & (F.col("low_") > 0), ratio(F.col("high_"), F.col("low_")))
    largest = (F.col("be_dynamic_mw") == F.col("high_")) & (F.col("fub") == F.col("largest_")) & (F.col("nth_") == 1)
    said = F.concat("base_", F.lit(": "), "fub", _say(" %,.1f mW vs ", F.col("high_")), "least_", _say(" %,.1f mW across %.0f instances", F.col("low_"), F.col("instances_")))
    return Found(F.col("base_").isNotNull() & largest & (v > cfg.anomaly_replica_ratio), v, F.lit(cfg.anomaly_replica_ratio), said)


def _modules(cfg: Config) -> list[dict[str, Column]]:
    dyn = F.col("be_dynamic_mw")
    order = F.when(dyn.isNotNull(), F.struct("be_dynamic_mw", "fub"))
    sides = {"instances_": F.count("*"), "measured_": F.count(dyn), "low_": F.min(dyn), "high_": F.max(dyn), "largest_": F.max_by("fub", order), "least_": F.min_by("fub", order)}
    nth = F.row_number().over(_of_build("base_").orderBy(dyn.desc_nulls_last(), F.col("fub").desc()))
    return [{"base_": F.when(F.col("fub").contains("@"), F.split("fub", "@")[0])}, {c: f.over(_of_build("base_")) for c, f in sides.items()} | {"nth_": nth}]


def _leakage_share(cfg: Config) -> Found:
    limit = F.greatest(2 * F.col("leak_mid_"), F.lit(LEAKAGE_SHARE))
    said = _say("leakage is %.0f%% of total vs design median %.0f%% (%,.1f mW)", F.col("leakage_fraction") * 100, F.col("leak_mid_") * 100, F.col("be_leakage_mw"))
    return Found((F.col("be_mw") > 0) & (F.col("n_leak_") >= LEAST_BLOCKS) & (F.col("leakage_fraction") > limit), F.col("leakage_fraction"), limit, said)


def _leakages(cfg: Config) -> list[dict[str, Column]]:
    own = F.when(F.col("be_mw") > 0, F.col("leakage_fraction"))
    return [{}, {"leak_mid_": F.median(own).over(_of_build()), "n_leak_": F.count(own).over(_of_build())}]


#: The rules by name, in order; register a rule by adding an entry here.
RULES = {
    r.name: r
    for r in (
        Rule("idle_dynamic", "Dynamic power at idle", "high", "ratio", "clock_gating", ("be_dynamic_mw",), _idle_dynamic, over_workloads=_over_workloads),
        Rule("activity_power_mismatch", "Power high for its activity", "high", "x median", "glitch_reduction", ("be_dynamic_mw", "activity", "wire_cap_pf", "cell_cap_pf"), _activity_power_mismatch, _efficiency),
        Rule("unexplained_regression", "Unexplained build regression", "high", "%", "clock_gating", ("be_dynamic_mw",), _unexplained_regression, _previous),
        Rule("creeping_growth", "Creeping growth across builds", "medium", "%", None, ("be_dynamic_mw",), _creeping_growth, _steps),
        Rule("clock_dominant", "Clock network dominant", "medium", "fraction", "clock_gating", ("be_clock_mw",), _clock_dominant),
        Rule("replica_divergence", "Replica instances disagree", "medium", "max/min", "wire_cap_reduction", ("be_dynamic_mw",), _replica_divergence, _modules),
        Rule("leakage_share", "Leakage share far above peers", "medium", "fraction", "vt_swap", ("be_leakage_mw",), _leakage_share, _leakages),
    )
}
#: Columns that rules read; those that a table lacks are added without values.
READ = ["be_mw", "be_dynamic_mw", "be_leakage_mw", "be_clock_mw", "activity", "wire_cap_pf", "cell_cap_pf", "area", "voltage_v", "frequency_ghz", "cg_efficiency", "clock_fraction", "leakage_fraction"]


def findings(df: DataFrame, rules: list[str] | None = None, cfg: Config | None = None) -> DataFrame:
    """FINDING rows of the rules over all builds, from one pass over the rows; none of a rule that lacks a column it needs."""
    cfg = cfg or Config()
    chosen = [RULES[name] for name in rules or RULES]
    absent = [c for c in dict.fromkeys([*READ, *(c for r in chosen for c in r.needs)]) if c not in df.columns]
    able = [r for r in chosen if not set(r.needs) & set(absent)]
    rows = context(df.withColumns({c: F.lit(None).cast("double") for c in absent})).where(F.col("operating_point") == F.col("ref_op"))
    rows = rows.withColumns({k: c for r in able for k, c in r.over_workloads(cfg).items()}).where(F.col("workload") == F.col("ref_workload"))
    stages = [r.stages(cfg) for r in able]
    for k in range(max(map(len, stages), default=0)):
        rows = rows.withColumns({name: c for own in stages if k < len(own) for name, c in own[k].items()})
    found = []
    for r in able:
        f = r.judge(cfg)
        said = [F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), f.value.cast("double").alias("value"), f.threshold.cast("double").alias("threshold"), F.lit(r.unit).alias("unit"), f.evidence.alias("evidence"), F.lit(r.technique).cast("string").alias("technique"), (F.col("workload") if f.workload is None else f.workload).alias("at_")]
        found.append(F.when(f.hit, F.struct(*said)))
    kind = "array<struct<rule: string, severity: string, value: double, threshold: double, unit: string, evidence: string, technique: string, at_: string>>"
    out = rows.select(*ID, "operating_point", F.explode(F.array_compact(F.array(*found)).cast(kind)).alias("f"))
    return out.select(*ID, "operating_point", "f.*").withColumnRenamed("at_", "workload").select(*FINDING)


def find(df: DataFrame, name: str, cfg: Config | None = None) -> DataFrame:
    """FINDING rows of one rule, over all builds."""
    return findings(df, [name], cfg)


def with_status(df: DataFrame, found: DataFrame) -> DataFrame:
    """Each design's latest findings as new or persisting, and those of the build before that are cleared."""
    ranks = with_rank(df.select("design", "build").distinct())
    last = ranks.groupBy("design").agg(F.max("build_rank").alias("last_"))
    key = ["design", "model_root", "rule"]
    near = found.join(ranks.join(last, "design").where(F.col("build_rank") >= F.col("last_") - 1), ["design", "build"])
    sides = near.groupBy(*key).agg(F.max(F.col("build_rank") == F.col("last_")).alias("now"), F.max(F.col("build_rank") < F.col("last_")).alias("then"))
    return sides.select(*key, F.when(~F.col("now"), "cleared").when(F.col("then"), "persisting").otherwise("new").alias("status"))


def report(df: DataFrame, rules: list[str] | None = None, cfg: Config | None = None) -> DataFrame:
    """Findings of each design's latest build, new or persisting, and cleared ones of the build before.

    ``place`` orders a design's findings: by severity, then growth first among percentages, then by block.
    """
    found = findings(df, rules, cfg)
    ranks = with_rank(df.select("design", "build").distinct())
    last = ranks.groupBy("design").agg(F.max("build_rank").alias("last_"))
    rows = found.join(ranks.join(last, "design"), ["design", "build"]).where(F.col("build_rank") >= F.col("last_") - 1)
    of = Window.partitionBy("design", "model_root", "rule")
    now, before = (F.max(F.col("build_rank") == F.col("last_") - k).over(of) for k in (0, 1))
    rows = rows.withColumn("status", F.when(~now, "cleared").when(before, "persisting").otherwise("new"))
    rows = rows.where((F.col("build_rank") == F.col("last_")) | (F.col("status") == "cleared"))
    severity = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    order = Window.partitionBy("design").orderBy(F.col("status") == "cleared", severity, F.when(F.col("unit") == "%", -F.col("value")).otherwise(0.0), "model_root", "rule")
    return rows.withColumn("place", F.row_number().over(order)).select(*FINDING, "status", "place")


def skipped(df: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(design, rule, reason) of rules that cannot judge a design's latest build."""
    cfg = cfg or Config()
    has = [c for r in RULES.values() for c in r.needs if c in df.columns]
    ctx = context(df)
    last = ctx.groupBy("design").agg(F.max("build_rank").alias("last_"))
    at = (F.col("build_rank") == F.col("last_")) & (F.col("workload") == F.col("ref_workload")) & (F.col("operating_point") == F.col("ref_op"))
    drive = F.col("activity") * (F.col("wire_cap_pf") + F.col("cell_cap_pf")) * F.col("voltage_v") * F.col("frequency_ghz")
    counts = {f"n_{c}": F.count(c) for c in dict.fromkeys(has)}
    counts |= {"idle_": F.count_if(F.col("workload") == IDLE), "ref_": F.max("ref_workload"), "builds_": F.max("build_rank"), "replicas_": F.count_if(at & F.col("fub").contains("@")), "clocks_": F.count_if(at & F.col("clock_fraction").isNotNull()), "leaks_": F.count_if(at & F.col("leakage_fraction").isNotNull() & (F.col("be_mw") > 0)), "drives_": F.count_if(at & (drive > 0) & (F.col("be_dynamic_mw") > 0))}
    rows = ctx.join(last, "design").groupBy("design").agg(*[v.alias(k) for k, v in counts.items()])
    own = {
        "idle_dynamic": F.when((F.col("idle_") == 0) | (F.col("ref_") == IDLE), f"no '{IDLE}' workload in the dataset"),
        "activity_power_mismatch": F.when(F.col("drives_") < LEAST_BLOCKS, f"fewer than {LEAST_BLOCKS} blocks with activity, capacitance and corner"),
        "unexplained_regression": F.when(F.col("builds_") < 2, "no previous build"),
        "creeping_growth": F.when(F.col("builds_") <= cfg.anomaly_creep_builds, f"fewer than {cfg.anomaly_creep_builds + 1} builds"),
        "clock_dominant": F.when(F.col("clocks_") == 0, "no power by group (be_clock_mw)"),
        "replica_divergence": F.when(F.col("replicas_") == 0, "no rows of replica instances"),
        "leakage_share": F.when(F.col("leaks_") < LEAST_BLOCKS, f"fewer than {LEAST_BLOCKS} blocks with a leakage split"),
    }
    reasons = []
    for name, rule in RULES.items():
        absent = F.concat_ws(", ", *[F.lit(c) if c not in has else F.when(F.col(f"n_{c}") == 0, c) for c in rule.needs])
        reasons.append(F.struct(F.lit(name).alias("rule"), F.when(absent != "", F.concat(F.lit("needs "), absent)).otherwise(own[name]).alias("reason")))
    return rows.select("design", F.inline(F.array(*reasons))).where("reason is not null")


def by_owner(found: DataFrame) -> DataFrame:
    owner = F.coalesce("owner", F.lit("(no owner)"))
    return found.groupBy(owner.alias("owner")).agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "high").alias("high"), F.countDistinct("model_root").alias("fubs"))
