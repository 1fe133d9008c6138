"""Named queries over the given tables, with the SQL that DuckDB runs to check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators import anomalies, builds, closure, explore, identity, models, quality, stats, workload
from wattloom.operators.measurements import MeasurementStore
from wattloom.operators.derive import with_derived, with_features
from wattloom.operators.select import build_ranks, latest_builds, select_slice, with_rank
from wattloom.plans.fixture import sql, table
from wattloom.profiling import stage_totals
from wattloom.session import kept, shared_dir
from wattloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None, tables: tuple[str, ...] = ("wide",)):
    def register(f):
        QUERIES[name] = f
        if text is not None:
            ORACLE_SQL[name] = sql(text, *tables)
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded for comparison (6 places unless named), other columns as they are."""
    return df.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def wide(spark: SparkSession, d: str) -> DataFrame:
    return with_features(with_derived(table(spark, d, "wide")))


def measured(spark: SparkSession, d: str) -> DataFrame:
    return kept(wide(spark, d))


DERIVED = """
with d as (select *, be_mw - fe_logical_mw as logical_error_mw, be_mw - fe_physical_mw as physical_error_mw,
  case when be_mw <> 0 then (be_mw - fe_logical_mw) / be_mw * 100 end as logical_error_pct,
  case when be_mw <> 0 then (be_mw - fe_physical_mw) / be_mw * 100 end as physical_error_pct,
  case when be_mw <> 0 then fe_logical_mw / be_mw end as logical_to_be_ratio,
  case when be_mw <> 0 then fe_physical_mw / be_mw end as physical_to_be_ratio,
  greatest(be_mw - be_leakage_mw, 0) as be_dynamic_mw,
  case when be_mw <> 0 then be_leakage_mw / be_mw end as leakage_fraction,
  case when greatest(be_mw - be_leakage_mw, 0) <> 0 then be_clock_mw / greatest(be_mw - be_leakage_mw, 0) end as clock_fraction,
  greatest(be_mw - be_leakage_mw, 0) / (voltage_v * voltage_v * frequency_ghz) as cdyn_pf,
  case when clock_period_ps - wns_ps > 0 then 1000.0 / (clock_period_ps - wns_ps) end as fmax_ghz,
  wire_cap_pf + cell_cap_pf as total_cap_pf, wire_cap_pf / (wire_cap_pf + cell_cap_pf) as wire_cap_fraction,
  activity * (wire_cap_pf + cell_cap_pf) * (voltage_v * voltage_v * frequency_ghz) as dyn_term,
  area * voltage_v * voltage_v * voltage_v as leak_term,
  activity * cell_cap_pf * (voltage_v * voltage_v * frequency_ghz) as cell_dyn_term,
  activity * wire_cap_pf * (voltage_v * voltage_v * frequency_ghz) as wire_dyn_term,
  bits_per_cycle * avg_net_length_um * (voltage_v * voltage_v * frequency_ghz) as move_term
  from wide)
"""
RANKED = DERIVED.rstrip() + """, k as (select design, build, row_number() over (partition by design order by cast(substring(build, 2) as int)) as build_rank
  from (select distinct design, build from wide) b), r as (select d.*, k.build_rank from d join k on d.design = k.design and d.build = k.build)
"""
KEY = ["design", "build", "fub", "workload", "operating_point"]
KEYS = ", ".join(KEY)


def _columns(names: list[str], places: int) -> str:
    return ", ".join(f"round({c}, {places}) as {c}" for c in names)


def _projection(name: str, columns: list[str], places: int = 11) -> None:
    query(name, f"{DERIVED} select {KEYS}, {_columns(columns, places)} from d")(lambda s, d: rounded(wide(s, d).select(*KEY, *columns), **dict.fromkeys(columns, places)))


_projection("wide_measurements", ["be_mw", "fe_physical_mw", "fe_logical_mw", "be_leakage_mw", "be_clock_mw", "be_register_mw", "be_comb_mw", "be_memory_mw", "wire_cap_pf", "cell_cap_pf", "area", "wns_ps", "voltage_v", "activity", "cg_efficiency", "be_voltus_mw"])
_projection("derived_metrics", ["logical_error_mw", "physical_error_mw", "logical_error_pct", "physical_error_pct", "logical_to_be_ratio", "physical_to_be_ratio", "be_dynamic_mw"])
_projection("convergence_metrics", ["leakage_fraction", "clock_fraction", "cdyn_pf"], 7)
_projection("fmax", ["fmax_ghz"])
_projection("engineered_features", ["total_cap_pf", "wire_cap_fraction", "dyn_term", "leak_term", "cell_dyn_term", "wire_dyn_term", "move_term"])


@query("build_order_natural", f"{RANKED} select design, build, build_rank from k")
def _(s, d):
    return build_ranks(wide(s, d)).withColumn("build_rank", F.col("build_rank").cast("long"))


@query("latest_build_per_design", "select design, 'B' || cast(max(build_number) as varchar) as build from wide group by design")
def _(s, d):
    return latest_builds(wide(s, d))


LATEST = "l as (select design, max(build_number) as bn from wide group by design)"


@query("slice_latest_default", f"with {LATEST} select design, build, fub, round(be_mw, 6) as be_mw from wide join l using (design) where build_number = bn and workload = 'typical' and operating_point = 'nom'")
def _(s, d):
    return rounded(select_slice(kept(table(s, d, "wide"))).select("design", "build", "fub", "be_mw"))


def defective(df: DataFrame) -> DataFrame:
    """Defects by rule, so that both engines inject the same."""
    hit = lambda c, n: F.col("build_number") % n == c
    at = lambda n: F.col("fub") == f"Brand#{n}"
    return df.withColumns(
        {
            "be_mw": F.when(at(5) & hit(1, 5), None).when(at(5) & hit(2, 5), F.lit(0.0)).when(at(6) & hit(3, 5), F.lit(0.005)).when(at(6) & hit(4, 5), F.col("be_mw") * 1000).otherwise(F.col("be_mw")),
            "wire_cap_pf": F.when(at(7) & hit(0, 4), -F.col("wire_cap_pf")).otherwise(F.col("wire_cap_pf")),
            "area": F.when(at(8) & hit(0, 6), None).otherwise(F.col("area")),
            "fe_physical_mw": F.when(at(9) & hit(0, 3), F.col("be_mw") * 8).otherwise(F.col("fe_physical_mw")),
            "wns_ps": F.when(at(10) & hit(1, 7), F.lit(2000.0)).otherwise(F.col("wns_ps")),
            "build_status": F.when((F.col("design") == "ASIA") & hit(4, 9), "superseded").otherwise("current"),
            "be_activity_mode": F.when(at(3) & hit(0, 2), "Vectorless average").otherwise("vcd"),
        }
    )


DEFECT = """
with x as (select * replace (
  case when fub = 'Brand#5' and build_number % 5 = 1 then null when fub = 'Brand#5' and build_number % 5 = 2 then 0.0 when fub = 'Brand#6' and build_number % 5 = 3 then 0.005 when fub = 'Brand#6' and build_number % 5 = 4 then be_mw * 1000 else be_mw end as be_mw,
  case when fub = 'Brand#7' and build_number % 4 = 0 then -wire_cap_pf else wire_cap_pf end as wire_cap_pf,
  case when fub = 'Brand#8' and build_number % 6 = 0 then null else area end as area,
  case when fub = 'Brand#9' and build_number % 3 = 0 then be_mw * 8 else fe_physical_mw end as fe_physical_mw,
  case when fub = 'Brand#10' and build_number % 7 = 1 then 2000.0 else wns_ps end as wns_ps),
  case when design = 'ASIA' and build_number % 9 = 4 then 'superseded' else 'current' end as build_status,
  case when fub = 'Brand#3' and build_number % 2 = 0 then 'Vectorless average' else 'vcd' end as be_activity_mode from wide),
z as (select avg(ln(be_mw)) as m, stddev_pop(ln(be_mw)) as sd from x where be_mw > 0),
v as (select x.*, case when be_mw > 0 then abs(ln(case when be_mw > 0 then be_mw end) - m) / sd end as zb, case when be_mw > 0 then fe_physical_mw / be_mw end as fr,
  count(*) over (partition by design, build, fub, stage, workload, operating_point) > 1 as dup from x cross join z)
"""
_REASONS = ["case when be_mw is null then 'missing_value:be_mw' end", "case when be_mw = 0 then 'zero_be' end", "case when wire_cap_pf < 0 then 'negative:wire_cap_pf' end", "case when dup then 'duplicate_key' end"]


@query("validate_flags", f"""{DEFECT} select {KEYS}, nullif(concat_ws(';', {', '.join(_REASONS)}), '') as reject_reason,
  concat_ws(';', case when bits_per_cycle is null or area is null or wire_cap_pf is null then 'missing_feature' end, case when fr < 0.2 or fr > 5 then 'outlier_ratio' end, case when zb > 4 then 'outlier_be' end) as warnings from v""")
def _(s, d):
    return quality.validate(defective(kept(table(s, d, "wide")))).select(*KEY, "reject_reason", F.array_join("warnings", ";").alias("warnings"))


@query("reject_reasons", f"{DEFECT} select coalesce(nullif(concat_ws(';', {', '.join(_REASONS)}), ''), '(clean)') as reason, count(*) as n from v group by 1")
def _(s, d):
    return quality.validate(defective(kept(table(s, d, "wide")))).groupBy(F.coalesce("reject_reason", F.lit("(clean)")).alias("reason")).agg(F.count("*").alias("n"))


@query("validation_issues", f"""{DEFECT}, i as (select 'error' as level, unnest([{', '.join(_REASONS)}]) as code from v
  union all select 'warning', unnest([case when bits_per_cycle is null or area is null or wire_cap_pf is null then 'missing_feature' end, case when fr < 0.2 or fr > 5 then 'outlier_ratio' end, case when zb > 4 then 'outlier_be' end]) from v)
select level, code, count(*) as n from i where code is not null group by 1, 2 union all select 'warning', 'absent_feature_columns:fanout,net_count,wire_length_um', 0""")
def _(s, d):
    return quality.validation_issues(quality.validate(defective(kept(table(s, d, "wide")))))


def planted_lineage(df: DataFrame) -> DataFrame:
    """Lineage issues by rule, a row a block and build."""
    n, at = F.col("build_number"), lambda k: F.col("fub") == f"Brand#{k}"
    issues = F.when(at(11) & (n % 4 == 1), F.array(F.lit("be_hier_not_in_reports"))).when(at(12), F.array(F.lit("partition_timing_missing"))).when(at(13) & (n % 3 == 0), F.array(F.lit("incomplete_physical_mapping"), F.lit("no_partition"))).otherwise(F.array().cast("array<string>"))
    return df.select("design", "build", "build_number", "fub").distinct().select("design", "build", "fub", issues.alias("lineage_issues"))


def planted_intent(df: DataFrame) -> DataFrame:
    n, at = F.col("build_number"), lambda k: F.col("fub") == f"Brand#{k}"
    issues = F.when(at(14), F.array(F.lit("no_power_domain"))).when(at(15) & (n % 2 == 1), F.array(F.lit("multiple_power_domains"), F.lit("domain_voltage_mismatch"))).otherwise(F.array().cast("array<string>"))
    return df.select("design", "build", "build_number", "fub").distinct().select("design", "build", "fub", issues.alias("intent_issues"))


SANITIZE = DEFECT.rstrip() + """, w as (select *, median(be_mw) over (partition by design) as med, max(build_date) over (partition by design) as newest,
  (max(be_leakage_mw) over q - min(be_leakage_mw) over q) / (avg(be_leakage_mw) over q) * 100 as spread from v window q as (partition by design, build, fub, operating_point)),
f as (select *, concat_ws(';', case when be_mw is null or fe_physical_mw is null or fe_logical_mw is null then 'missing_metric' end, case when area is null then 'missing_physical' end, case when dup then 'duplicate' end, case when wire_cap_pf < 0 then 'negative' end,
  case when be_leakage_mw > be_mw * 1.001 or spread > 5 then 'leakage_suspect' end,
  case when be_mw > 0 and abs(be_clock_mw + be_register_mw + be_comb_mw + be_memory_mw - be_mw) / be_mw * 100 > 5 then 'group_sum_mismatch' end,
  case when abs(be_mw) < 0.01 then 'near_zero_be' end, case when abs(be_mw) >= 0.01 and med > 0 and (be_mw / med > 50 or be_mw / med < 0.02) then 'unit_suspect' end,
  case when build_status = 'superseded' or date_diff('day', build_date, newest) > 120 then 'stale_build' end,
  case when zb > 4 or fr < 0.2 or fr > 5 then 'outlier' end,
  case when (fub = 'Brand#11' and build_number % 4 = 1) or (fub = 'Brand#13' and build_number % 3 = 0) then 'lineage_mismatch' end,
  case when fub = 'Brand#12' or (fub = 'Brand#13' and build_number % 3 = 0) then 'timing_missing' end,
  case when wns_ps > clock_period_ps or clock_period_ps <= 0 then 'timing_suspect' end,
  case when lower(be_activity_mode) like 'vectorless%' then 'vectorless_power' end,
  case when fub = 'Brand#15' and build_number % 2 = 1 then 'intent_mismatch' end,
  case when fub = 'Brand#14' or (fub = 'Brand#15' and build_number % 2 = 1) then 'intent_missing' end) as flags from w),
u as (select *, not regexp_matches(flags, 'missing_metric|missing_physical|duplicate|negative|near_zero_be|unit_suspect|stale_build|lineage_mismatch') as usable from f)
"""


def flagged(s: SparkSession, d: str) -> DataFrame:
    w = kept(table(s, d, "wide"))
    return quality.sanitize(defective(w), lineage=planted_lineage(w), intent=planted_intent(w))


@query("sanitize_flags", f"{SANITIZE} select {KEYS}, flags, usable from u")
def _(s, d):
    return flagged(s, d).select(*KEY, F.array_join("quality_flags", ";").alias("flags"), "usable")


@query("sanitize_counts", f"{SANITIZE} select flag, count(*) as n from (select unnest(string_split(flags, ';')) as flag from f where flags <> '') group by flag")
def _(s, d):
    return quality.flag_counts(flagged(s, d))


@query("quality_report", f"{SANITIZE} select count(*) as n_rows, count(distinct (design, build, fub)) as n_fubs, count(*) filter (where usable) as n_usable, round(100.0 * count(*) filter (where usable) / count(*), 6) as usable_pct from u")
def _(s, d):
    return rounded(quality.quality_report(flagged(s, d)))


METRICS = ["fe_physical_mw", "wire_cap_pf", "area", "activity", "bits_per_cycle", "be_voltus_mw", "wns_ps"]


def _r(x: str, y: str) -> str:
    both = f"filter (where {x} is not null and {y} is not null)"
    return f"case when count(*) {both} >= 3 and stddev_pop({x}) {both} * stddev_pop({y}) {both} > 0 then covar_pop({x}, {y}) / (stddev_pop({x}) {both} * stddev_pop({y}) {both}) end"


@query("metric_quality", "with m as (" + " union all ".join(f"select '{m}' as metric, build, be_mw as y, cast({m} as double) as x from wide" for m in METRICS) + f"""), a as (select metric, round(100.0 * count(x) / count(*), 6) as coverage_pct, {_r('x', 'y')} as r, avg(x) as mu, stddev_pop(x) as sd, count(x) as n from m group by metric),
o as (select metric, count(*) as outliers from m join a using (metric) where n >= 10 and sd > 0 and abs(x - mu) > 4 * sd group by metric),
b as (select metric, build, {_r('x', 'y')} as r from m group by metric, build having count(*) filter (where x is not null and y is not null) >= 10),
c as (select metric, round(min(r), 6) as r_min_build, round(max(r), 6) as r_max_build from b group by metric)
select metric, coverage_pct, round(r, 6) as r_target, r_min_build, r_max_build, coalesce(outliers, 0) as outliers, cast(0 as bigint) as unit_conversions,
  case when coverage_pct < 50 then 'unusable' when r_max_build - r_min_build > 0.25 then 'unstable' when coverage_pct < 90 then 'partial' else 'trusted' end as verdict,
  concat_ws('; ', case when coverage_pct < 90 then printf('coverage %.0f%%', coverage_pct) end, case when r_max_build - r_min_build > 0.25 then printf('r varies %.2f..%.2f across builds', r_min_build, r_max_build) end, case when outliers > 0 then outliers || ' outliers' end) as notes
from a left join c using (metric) left join o using (metric)""")
def _(s, d):
    return rounded(quality.metric_quality(kept(table(s, d, "wide")), METRICS))


@query("summary_stats", "select count(*) as n_rows, count(be_mw) as n_be, round(avg(be_mw), 6) as mean, round(median(be_mw), 6) as median, round(quantile_cont(be_mw, 0.05), 6) as p05, round(quantile_cont(be_mw, 0.95), 6) as p95, min(be_mw) as min, max(be_mw) as max, cast(sum(cast(be_mw as decimal(28,9))) as double) as total, count(distinct design) as n_designs, count(distinct (design, build)) as n_builds, count(distinct (design, fub)) as n_fubs from wide")
def _(s, d):
    return rounded(stats.summarize(kept(table(s, d, "wide"))))


_COUNTED = ["wire_cap_pf", "area", "bits_per_cycle", "be_mw"]


@query("missing_features", f"{DEFECT}, m as (" + " union all ".join(f"select '{c}' as feature, count(*) filter (where {c} is null) as n from v" for c in _COUNTED) + ") select * from m where n > 0")
def _(s, d):
    return stats.missing_features(defective(table(s, d, "wide")), _COUNTED)


def _metrics(stage: str) -> str:
    p = f"fe_{stage}_mw"
    return f"""count(*) as n, round(avg(abs({p} - be_mw)), 6) as mae, round(sqrt(avg(({p} - be_mw) * ({p} - be_mw))), 6) as rmse, round(avg(abs(({p} - be_mw) / be_mw) * 100), 6) as mape, round(avg(({p} - be_mw) / be_mw) * 100, 6) as mean_error_pct,
  round(case when var_pop(be_mw) > 0 then 1 - sum(({p} - be_mw) * ({p} - be_mw)) / (var_pop(be_mw) * count(*)) end, 6) as r2, round(quantile_cont(abs(({p} - be_mw) / be_mw) * 100, 0.5), 6) as p50_ape, round(quantile_cont(abs(({p} - be_mw) / be_mw) * 100, 0.95), 6) as p95_ape"""


for _stage in ("physical", "logical"):
    query(f"stage_metrics_{_stage}", f"select {_metrics(_stage)} from wide")(lambda s, d, k=_stage: rounded(stats.stage_metrics(kept(table(s, d, "wide")), k)))
    for _by in ("design", "build"):
        query(f"error_by_{_by}_{_stage}", f"select {_by}, {_metrics(_stage)} from wide group by {_by}")(lambda s, d, k=_stage, b=_by: rounded(stats.stage_metrics(table(s, d, "wide"), k, [b])))
for _unit in ("mw", "pct"):
    query(f"error_top_{_unit}", f"{DERIVED} select {KEYS}, round(physical_error_mw, 6) as physical_error_mw, round(physical_error_pct, 6) as physical_error_pct from d order by abs(d.physical_error_{_unit}) desc nulls last, {', '.join('d.' + k for k in KEY)} limit 10")(
        lambda s, d, u=_unit: rounded(stats.top_errors(wide(s, d), "physical", u))
    )


@query("error_trend", """with e as (select design, build, build_number, avg((be_mw - fe_physical_mw) / be_mw * 100) as e from wide where be_mw <> 0 group by 1, 2, 3),
i as (select *, cast(row_number() over (partition by design order by build_number) as double) as i from e)
select design, count(*) as n_builds, round(regr_slope(e, i), 6) as slope, round(arg_min(e, i), 6) as first_pct, round(arg_max(e, i), 6) as last_pct, case when abs(arg_max(e, i) - arg_min(e, i)) < 2 then 'is roughly stable' when arg_max(e, i) > arg_min(e, i) then 'grows' else 'shrinks' end as trend from i group by design having count(*) >= 3""")
def _(s, d):
    return rounded(stats.error_trend(table(s, d, "wide"), "physical"))


FEATURES = ["fe_physical_mw", "fe_logical_mw", "wire_cap_pf", "cell_cap_pf", "area", "activity", "bits_per_cycle", "wire_cap_fraction", "voltage_v"]


def _associations(target: str) -> str:
    return DERIVED + " union all ".join(f" select '{c}' as feature, count({c}) as n, round({_r(c, target)}, 6) as r from d" for c in FEATURES)


query("pearson_associations", _associations("be_mw"))(lambda s, d: rounded(stats.associations(wide(s, d), "be_mw", FEATURES)))
query("error_associations", _associations("physical_error_pct"))(lambda s, d: rounded(stats.associations(wide(s, d), "physical_error_pct", FEATURES)))
#: A correlation's p-value is the share of the area under cos(t) ** (n - 3), from 0 to pi / 2, that lies beyond asin(|r|): by Simpson's rule.
_STEPS = 40_000
_P_VALUES = f"""{DERIVED.rstrip()}, f as ({" union all ".join(f"select '{c}' as feature, count({c}) as n, {_r(c, 'be_mw')} as r from d" for c in FEATURES)}),
g as (select feature, n, r, case when k in (0, {_STEPS}) then 1 when k % 2 = 1 then 4 else 2 end as w, k / {_STEPS}.0e0 as u, asin(least(abs(r), 1.0)) as a from f, range({_STEPS} + 1) s(k) where n >= 3),
i as (select feature, (pi() / 2 - any_value(a)) * sum(w * exp((n - 3) * ln(greatest(cos(a + (pi() / 2 - a) * u), 1e-300)))) as beyond, pi() / 2 * sum(w * exp((n - 3) * ln(greatest(cos(pi() / 2 * u), 1e-300)))) as whole from g where r is not null group by feature)
select feature, n, round(r, 6) as r, round(beyond / whole, 6) as p from f left join i using (feature)"""
query("association_p_values", _P_VALUES)(lambda s, d: rounded(stats.with_p(stats.associations(wide(s, d), "be_mw", FEATURES))))
_PAIRS = [(a, b) for i, a in enumerate(FEATURES[:6]) for b in FEATURES[i + 1 : 6]]
query("correlation_pairs", DERIVED + " union all ".join(f" select '{a}' as a, '{b}' as b, round({_r(a, b)}, 6) as r from d" for a, b in _PAIRS))(lambda s, d: rounded(stats.correlation_matrix(wide(s, d), FEATURES[:6])))


def _qualify(by: str = "") -> str:
    ape = "abs(be_voltus_mw - be_mw) / abs(be_mw) * 100"
    return f"""select {by + ',' if by else ''} count(*) as n, round(avg({ape}), 6) as mape, round(quantile_cont({ape}, 0.95), 6) as p95, round(sum(be_mw), 3) as sum_be, round(sum(be_voltus_mw), 3) as sum_engine, round({_r('be_voltus_mw', 'be_mw')}, 6) as r,
  round((sum(be_voltus_mw) - sum(be_mw)) / sum(be_mw) * 100, 6) as bias_pct, avg({ape}) <= 5 and quantile_cont({ape}, 0.95) <= 10 as passed from wide {'group by ' + by if by else ''}"""


query("qualify_overall", _qualify())(lambda s, d: rounded(stats.qualify(kept(table(s, d, "wide"))), sum_be=3, sum_engine=3))
query("qualify_by_partition", _qualify("partition"))(lambda s, d: rounded(stats.qualify(table(s, d, "wide"), by=["partition"]), sum_be=3, sum_engine=3))


@query("qualify_worst", f"select {KEYS}, round(abs((be_voltus_mw - be_mw) / be_mw * 100), 6) as off_pct from wide where be_mw <> 0 order by abs((be_voltus_mw - be_mw) / be_mw * 100) desc, {KEYS} limit 8")
def _(s, d):
    off = F.abs((F.col("be_voltus_mw") - F.col("be_mw")) / F.col("be_mw") * 100)
    return table(s, d, "wide").where("be_mw <> 0").select(*KEY, F.round(off, 6).alias("off_pct"), off.alias("o")).orderBy(F.col("o").desc(), *KEY).limit(8).drop("o")


def corner(df: DataFrame, w: str = "typical", op: str = "nom") -> DataFrame:
    return df.where((F.col("workload") == w) & (F.col("operating_point") == op))


AT = "workload = 'typical' and operating_point = 'nom'"
_SUMMED = ["be_mw", "fe_physical_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count"]
_TOTAL = "cast(sum(cast({0} as decimal(28,9))) as double)"
PAIRS = RANKED.rstrip() + f""", a as (select * from r where {AT}), j as (select a.design, a.model_root, a.partition, a.build as from_build, b.build as to_build, a.build_rank, {', '.join(f'a.{c} as f_{c}, b.{c} as t_{c}' for c in [*_SUMMED, 'wns_ps', 'fmax_ghz'])}
  from a join a b on a.design = b.design and a.model_root = b.model_root and b.build_rank = a.build_rank + 1)"""
DELTAS = PAIRS + f""", p as (select design, from_build, to_build, count(*) as n_fubs, {', '.join(f"{_TOTAL.format('f_' + c)} as from_{c}, {_TOTAL.format('t_' + c)} as to_{c}" for c in _SUMMED)}, min(f_wns_ps) as from_wns_ps, min(t_wns_ps) as to_wns_ps, min(f_fmax_ghz) as from_fmax_ghz, min(t_fmax_ghz) as to_fmax_ghz from j group by 1, 2, 3),
m as (select *, (to_be_mw - from_be_mw) / from_be_mw * 100 as power_pct, to_wns_ps - from_wns_ps as t from p)
"""
_MOVE = "case when t is null then 'timing unknown' when power_pct is null then 'power unknown' when abs(power_pct) <= 0.5 and abs(t) <= 1 then 'neutral' when (power_pct < -0.5 and t >= -1) or (t > 1 and power_pct <= 0.5) then 'pareto improvement' when (power_pct > 0.5 and t <= 1) or (t < -1 and power_pct >= -0.5) then 'regression' when t > 1 and power_pct > 0.5 then 'power-for-performance trade' else 'performance-for-power trade' end"


@query("build_deltas", f"{DELTAS} select * exclude (t, power_pct) replace (round(from_fmax_ghz, 6) as from_fmax_ghz, round(to_fmax_ghz, 6) as to_fmax_ghz), {', '.join(f'round((to_{c} - from_{c}) / nullif(from_{c}, 0) * 100, 6) as {c}_pct' for c in _SUMMED)}, {_MOVE} as move from m")
def _(s, d):
    out = builds.build_deltas(corner(kept(table(s, d, "wide"))))
    return rounded(out, **{f"{side}_{c}": 9 for c in _SUMMED for side in ("from", "to")})


@query("delta_classify", f"{DELTAS} select design, {_MOVE} as move, count(*) as n from m group by 1, 2")
def _(s, d):
    return builds.build_deltas(corner(kept(table(s, d, "wide")))).groupBy("design", "move").agg(F.count("*").alias("n"))


@query("delta_partitions", f"""{PAIRS}, q as (select design, from_build, to_build, partition, {_TOTAL.format('f_be_mw')} as from_mw, {_TOTAL.format('t_be_mw')} as to_mw, min(f_wns_ps) as from_wns_ps, min(t_wns_ps) as to_wns_ps from j group by 1, 2, 3, 4),
m as (select *, (to_mw - from_mw) / nullif(from_mw, 0) * 100 as power_pct, to_wns_ps - from_wns_ps as t from q) select * exclude (t) replace (round(power_pct, 6) as power_pct), {_MOVE} as move from m""")
def _(s, d):
    return rounded(builds.partition_deltas(corner(kept(table(s, d, "wide")))), from_mw=9, to_mw=9)


@query("delta_movers", f"""{PAIRS}, l as (select design, max(build_rank) as top from j group by 1), o as (select j.*, (t_be_mw - f_be_mw) / nullif(f_be_mw, 0) * 100 as power_pct from j join l using (design) where build_rank = top),
n as (select *, cast(row_number() over (partition by design order by abs(power_pct) desc nulls last, model_root) as int) as place from o)
select design, model_root, round(f_be_mw, 6) as from_mw, round(t_be_mw, 6) as to_mw, round(power_pct, 6) as power_pct, place from n where place <= 5""")
def _(s, d):
    return rounded(builds.movers(corner(kept(table(s, d, "wide")))))


@query("frontier_pareto", f"""{RANKED}, p as (select design, build, build_rank, cast(sum(cast(be_mw as decimal(28,9))) as double) as power_mw, min(fmax_ghz) as fmax_ghz, min(wns_ps) as wns_ps from r where {AT} group by 1, 2, 3),
o as (select p.*, f.throughput_gops, case when lag(p.power_mw) over w <> 0 then (p.power_mw - lag(p.power_mw) over w) / lag(p.power_mw) over w * 100 else 0 end as power_pct, wns_ps - lag(wns_ps) over w as t from p left join (select * from performance where {AT}) f using (design, build) window w as (partition by design order by build_rank))
select design, build, power_mw, round(fmax_ghz, 6) as fmax_ghz, wns_ps, round(throughput_gops, 9) as throughput_gops, fmax_ghz is not null and not exists (select 1 from p q where q.design = o.design and q.power_mw <= o.power_mw and q.fmax_ghz >= o.fmax_ghz and (q.power_mw < o.power_mw or q.fmax_ghz > o.fmax_ghz)) as pareto, case when t is null then '' else {_MOVE} end as status from o""", ("wide", "performance"))
def _(s, d):
    return rounded(builds.frontier(corner(kept(table(s, d, "wide"))), table(s, d, "performance")), power_mw=9, throughput_gops=9)


HOT = RANKED.rstrip() + f""", a as (select * from r where {AT}), n as (select *, max(build_rank) over (partition by design) as top from a),
h as (select n.*, p.be_mw as prev_mw, n.be_mw / sum(n.be_mw) over (partition by n.design) * 100 as share_pct, n.be_mw / nullif(n.area, 0) as density, (n.be_mw - p.be_mw) / p.be_mw * 100 as delta_pct from n left join a p on p.design = n.design and p.model_root = n.model_root and p.build_rank = n.build_rank - 1 where n.build_rank = n.top),
g as (select *, share_pct >= 2 and density >= quantile_cont(density, 0.8) over (partition by design) as hotspot, coalesce(delta_pct > 5, false) as regressed, coalesce(cg_efficiency < 0.6 and share_pct >= 1, false) as low_cg from h)
"""


def spots(s: SparkSession, d: str) -> DataFrame:
    return builds.hotspots(corner(measured(s, d)))


@query("hotspots", f"{HOT} select design, build, fub, round(share_pct, 6) as share_pct, round(density, 6) as density, round(delta_pct, 6) as delta_pct, hotspot, regressed, low_cg from g")
def _(s, d):
    return rounded(spots(s, d).select("design", "build", "fub", "share_pct", "density", "delta_pct", "hotspot", "regressed", "low_cg"))


@query("hotspot_partitions", f"{HOT} select design, partition, count(*) as n_fubs, round(sum(be_mw), 6) as power_mw, round(sum(share_pct), 6) as share_pct, round(sum(area), 4) as area, cast(sum(cast(hotspot as int)) as bigint) as n_hotspots, round(sum(be_mw) / nullif(sum(area), 0), 6) as density, round(case when sum(prev_mw) > 0 then (sum(be_mw) - sum(prev_mw)) / sum(prev_mw) * 100 end, 6) as delta_pct from g group by 1, 2")
def _(s, d):
    return rounded(builds.hotspot_partitions(spots(s, d)), area=4)


# anomalies
_WINDOW = "window w as (partition by design, model_root order by build_rank)"
_RULES_SQL = {
    "idle_dynamic": ("i as (select design, build, build_rank, fub, model_root, owner, max(case when workload = 'idle' then be_dynamic_mw end) as a, max(case when workload = 'typical' then be_dynamic_mw end) as b from r where operating_point = 'nom' group by all)", "select *, a / b as value, 0.35 as threshold from i where b > 0 and a / b > 0.35"),
    "activity_power_mismatch": (f"e as (select *, ln(be_dynamic_mw / (activity * total_cap_pf * voltage_v * voltage_v * frequency_ghz)) as lg from r where {AT} and activity * total_cap_pf > 0 and be_dynamic_mw > 0), m as (select *, median(lg) over w as mid, count(*) over w as n from e window w as (partition by design, build)), o as (select *, median(abs(lg - mid)) over (partition by design, build) * 1.4826 as mad from m)", "select *, exp(lg - mid) as value, 2.0 as threshold from o where n >= 8 and exp(lg - mid) >= 2 and (lg - mid) / case when mad > 0 then mad else 1e-9 end >= 3"),
    "unexplained_regression": (f"a as (select *, total_cap_pf * case when activity > 0 then activity else 1 end as driver from r where {AT}), h as (select *, lag(be_dynamic_mw) over w as d0, lag(driver) over w as v0, lag(total_cap_pf) over w as c0, lag(area) over w as a0 from a {_WINDOW}), g as (select *, case when d0 > 0 then (be_dynamic_mw - d0) / d0 * 100 end as growth, coalesce(case when c0 > 0 then (driver - v0) / nullif(v0, 0) * 100 end, case when a0 > 0 then (area - a0) / a0 * 100 end, 0) as explained from h)", "select *, growth - explained as value, 10.0 as threshold from g where growth > 10 and growth - explained > 10"),
    "creeping_growth": (f"a as (select * from r where {AT}), g as (select *, lag(be_dynamic_mw) over w as b1, lag(be_dynamic_mw, 2) over w as b2, lag(be_dynamic_mw, 3) over w as b3, build_rank - lag(build_rank, 3) over w as gap from a {_WINDOW})", "select *, (be_dynamic_mw - b3) / b3 * 100 as value, 15.0 as threshold from g where gap = 3 and b3 > 0 and be_dynamic_mw > b1 and b1 > b2 and b2 > b3 and (be_dynamic_mw - b3) / b3 * 100 > 15"),
    "clock_dominant": (f"a as (select * from r where {AT})", "select *, clock_fraction as value, 0.5 as threshold from a where clock_fraction > 0.5 and be_dynamic_mw > 0"),
    "leakage_share": (f"m as (select *, median(leakage_fraction) over w as mid, count(*) over w as n from r where {AT} and be_mw > 0 and leakage_fraction is not null window w as (partition by design, build))", "select *, leakage_fraction as value, greatest(2 * mid, 0.25) as threshold from m where n >= 8 and leakage_fraction > greatest(2 * mid, 0.25)"),
}
for _rule, (_ctes, _select) in _RULES_SQL.items():
    query(f"anomaly_{_rule}", f"{RANKED.rstrip()}, {_ctes} select design, build, fub, round(value, 6) as value, round(threshold, 6) as threshold from ({_select}) f")(
        lambda s, d, k=_rule: rounded(anomalies.find(measured(s, d), k).select("design", "build", "fub", "value", "threshold"))
    )
_DETAILS = {r.name: (r.severity, r.unit) for r in anomalies.RULES.values()}
_ALL_SQL = " union all ".join(f"select '{k}' as rule, '{_DETAILS[k][0]}' as severity, '{_DETAILS[k][1]}' as unit, design, build, build_rank, model_root, owner, value from (with {c} {q}) f" for k, (c, q) in _RULES_SQL.items())


@query("anomaly_report", f"""{RANKED.rstrip()}, found as ({_ALL_SQL}), t as (select design, max(build_rank) as top from k group by 1),
s as (select f.*, top, max(build_rank = top) over w as now, max(build_rank = top - 1) over w as before from found f join t using (design) where build_rank >= top - 1 window w as (partition by design, model_root, rule)),
e as (select *, case when not now then 'cleared' when before then 'persisting' else 'new' end as status from s)
select design, build, model_root, rule, severity, unit, round(value, 6) as value, status, cast(row_number() over (partition by design order by status = 'cleared', case severity when 'high' then 0 when 'medium' then 1 else 2 end, case when unit = '%' then -value else 0 end, model_root, rule) as int) as place from e where build_rank = top or status = 'cleared'""")
def _(s, d):
    rows = anomalies.report(measured(s, d))
    return rounded(rows.select("design", "build", "model_root", "rule", "severity", "unit", "value", "status", "place"))


@query("anomaly_findings", f"{RANKED.rstrip()}, found as ({_ALL_SQL}) select rule, severity, design, build, model_root, round(value, 6) as value from found")
def _(s, d):
    return rounded(anomalies.findings(measured(s, d)).select("rule", "severity", "design", "build", "model_root", "value"))


_NEEDS = {k: r.needs for k, r in anomalies.RULES.items()}
_CANNOT = {
    "idle_dynamic": "idle_ = 0 or ref_workload = 'idle' then 'no ''idle'' workload in the dataset'",
    "activity_power_mismatch": "drives_ < 8 then 'fewer than 8 blocks with activity, capacitance and corner'",
    "unexplained_regression": "builds_ < 2 then 'no previous build'",
    "creeping_growth": "builds_ < 4 then 'fewer than 4 builds'",
    "clock_dominant": "clocks_ = 0 then 'no power by group (be_clock_mw)'",
    "replica_divergence": "replicas_ = 0 then 'no rows of replica instances'",
    "leakage_share": "leaks_ < 8 then 'fewer than 8 blocks with a leakage split'",
}
_NEEDED = list(dict.fromkeys(c for needs in _NEEDS.values() for c in needs))


def _skipped_sql() -> str:
    """Counts a design, and a text a rule from them."""
    lacks = {k: "concat_ws(', ', " + ", ".join(f"case when n_{c} = 0 then '{c}' end" for c in needs) + ")" for k, needs in _NEEDS.items()}
    reasons = " union all ".join(f"select design, '{k}' as rule, case when {lacks[k]} <> '' then 'needs ' || {lacks[k]} when {_CANNOT[k]} end as reason from c" for k in _NEEDS)
    return f"""{RANKED.rstrip()}, o as (select design, max(build_rank) as top, coalesce(max(case when workload = 'typical' then workload end), min(workload)) as ref_workload, coalesce(max(case when operating_point = 'nom' then operating_point end), min(operating_point)) as ref_op from r group by design),
x as (select *, build_rank = top and workload = ref_workload and operating_point = ref_op as here, activity * (wire_cap_pf + cell_cap_pf) * voltage_v * frequency_ghz as drive from r join o using (design)),
c as (select design, {', '.join(f'count({c}) as n_{c}' for c in _NEEDED)}, count(*) filter (where workload = 'idle') as idle_, max(ref_workload) as ref_workload, max(build_rank) as builds_, count(*) filter (where here and contains(fub, '@')) as replicas_, count(*) filter (where here and clock_fraction is not null) as clocks_, count(*) filter (where here and leakage_fraction is not null and be_mw > 0) as leaks_, count(*) filter (where here and drive > 0 and be_dynamic_mw > 0) as drives_ from x group by design)
select * from ({reasons}) q where reason is not null"""


@query("anomaly_skipped", _skipped_sql())
def _(s, d):
    return anomalies.skipped(measured(s, d))


@query("anomaly_replica_divergence", f"""with a as (select *, greatest(be_mw - be_leakage_mw, 0) as dyn from wide where {AT}), g as (select design, build, partition as base, count(*) as n, min(dyn) as lo, max(dyn) as hi, arg_max(fub, (dyn, fub)) as top_fub from a group by 1, 2, 3)
select design, build, base || '@' || top_fub as fub, round(hi / lo, 6) as value from g where n >= 2 and lo > 0 and hi / lo > 1.3""")
def _(s, d):
    rows = measured(s, d).withColumn("fub", F.concat("partition", F.lit("@"), "fub"))  # blocks of a partition as instances of one
    return rounded(anomalies.find(rows, "replica_divergence").select("design", "build", "fub", "value"))


@query("anomaly_by_owner", f"{RANKED.rstrip()}, found as ({_ALL_SQL}) select owner, count(*) as findings, count(*) filter (where severity = 'high') as high, count(distinct model_root) as fubs from found group by owner")
def _(s, d):
    return anomalies.by_owner(anomalies.findings(measured(s, d)))


@query("anomaly_status", f"""{RANKED}, f as (select * from r where {AT} and clock_fraction > 0.5 and be_dynamic_mw > 0), t as (select design, max(build_rank) as top from k group by design),
g as (select f.design, f.model_root, bool_or(build_rank = top) as now, bool_or(build_rank < top) as before from f join t using (design) where build_rank >= top - 1 group by 1, 2)
select design, model_root, 'clock_dominant' as rule, case when not now then 'cleared' when before then 'persisting' else 'new' end as status from g""")
def _(s, d):
    w = measured(s, d)
    return anomalies.with_status(w, anomalies.find(w, "clock_dominant"))


# closure
BUDGETS = [
    closure.Budget("ASIA", "design", "be_mw", 900.0),
    closure.Budget("ASIA", "partition:P1", "be_mw", 300.0, "typical", "nom"),
    closure.Budget("EUROPE", "fub:Brand#3", "be_leakage_mw", 2.0),
    closure.Budget("AFRICA", "design", "cdyn_pf", 150.0, "compute", "turbo", {"rtl": 40.0, "synthesis": 20.0, "placement": 12.0, "route": 6.0, "signoff": 1.0}),
    closure.Budget("AMERICA", "design", "be_mw", 5000.0),
    closure.Budget("MIDDLE EAST", "design", "be_dynamic_mw", 400.0, "typical", "nom"),
]
_VALUES = ", ".join(f"({i}, '{b.design}', '{b.scope.partition(':')[0]}', '{b.scope.partition(':')[2]}', '{b.metric}', cast({b.target} as double), '{b.workload or 'typical'}', '{b.operating_point or 'nom'}', {b.operating_point is not None}, {', '.join(f'cast({v} as double)' for v in b.tolerance_pct.values())})" for i, b in enumerate(BUDGETS))
_TOLERANCE = "case milestone " + " ".join(f"when '{m}' then t{i}" for i, m in enumerate(closure.MILESTONES)) + " end"
HISTORY = RANKED.rstrip() + f""", b(budget, design, scope, member, metric, target, w, op, fixed_op, t0, t1, t2, t3, t4) as (values {_VALUES}),
s as (select budget, b.design, scope, member, metric, target, r.build, max(r.build_rank) as build_rank, cast(sum(cast(case metric when 'be_mw' then be_mw when 'be_leakage_mw' then be_leakage_mw when 'cdyn_pf' then cdyn_pf else be_dynamic_mw end as decimal(28,9))) as double) as actual, count(distinct fub) as n_fubs, max(milestone) as milestone, max({_TOLERANCE}) as tol
  from r join b on r.design = b.design and workload = w and operating_point = op and (scope = 'design' or (scope = 'partition' and partition = member) or (scope = 'fub' and fub = member)) group by 1, 2, 3, 4, 5, 6, 7),
y as (select *, (target * (1 + tol / 100) - actual) / target * 100 as margin, case when actual > target * (1 + tol / 100) then 'OVER' when (target * (1 + tol / 100) - actual) / target * 100 < greatest(tol, 2.0) * 0.5 then 'AT RISK' else 'ON TRACK' end as status, cast(row_number() over (partition by budget order by build_rank) as double) as i from s)
"""
_OF = "budget, design, scope, member, metric, target"


def budgets(s: SparkSession) -> DataFrame:
    return closure.budget_table(s, BUDGETS)


def history(s: SparkSession, w: DataFrame) -> DataFrame:
    return closure.budget_history(w, budgets(s))


@query("budget_history", f"{HISTORY} select {_OF}, build, milestone, tol as tolerance_pct, round(actual, 6) as actual, n_fubs, round(margin, 6) as margin_pct, status from y")
def _(s, d):
    return rounded(history(s, measured(s, d)))


@query("budget_status", f"""{HISTORY}, e as (select b.budget, count(distinct x.fub) as n from b join wide x on x.design = b.design and (scope = 'design' or (scope = 'partition' and x.partition = member) or (scope = 'fub' and x.fub = member)) join (select budget, arg_max(build, i) as build from y group by 1) z on z.budget = b.budget and z.build = x.build group by 1)
select {_OF}, arg_max(build, i) as build, arg_max(milestone, i) as milestone, round(arg_max(actual, i), 6) as actual, arg_max(tol, i) as tolerance_pct, round(arg_max(margin, i), 6) as margin_pct, arg_max(status, i) as status, arg_max(n_fubs, i) as fubs_measured, count(*) as n_builds, round(case when count(*) >= 3 then regr_slope(actual, i) / target * 100 end, 6) as trend_pct, max(n) as fubs_expected from y join e using (budget) group by {_OF}""")
def _(s, d):
    w = measured(s, d)
    lineage = w.select("design", "build", "fub", "partition", "model_root").distinct()
    return rounded(closure.budget_status(history(s, w), closure.ranks_of(w), lineage))


CONVERGE = HISTORY.rstrip() + f""", c as (select {_OF}, arg_max(build, i) as build, arg_max(milestone, i) as milestone, arg_max(actual, i) as actual, arg_max(tol, i) as tol, arg_max(margin, i) as margin, arg_max(status, i) as status, count(*) as n_builds, case when count(*) >= 3 then regr_slope(actual, i) end as trend from y group by {_OF}),
cv as (select *, actual - target as gap, case when actual <= target then 'CONVERGED' when trend is null or abs(trend) < 1e-12 then 'FLAT' when trend < 0 then 'CONVERGING' else 'DIVERGING' end as verdict from c)"""


def converged(s: SparkSession, w: DataFrame) -> DataFrame:
    return closure.converge(history(s, w), closure.ranks_of(w))


@query("convergence_verdict", f"""{CONVERGE} select {_OF}, build, n_builds, round(actual, 6) as actual, round(gap, 6) as gap, round(gap / target * 100, 6) as gap_pct, round(greatest(gap, 0) / actual * 100, 6) as required_cut_pct, round(trend, 6) as trend, verdict,
  case verdict when 'CONVERGING' then round(gap / -trend, 6) when 'CONVERGED' then 0.0 else cast('infinity' as double) end as builds_to_target from cv""")
def _(s, d):
    out = converged(s, measured(s, d)).select(*closure.BUDGET, "build", "n_builds", "actual", "gap", "gap_pct", "required_cut_pct", "trend", "verdict", "builds_to_target")
    return rounded(out)


LEAK = "least(coalesce(be_leakage_mw, be_mw * 0.15), be_mw)"
SAVE = DERIVED.rstrip() + f", c as (select *, {LEAK} as leak, be_mw - {LEAK} as dyn from d where {AT})"
_SAVINGS = {"clock_gating": ("dyn * 0.35 * greatest(0.90 - cg_efficiency, 0.0)", "dynamic"), "wire_cap_reduction": ("dyn * wire_cap_fraction * 10 / 100", "dynamic"), "vt_swap": ("case when wns_ps > 20 then leak * 0.4 end", "leakage")}
for _name, (_expr, _part) in _SAVINGS.items():
    query(f"technique_{_name}", f"{SAVE} select design, build, fub, '{_name}' as technique, round({_expr}, 11) as saving_mw, round({_expr if _part == 'dynamic' else '0.0'}, 11) as dynamic_mw, round({_expr if _part == 'leakage' else '0.0'}, 11) as leakage_mw from c where {_expr} > 0")(lambda s, d, k=_name: rounded(closure.TECHNIQUES[k].savings(closure.dyn_leak(corner(wide(s, d)))), saving_mw=11, dynamic_mw=11, leakage_mw=11))
query("technique_power_gating", f"select design, build, fub, 'power_gating' as technique, round(be_mw * 0.5 * 0.9, 11) as saving_mw, 0.0 as dynamic_mw, round({LEAK} * 0.5 * 0.9, 11) as leakage_mw from wide where workload = 'idle' and operating_point = 'nom' and be_mw > 0")(lambda s, d: rounded(closure.power_gating(corner((w := measured(s, d)).join(F.broadcast(closure.idle_workload(w)), F.col("workload") == F.col("idle")), F.col("idle"))), saving_mw=11, dynamic_mw=11, leakage_mw=11))


LATEST = "l as (select design, max(build_number) as bn from wide group by design)"
DVFS = f"{LATEST}, p as (select design, operating_point, cast(sum(cast(be_mw as decimal(28,9))) as double) as power_mw, max(frequency_ghz) as f from wide join l using (design) where build_number = bn and workload = 'typical' group by 1, 2)"


@query("technique_dvfs", f"""with {DVFS}, q as (select *, power_mw / f as cost from p)
select design, count(*) as n_points, arg_min(operating_point, (cost, f, operating_point)) as best_op, arg_max(operating_point, (cost, -f, operating_point)) as worst_op, round(min(cost), 4) as best_mw_per_ghz, round(max(cost), 4) as worst_mw_per_ghz, round(greatest(arg_max(power_mw, (cost, -f, operating_point)) - arg_min(power_mw, (cost, f, operating_point)), 0), 4) as saving_mw from q group by design""")
def _(s, d):
    return rounded(closure.dvfs(select_slice(kept(table(s, d, "wide")), operating_point=None)), best_mw_per_ghz=4, worst_mw_per_ghz=4, saving_mw=4)


_SUM8 = "cast(sum(cast(round({0}, 8) as decimal(28,8))) as double)"
_COMPONENTS = "case cv.metric " + " ".join(f"when '{k}' then '{v}'" for k, v in closure.METRICS.items()) + " end"
PLAN = CONVERGE + f""", {LATEST}, x as (select d.*, {LEAK} as leak, be_mw - {LEAK} as dyn from d join l using (design) where build_number = bn),
tq as (select budget, technique, {_SUM8.format('v')} as saving_mw, {_SUM8.format("case when part = 'dynamic' then v else 0 end")} as dynamic_mw, {_SUM8.format("case when part = 'leakage' then v when part = 'gated' then g else 0 end")} as leakage_mw from (
  {' union all '.join(f"select budget, '{k}' as technique, '{p}' as part, {e} as v, 0.0 as g from b join x on x.design = b.design and workload = w and operating_point = op" for k, (e, p) in _SAVINGS.items())}
  union all select budget, 'power_gating', 'gated', be_mw * 0.5 * 0.9, leak * 0.5 * 0.9 from b join x on x.design = b.design and workload = 'idle' and operating_point = op) z where v > 0 group by 1, 2),
dp as (select budget, operating_point, {_TOTAL.format('be_mw')} as power_mw, max(frequency_ghz) as f from b join x on x.design = b.design and workload = w group by 1, 2),
dv as (select budget, round(greatest(arg_max(power_mw, (power_mw / f, -f, operating_point)) - arg_min(power_mw, (power_mw / f, f, operating_point)), 0), 8) as saving_mw from dp group by budget having count(*) > 1),
sv as (select * from tq union all select budget, 'dvfs', saving_mw, null, null from dv),
cn as (select budget, max(voltage_v) as v, max(frequency_ghz) as f from b join x on x.design = b.design and workload = w and operating_point = op group by 1),
rw as (select sv.*, {', '.join('cv.' + c.strip() for c in _OF.split(',')[1:])}, gap, fixed_op, {_COMPONENTS} as component, v, f, coalesce(case {_COMPONENTS} when 'total' then saving_mw when 'dynamic' then dynamic_mw else leakage_mw end, 0) as mw from sv join cv on cv.budget = sv.budget join b on b.budget = sv.budget left join cn on cn.budget = sv.budget),
rs as (select *, case when rw.metric = 'cdyn_pf' then mw / (v * v * f) else mw end as saving, case when technique = 'dvfs' and (component <> 'total' or fixed_op) then 'changes the corner' when mw <= 0 then 'no ' || component || ' saving' end as reason from rw)
"""


def plan(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = measured(s, d)
    return closure.closure_plan(w, budgets(s), converged(s, w))


@query("closure_plan", f"""{PLAN} select {_OF}, technique, round(saving, 4) as saving, cast(row_number() over o as int) as rank, round(sum(saving) over (o rows unbounded preceding), 4) as cumulative, round(case when gap > 0 then saving / gap * 100 end, 4) as covers_pct, round(greatest(gap - sum(saving) over (partition by budget), 0), 4) as remainder
from rs where reason is null window o as (partition by budget order by saving desc, technique)""")
def _(s, d):
    return rounded(plan(s, d)[0], saving=4, cumulative=4, covers_pct=4, remainder=4)


@query("closure_skipped", f"{PLAN} select {_OF}, technique, reason from rs where reason is not null")
def _(s, d):
    return plan(s, d)[1]


# workloads and curves
POWER = "with p as (select design, build, workload, operating_point, count(*) as n_fubs, cast(sum(cast(be_mw as decimal(28,9))) as double) as be_mw, cast(sum(cast(fe_physical_mw as decimal(28,9))) as double) as fe_physical_mw, round(avg(activity), 9) as activity, max(frequency_ghz) as frequency_ghz, max(voltage_v) as voltage_v from wide group by 1, 2, 3, 4)"


@query("design_power", f"{POWER} select * replace (round(be_mw, 9) as be_mw, round(fe_physical_mw, 9) as fe_physical_mw) from p")
def _(s, d):
    return rounded(workload.design_power(table(s, d, "wide")), be_mw=9, fe_physical_mw=9, activity=9)


ENERGY = POWER + ", e as (select p.*, f.throughput_gops, case when f.throughput_gops > 0 then be_mw / f.throughput_gops end as energy_pj_per_op from p left join performance f using (design, build, workload, operating_point))"


def energy(s: SparkSession, d: str) -> DataFrame:
    return workload.energy_per_op(workload.design_power(table(s, d, "wide")), table(s, d, "performance"))


@query("energy_per_op", f"{ENERGY} select design, build, workload, operating_point, round(energy_pj_per_op, 6) as energy_pj_per_op from e", ("wide", "performance"))
def _(s, d):
    return rounded(energy(s, d).select("design", "build", "workload", "operating_point", "energy_pj_per_op"))


@query("best_op", f"{ENERGY}, {LATEST} select design, workload, arg_min(operating_point, (energy_pj_per_op, operating_point)) as best_op, round(min(energy_pj_per_op), 6) as pj_per_op from e join l using (design) where cast(substring(build, 2) as int) = bn and energy_pj_per_op is not null group by 1, 2", ("wide", "performance"))
def _(s, d):
    return rounded(workload.best_operating_point(kept(energy(s, d))))


@query("workload_sensitivity", f"with {LATEST}, m as (select design, fub, workload, avg(be_mw) as p from wide where build_number in (select bn from l) group by 1, 2, 3) select design, fub, round(min(p), 6) as min_mw, round(max(p), 6) as max_mw, count(p) as n_workloads, round(case when min(p) > 0 then max(p) / min(p) end, 6) as dynamic_range from m group by 1, 2")
def _(s, d):
    return rounded(workload.sensitivity(kept(table(s, d, "wide"))))


@query("activity_association", f"select design, count(*) as n, round({_r('activity', 'be_mw')}, 6) as r_power, round({_r('activity', '(be_mw / fe_physical_mw)')}, 6) as r_ratio from wide group by design")
def _(s, d):
    return rounded(workload.activity_association(table(s, d, "wide")))


PERF = "f as (select design, workload, throughput_gops as t, frequency_ghz as f, ln(throughput_gops) as lt, ln(frequency_ghz) as lf from performance where throughput_gops > 0), pf as (select design, workload, count(*) as n, count(distinct f) as k, regr_slope(lt, lf) as b, regr_intercept(lt, lf) as a, ln(avg(t)) - ln(avg(f)) as a1, case when var_pop(lt) > 0 then regr_r2(lt, lf) end as r2 from f group by 1, 2), pm as (select design, workload, n, case when k < 2 then 1.0 else b end as exponent, case when k < 2 then a1 else a end as intercept, case when k >= 2 then r2 end as r2 from pf)"


@query("perf_model", f"with {PERF} select design, workload, n, round(exponent, 6) as exponent, round(intercept, 6) as intercept, round(r2, 6) as r2 from pm", ("wide", "performance"))
def _(s, d):
    return rounded(workload.perf_model(workload.with_corner_values(table(s, d, "performance"), table(s, d, "wide"))))


VOLTAGE = "vp as (select distinct design, frequency_ghz as f, voltage_v as v from wide), vc as (select design, count(*) as n, case when count(distinct f) < 2 then 0.0 else regr_slope(v, f) end as c1, case when count(distinct f) < 2 then avg(v) else regr_intercept(v, f) end as c0 from vp group by design)"


@query("dvfs_curve", f"with {VOLTAGE} select design, n, round(c1, 6) as slope, round(c0, 6) as intercept from vc")
def _(s, d):
    return rounded(workload.dvfs_curve(table(s, d, "wide")))


TIMING = """tp as (select distinct design, partition, build_number = (select max(build_number) from wide) as now, voltage_v as v, clock_period_ps - wns_ps as dl from wide),
tn as (select design, partition, count(distinct v) as volts, min((v, dl)) as anchor from tp where now group by 1, 2),
ts as (select distinct design, partition, volts, anchor, v, dl from tp left join tn using (design, partition) where (now or coalesce(volts, 0) < 2) and v > 0 and dl > 0),
tf as (select design, partition, count(*) as n, count(distinct v) as k, max(volts) as volts, max(anchor) as anchor, regr_slope(ln(dl), ln(v)) as b, regr_intercept(ln(dl), ln(v)) as a, ln(avg(dl)) as mean, case when var_pop(ln(dl)) > 0 then regr_r2(ln(dl), ln(v)) end as r2 from ts group by 1, 2),
tm as (select design, partition, n, case when k < 2 then 0.0 else b end as slope, case when k < 2 then mean when volts = 1 then ln(anchor[2]) - b * ln(anchor[1]) else a end as intercept, case when k >= 2 then r2 end as r2 from tf)"""


@query("timing_model", f"with {TIMING} select design, partition, n, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2 from tm")
def _(s, d):
    return rounded(workload.timing_model(kept(table(s, d, "wide"))))


@query("timing_history", """with h as (select * from wide where not (operating_point = 'turbo' and build_number = (select max(build_number) from wide) and partition in ('P1', 'P2'))
  and not (partition = 'P3' and build_number = (select max(build_number) from wide))), """ + TIMING.replace("from wide", "from h") + " select design, partition, n, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2 from tm")
def _(s, d):
    w = kept(table(s, d, "wide"))
    last = F.col("build") == w.select("build", "build_number").agg(F.max_by("build", "build_number")).first()[0]
    return rounded(workload.timing_model(w.where(~(last & (F.col("operating_point") == "turbo") & F.col("partition").isin("P1", "P2"))).where(~(last & (F.col("partition") == "P3")))))


@query("timing_fmax", f"with {TIMING}, g as (select *, 1000 / exp(intercept + slope * ln(0.8)) as ghz from tm) select design, round(min(ghz), 6) as fmax_ghz, arg_min(partition, (round(ghz, 9), partition)) as limited_by from g group by design")
def _(s, d):
    return rounded(workload.timing_fmax(workload.timing_model(kept(table(s, d, "wide"))), 0.8))


_PK = "design, build, workload, operating_point"
SUMMARY = f"""with t as (select *, (epoch_us(t_end) - epoch_us(t_start)) * 1000.0e0 as dt, abs(profile_total_mw - lag(profile_total_mw) over (partition by {_PK} order by t_start, event_id)) as st from profile),
q as (select {_PK}, count(*) as n_windows, sum(dt) filter (where dt > 0) as duration_ns, sum(profile_total_mw * dt) filter (where dt > 0) as area, max(profile_total_mw) as peak_mw, min(profile_total_mw) as min_mw, arg_max(event_id, (profile_total_mw, -epoch_us(t_start), -event_id)) as peak_at, max(case when dt > 0 then st / dt end) as steepest from t group by {_PK} having sum(dt) filter (where dt > 0) > 0)"""


@query("profile_summary", f"{SUMMARY} select {_PK}, n_windows, duration_ns, peak_mw, min_mw, round(steepest * 1e9, 4) as steepest_w_per_s, round(area / duration_ns, 6) as avg_mw, round(area * 1e-6 / 1e9, 6) as energy_kj, round(peak_mw / (area / duration_ns), 6) as peak_to_avg from q", ("profile",))
def _(s, d):
    out = workload.profile_summary(table(s, d, "profile"))
    out = out.withColumns({"steepest_w_per_s": F.col("max_step_mw_per_ns") * 1e9, "energy_kj": F.col("energy_uj") / 1e9})
    return rounded(out.drop("peak_at", "step_at", "max_step_mw_per_ns", "energy_uj"), steepest_w_per_s=4)


@query("profile_peak_window", f"{SUMMARY} select {_PK}, peak_at, peak_mw from q", ("profile",))
def _(s, d):
    return workload.profile_summary(table(s, d, "profile")).select("design", "build", "workload", "operating_point", "peak_at", "peak_mw")


@query("profile_reconcile", f"""{SUMMARY}, x as (select {_PK}, {_TOTAL.format('be_mw')} as reported from wide group by {_PK}), o as (select q.*, area / duration_ns as avg_mw, reported, throughput_gops from q left join x using ({_PK}) left join performance using ({_PK}))
select {_PK}, round(avg_mw, 6) as avg_mw, round(reported, 6) as reported_avg_mw, round(case when reported > 0 then (avg_mw - reported) / reported * 100 end, 6) as avg_gap_pct, not coalesce(abs(case when reported > 0 then (avg_mw - reported) / reported * 100 end) > 5, false) as profile_ok, round(case when throughput_gops > 0 then avg_mw / throughput_gops end, 6) as energy_pj_per_op from o""", ("wide", "performance", "profile"))
def _(s, d):
    out = workload.reconcile(workload.profile_summary(table(s, d, "profile")), table(s, d, "wide"), table(s, d, "performance"))
    return rounded(out.select("design", "build", "workload", "operating_point", "avg_mw", "reported_avg_mw", "avg_gap_pct", "profile_ok", "energy_pj_per_op"))


# models
SPLIT = "build_number <= 21"  # the latest sixth of 27 builds is held out


@query("model_baseline", f"select {_metrics('physical')} from wide where not ({SPLIT})")
def _(s, d):
    _, held, _ = models.split_by_build(kept(table(s, d, "wide")))
    return rounded(stats.stage_metrics(held, "physical"))


def model_rows(s: SparkSession, m: models.Linear) -> DataFrame:
    return s.createDataFrame([("intercept", m.intercept), *m.coefficients.items()], "term string, weight double")


@query("model_scaled", f"select 'intercept' as term, round(regr_intercept(be_mw, fe_physical_mw), 6) as weight from wide where {SPLIT} union all select 'fe_physical_mw', round(regr_slope(be_mw, fe_physical_mw), 6) from wide where {SPLIT}")
def _(s, d):
    train, _, _ = models.split_by_build(kept(table(s, d, "wide")))
    return rounded(model_rows(s, models.fit(train, "scaled")))


FOLDS = "with b as (select distinct build as held from wide), f as (select held, regr_slope(be_mw, fe_physical_mw) as m, regr_intercept(be_mw, fe_physical_mw) as c from wide join b on build <> held group by held), p as (select build, be_mw, fe_physical_mw * m + c as p from wide join f on build = held)"


@query("model_scaled_lobo", f"{FOLDS} select build, count(*) as n, round(avg(abs((p - be_mw) / be_mw) * 100), 6) as mape from p where be_mw <> 0 group by build")
def _(s, d):
    w = kept(table(s, d, "wide"))
    return rounded(models.score_folds(w, models.leave_one_build_out(w, "scaled")).select("build", "n", "mape"))


@query("model_cv_summary", f"""{FOLDS}, k as (select 'scaled' as kind, build, be_mw, p from p union all select 'baseline', build, be_mw, fe_physical_mw from wide),
m as (select kind, build, avg(abs((p - be_mw) / be_mw) * 100) as mape, case when var_pop(be_mw) > 0 then 1 - sum((p - be_mw) * (p - be_mw)) / (var_pop(be_mw) * count(*)) end as r2 from k group by 1, 2),
s as (select kind, avg(mape) as mape_mean, stddev_pop(mape) as mape_std, max(mape) as mape_worst, avg(r2) as r2_mean, count(*) as n_folds from m group by 1),
q as (select kind, quantile_cont((p - be_mw) / be_mw * 100, 0.05) as p05, quantile_cont((p - be_mw) / be_mw * 100, 0.5) as p50, quantile_cont((p - be_mw) / be_mw * 100, 0.95) as p95, count(*) as n from k where be_mw <> 0 group by 1)
select kind, round(mape_mean, 6) as mape_mean, round(mape_std, 6) as mape_std, round(mape_worst, 6) as mape_worst, round(r2_mean, 6) as r2_mean, n_folds, round(p05, 6) as p05, round(p50, 6) as p50, round(p95, 6) as p95, n from s join q using (kind)""")
def _(s, d):
    return rounded(models.cross_validate(kept(table(s, d, "wide")), ["baseline", "scaled"])[1])


def _least_squares(features: list[str], folds: bool) -> str:
    """CTEs up to ``w``: held, an intercept, and x1 to xk, the least-squares weights of be_mw on the rows that are not held out.

    Normal equations of correlations, solved by elimination without pivots: the matrix is positive definite where no feature
    is a sum of others. Missing values are the medians of the rows that a fit sees; f1 to fk keep them.
    """
    k = range(1, len(features) + 1)
    each = lambda text: ", ".join(text.format(i=i, c=features[i - 1]) for i in k)
    held = "select distinct build as held from d" if folds else "select 'none' as held"
    seen = "d join b on d.build <> b.held" if folds else f"d cross join b where {SPLIT}"
    out = [
        f"b as ({held})",
        f"fill as (select held, {each('median({c}) as f{i}')} from {seen} group by held)",
        f"t as (select held, be_mw as y, {each('coalesce({c}, f{i}) as x{i}')} from {seen.replace(' where', ' join fill using (held) where') if not folds else seen + ' join fill using (held)'})",
        f"m as (select held, avg(y) as my, {each('avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}')} from t group by held)",
        f"e0 as (select held, {', '.join(f'covar_pop(x{i}, x{j}) / (any_value(s{i}) * any_value(s{j})) as a{i}{j}' for i in k for j in k)}, {each('covar_pop(x{i}, y) / any_value(s{i}) as a{i}0')} from t join m using (held) group by held)",
    ]
    for n in k:
        rows = [f"a{i}{j}" if i == n else f"a{i}{j} - a{i}{n} / a{n}{n} * a{n}{j} as a{i}{j}" for i in k for j in (0, *k)]
        out.append(f"e{n} as (select held, {', '.join(rows)} from e{n - 1})")
    slopes = each("a{i}0 / a{i}{i} / s{i} as x{i}")
    out.append(f"v as (select held, {slopes} from e{len(features)} join m using (held))")
    out.append(f"w as (select held, my - ({' + '.join(f'v.x{i} * m{i}' for i in k)}) as intercept, {each('v.x{i}')}, {each('f{i}')} from v join m using (held) join fill using (held))")
    return DERIVED.rstrip() + ", " + ", ".join(out)


def _weights_sql(features: list[str]) -> str:
    terms = [("intercept", "intercept"), *[(c, f"x{i}") for i, c in enumerate(features, 1)]]
    return _least_squares(features, False) + " union all ".join(f" select '{c}' as term, round({x}, 8) as weight from w" for c, x in terms)


def _folds_sql(features: list[str]) -> str:
    predicted = " + ".join(["intercept", *[f"x{i} * coalesce({c}, f{i})" for i, c in enumerate(features, 1)]])
    return f"""{_least_squares(features, True)}, p as (select build, be_mw, {predicted} as p from d join w on build = held)
select build, count(*) as n, round(avg(abs(p - be_mw)), 6) as mae, round(avg(abs((p - be_mw) / be_mw) * 100) filter (where be_mw <> 0), 6) as mape, round(case when var_pop(be_mw) > 0 then 1 - sum((p - be_mw) * (p - be_mw)) / (var_pop(be_mw) * count(*)) end, 6) as r2 from p group by build"""


for _kind in ("linear", "physics", "datamove"):
    query(f"model_{_kind}", _weights_sql(models.features_of(_kind)))(lambda s, d, k=_kind: rounded(model_rows(s, models.fit(models.split_by_build(measured(s, d))[0], k)), weight=8))
    query(f"model_{_kind}_lobo", _folds_sql(models.features_of(_kind)))(lambda s, d, k=_kind: rounded(models.score_folds(w := measured(s, d), models.leave_one_build_out(w, k)).select("build", "n", "mae", "mape", "r2")))


@query("model_train")
def _(s, d):
    w = measured(s, d)
    done = models.train(w)
    inside = models.evaluate(w, done)
    rows = [(k, k == done.best, m["n"], m["mape"], m["r2"], models.improvement_pct(done.metrics["baseline"], m), inside[k]["mape"]) for k, m in done.metrics.items()]
    return s.createDataFrame(rows, "kind string, best boolean, n long, mape double, r2 double, improvement_pct double, mape_in_sample double")


@query("model_tree")
def _(s, d):
    train, held, _ = models.split_by_build(measured(s, d))
    return held.withColumn("predicted_mw", models.fit(train, "tree").predict()).select(*KEY, "be_mw", "predicted_mw")


@query("permutation_importance")
def _(s, d):
    w = measured(s, d)
    return models.permutation_importance(w, models.fit(w, "datamove"))


FIXED = models.Linear("datamove", 5.1234567890123, {"cell_dyn_term": 0.5, "wire_dyn_term": 0.25, "move_term": -0.125, "leak_term": 0.0625}, {"move_term": 10.0})
_P = "5.1234567890123e0 + cell_dyn_term * 0.5 + wire_dyn_term * 0.25 + coalesce(move_term, 10.0) * -0.125 + leak_term * 0.0625"
#: Coefficients of many digits, as fitted ones are: no product lies on the half of a rounded place.
MOVING = models.Linear("datamove", 1.2347913570246, {"cell_dyn_term": 0.3713579246801, "wire_dyn_term": 0.2131357924683, "move_term": 0.1370246813579, "leak_term": 0.0592468013579}, {"move_term": 10.0})
_M = {"compute_mw": "cell_dyn_term * 0.3713579246801e0", "wire_mw": "wire_dyn_term * 0.2131357924683e0", "movement_mw": "coalesce(move_term, 10.0) * 0.1370246813579e0", "leakage_mw": "leak_term * 0.0592468013579e0"}
PARTED = DERIVED.rstrip() + f", c as (select *, {', '.join(f'greatest({e}, 0) as {k}' for k, e in _M.items())}, 1.2347913570246e0 + {' + '.join(_M.values())} as predicted_mw from d)"


@query("decompose", f"{PARTED} select {KEYS}, round(predicted_mw, 6) as predicted_mw, round(compute_mw / nullif({' + '.join(_M)}, 0), 6) as compute_share, round(case when bits_per_cycle * frequency_ghz * avg_net_length_um > 0 then movement_mw * 1e-3 / (bits_per_cycle * frequency_ghz * 1e9 * avg_net_length_um / 1000) * 1e12 end, 6) as pj_per_bit_mm from c")
def _(s, d):
    rows = models.decompose(wide(s, d), MOVING)
    return rounded(rows.select(*KEY, "predicted_mw", F.col("compute_mw_share").alias("compute_share"), "pj_per_bit_mm"))


@query("decomposition_totals", f"{PARTED} select design, workload, operating_point, {', '.join(f'round(cast(sum(cast({c} as decimal(28,9))) as double), 5) as {c}' for c in [*_M, 'predicted_mw', 'be_mw'])} from c group by 1, 2, 3")
def _(s, d):
    return rounded(models.decomposition_totals(models.decompose(wide(s, d), MOVING)), **dict.fromkeys([*_M, "predicted_mw", "be_mw"], 5))


@query("whatif", f"{DERIVED}, {LATEST}, t as (select design, sum({_P}) as a, sum({_P} - wire_dyn_term * 0.25 + wire_dyn_term * 0.25 * 0.8) as b from d join l using (design) where build_number = bn and {AT} group by design) select design, round(a, 3) as current_mw, round(b, 3) as proposed_mw, round((b - a) / a * 100, 5) as delta_pct from t")
def _(s, d):
    rows = models.what_if(select_slice(measured(s, d)), FIXED, dict([models.parse_override("wire-cap=0.8", scale=True)]))
    return rounded(models.what_if_totals(rows, ["design"]), current_mw=3, proposed_mw=3, delta_pct=5)


# exploration
DESIGNS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_SCENARIO = "cast({0} as int) as place, '{1}' as name, '{2}' as design, '{3}' as workload, {4} as baseline, {5} as at_op, cast({6} as double) as f_, cast({7} as double) as v_, cast({8} as double) as wire"


def _explored(scenarios: list[explore.Scenario]) -> str:
    """The whole of explore.evaluate in SQL, for scenarios that set a corner or scale wire capacitance."""
    quoted = lambda x: "null" if x is None else f"'{x}'"
    rows = " union all ".join("select " + _SCENARIO.format(i, c.name, c.design, c.workload, quoted(c.baseline), quoted(c.operating_point), "null" if c.frequency_ghz is None else c.frequency_ghz, "null" if c.voltage_v is None else c.voltage_v, c.scales.get("wire_cap_pf", 1.0)) for i, c in enumerate(scenarios))
    return f"""{DERIVED.rstrip()}, {PERF}, {VOLTAGE}, {TIMING}, {LATEST}, sc as ({rows}),
dd as (select d.design, workload, coalesce(max(case when operating_point = 'nom' then 'nom' end), min(operating_point)) as dop from d join l using (design) where build_number = bn group by 1, 2),
rr as (select sc.*, d.* exclude (design, workload, voltage_v, frequency_ghz), coalesce(f_, frequency_ghz) as f, coalesce(v_, case when f_ is not null then c0 + c1 * f_ end, voltage_v) as v
  from sc join d on d.design = sc.design and d.workload = sc.workload join l on l.design = d.design and build_number = bn join dd on dd.design = d.design and dd.workload = d.workload and operating_point = coalesce(at_op, dop) left join vc on vc.design = d.design),
ev as (select place, name, design, workload, baseline, min(f) as frequency_ghz, min(v) as voltage_v, sum(5.1234567890123e0 + 0.5 * activity * cell_cap_pf * v * v * f + 0.25 * activity * wire_cap_pf * wire * v * v * f - 0.125 * coalesce(bits_per_cycle * avg_net_length_um * v * v * f, 10.0) + 0.0625 * area * v * v * v) as power_mw from rr group by 1, 2, 3, 4, 5),
lim as (select place, min(1000 / exp(intercept + slope * ln(voltage_v))) as fmax_ghz, arg_min(partition, (round(1000 / exp(intercept + slope * ln(voltage_v)), 9), partition)) as critical_partition from ev join tm using (design) group by place),
ex as (select ev.*, exp(pm.intercept + exponent * ln(frequency_ghz)) as throughput_gops, fmax_ghz, critical_partition, fmax_ghz is null or frequency_ghz <= fmax_ghz * 1.005 as feasible from ev left join pm on pm.design = ev.design and pm.workload = ev.workload left join lim using (place)),
dl as (select ex.*, ex.power_mw / ex.throughput_gops as energy_pj, case when ex.baseline is null then 0 else (ex.power_mw - b.power_mw) / b.power_mw * 100 end as delta_power_pct, case when ex.baseline is null then 0 else (ex.throughput_gops - b.throughput_gops) / b.throughput_gops * 100 end as delta_perf_pct from ex left join ex b on b.name = ex.baseline)
select name, design, round(frequency_ghz, 6) as frequency_ghz, round(voltage_v, 6) as voltage_v, round(power_mw, 3) as power_mw, round(throughput_gops, 4) as throughput_gops, round(energy_pj, 5) as energy_pj, round(fmax_ghz, 6) as fmax_ghz, critical_partition, feasible, round(delta_power_pct, 4) as delta_power_pct, round(delta_perf_pct, 4) as delta_perf_pct,
  feasible and throughput_gops is not null and not exists (select 1 from ex o where o.feasible and o.power_mw <= dl.power_mw and o.throughput_gops >= dl.throughput_gops and (o.power_mw < dl.power_mw or o.throughput_gops > dl.throughput_gops)) as pareto from dl"""


def _explore(s: SparkSession, d: str, w: DataFrame, scenarios: list[explore.Scenario]) -> DataFrame:
    out = explore.evaluate(w, explore.scenario_table(s, scenarios), FIXED, table(s, d, "performance"))
    out = out.select("name", "design", "frequency_ghz", "voltage_v", "power_mw", "throughput_gops", "energy_pj", "fmax_ghz", "critical_partition", "feasible", "delta_power_pct", "delta_perf_pct", "pareto")
    return rounded(out, power_mw=3, throughput_gops=4, energy_pj=5, delta_power_pct=4, delta_perf_pct=4)


SWEEP = [c for n in DESIGNS for c in explore.sweep(n, "typical", "frequency_ghz", [0.5, 0.8, 1.0, 1.2])]
WIRES = [c for n in DESIGNS for c in explore.sweep(n, "compute", "wire_cap_pf", [0.8, 0.9, 1.1], scale=True)]
CHOSEN = explore.with_baselines([explore.Scenario("fast", "ASIA", frequency_ghz=1.1), explore.Scenario("low", "ASIA", voltage_v=0.7), explore.Scenario("thin", "EUROPE", "compute", "turbo", scales={"wire_cap_pf": 0.85})])
for _name, _list in (("explore_sweep", SWEEP), ("explore_wires", WIRES), ("explore_scenarios", CHOSEN)):
    query(_name, _explored(_list), ("wide", "performance"))(lambda s, d, k=_list: _explore(s, d, measured(s, d), k))
_MAP = [explore.Scenario(f"{n} {p} (measured)", n, "typical", p, baseline=f"{n} nom (measured)") for n in DESIGNS for p in ("nom", "turbo")] + [explore.Scenario(f"{n} V=0.8 f=0.9", n, "typical", frequency_ghz=0.9, voltage_v=0.8, baseline=f"{n} nom (measured)") for n in DESIGNS]


@query("explore_opmap", _explored(_MAP), ("wide", "performance"))
def _(s, d):
    w = measured(s, d)
    return _explore(s, d, w, [c for n in DESIGNS for c in explore.operating_map(w, n, "typical", [(0.8, 0.9)])])


@query("explore_pareto", "with q(name, power_mw, speed, feasible) as (select design || build || operating_point, sum(be_mw), min(1000 / (clock_period_ps - wns_ps)), min(wns_ps) >= -35 from wide where workload = 'typical' group by design, build, operating_point) select name, feasible and not exists (select 1 from q r where r.feasible and r.power_mw <= q.power_mw and r.speed >= q.speed and (r.power_mw < q.power_mw or r.speed > q.speed)) as pareto from q")
def _(s, d):
    rows = table(s, d, "wide").where("workload = 'typical'").groupBy(F.concat("design", "build", "operating_point").alias("name")).agg(F.sum("be_mw").alias("power_mw"), F.min(F.expr("1000 / (clock_period_ps - wns_ps)")).alias("speed"), (F.min("wns_ps") >= -35).alias("feasible"))
    return models.mark_pareto(rows, speed="speed").select("name", "pareto")


TRACE = [("ASIA", 0, 2.0, "idle", "nom", None, None, None), ("ASIA", 1, 1.0, "typical", "turbo", None, None, 1.5), ("EUROPE", 0, 3.0, "compute", None, 0.9, None, None), ("EUROPE", 1, 1.0, "none", None, 1.1, 0.8, 0.5), ("AFRICA", 0, 1.5, "typical", None, 3.0, 0.9, None)]


def compact(s: SparkSession, d: str) -> DataFrame:
    return explore.export_compact(measured(s, d), FIXED, table(s, d, "performance"))


def traced(s: SparkSession, d: str) -> DataFrame:
    trace = s.createDataFrame(TRACE, "design string, interval_no int, duration_s double, workload string, operating_point string, frequency_ghz double, voltage_v double, activity_scale double")
    return explore.run_trace(compact(s, d), trace)


def _null(x) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_PHYS = ["wire_cap_pf", "cell_cap_pf", "area", "avg_net_length_um"]
TRACED = f"""with {PERF}, {VOLTAGE}, {TIMING}, {LATEST}, tr(design, interval_no, duration_s, workload, operating_point, f_, v_, s_) as (values {', '.join('(' + ', '.join(map(_null, r)) + ')' for r in TRACE)}),
lw as (select * from wide join l using (design) where build_number = bn),
fb as (select design, model_root, {', '.join(f'min({c}) as {c}' for c in _PHYS)} from lw group by 1, 2), fw as (select design, model_root, workload, avg(activity) as activity, avg(bits_per_cycle) as bits from lw group by 1, 2, 3), ff as (select design, model_root, arg_min(activity, workload) as activity, arg_min(coalesce(bits, -1), workload) as bits from fw group by 1, 2),
po as (select design, operating_point, min(voltage_v) as v, min(frequency_ghz) as f from lw group by 1, 2),
tc as (select tr.design, interval_no, duration_s, tr.workload, coalesce(cast(s_ as double), 1.0) as scale, case when tr.operating_point is not null then po.f else cast(f_ as double) end as f, case when tr.operating_point is not null then po.v else coalesce(cast(v_ as double), c0 + c1 * cast(f_ as double)) end as v from tr left join po on po.design = tr.design and po.operating_point = tr.operating_point left join vc on vc.design = tr.design),
pw as (select tc.design, interval_no, sum(5.1234567890123e0 + 0.5 * coalesce(a, 1) * cell_cap_pf * v * v * f + 0.25 * coalesce(a, 1) * wire_cap_pf * v * v * f - 0.125 * coalesce(bt * avg_net_length_um * v * v * f, 10.0) + 0.0625 * area * v * v * v) as power_mw from (
  select tc.*, fb.*  exclude (design), (case when fw.model_root is null then ff.activity else fw.activity end) * scale as a, (case when fw.model_root is null then nullif(ff.bits, -1) else fw.bits end) * scale as bt from tc join fb on fb.design = tc.design left join fw on fw.design = fb.design and fw.model_root = fb.model_root and fw.workload = tc.workload left join ff on ff.design = fb.design and ff.model_root = fb.model_root) tc group by 1, 2),
lm as (select tc.design, interval_no, min(1000 / exp(intercept + slope * ln(v))) as fmax_ghz from tc join tm on tm.design = tc.design group by 1, 2),
tl as (select tc.design, tc.interval_no, tc.workload, duration_s, f as frequency_ghz, v as voltage_v, power_mw, exp(pm.intercept + exponent * ln(f)) as throughput_gops, fmax_ghz, fmax_ghz is null or f <= fmax_ghz * 1.005 as timing_ok from tc join pw using (design, interval_no) left join lm using (design, interval_no) left join pm on pm.design = tc.design and pm.workload = tc.workload)"""


@query("trace_eval", f"{TRACED} select design, interval_no, round(frequency_ghz, 6) as frequency_ghz, round(voltage_v, 6) as voltage_v, round(power_mw, 4) as power_mw, round(power_mw * duration_s, 4) as energy_mj, round(throughput_gops, 4) as throughput_gops, round(power_mw / throughput_gops, 5) as energy_pj_per_op, round(fmax_ghz, 6) as fmax_ghz, timing_ok from tl", ("wide", "performance"))
def _(s, d):
    rows = traced(s, d).select("design", "interval_no", "frequency_ghz", "voltage_v", "power_mw", "energy_mj", "throughput_gops", "energy_pj_per_op", "fmax_ghz", "timing_ok")
    return rounded(rows, power_mw=4, energy_mj=4, throughput_gops=4, energy_pj_per_op=5)


@query("trace_totals", f"{TRACED} select round(sum(duration_s), 6) as duration_s, round(sum(power_mw * duration_s), 3) as energy_mj, round(max(power_mw), 3) as peak_power_mw, round(sum(power_mw * duration_s) / sum(duration_s), 3) as avg_power_mw, round(sum(throughput_gops * duration_s), 3) as gops, count(*) filter (where not timing_ok) as timing_violations from tl", ("wide", "performance"))
def _(s, d):
    out = explore.trace_totals(traced(s, d)).withColumn("gops", F.col("ops") / 1e9)
    return rounded(out.select("duration_s", "energy_mj", "peak_power_mw", "avg_power_mw", "gops", "timing_violations"), energy_mj=3, peak_power_mw=3, avg_power_mw=3, gops=3)


@query("trace_by_workload", f"{TRACED} select workload, round(sum(duration_s), 6) as time_s, round(sum(duration_s) / (select sum(duration_s) from tl), 6) as share_time, round(sum(power_mw * duration_s) / (select sum(power_mw * duration_s) from tl), 6) as share_energy from tl group by workload", ("wide", "performance"))
def _(s, d):
    return rounded(explore.trace_shares(traced(s, d)).select("workload", "time_s", "share_time", "share_energy"))


_KNOWN = ["wire_cap_pf", "cell_cap_pf", "area", "cell_count", "avg_net_length_um"]


@query("compact_export", f"""with {PERF}, {VOLTAGE}, {TIMING}, {LATEST}, lw as (select * from wide join l using (design) where build_number = bn),
fb as (select design, model_root, min(fub) as fub, min(partition) as partition, {', '.join(f'min({c}) as {c}' for c in _KNOWN)} from lw group by 1, 2),
fw as (select design, model_root, workload, avg(activity) as activity, avg(bits_per_cycle) as bits_per_cycle from lw group by 1, 2, 3),
po as (select design, count(distinct operating_point) as n_points, max(case when operating_point = 'nom' then voltage_v end) as nom_v, max(case when operating_point = 'turbo' then frequency_ghz end) as turbo_ghz from lw group by 1)
select fw.design, 'B' || cast(l.bn as varchar) as latest_build, 'datamove' as model_kind, 5.123456789 as intercept, -0.125e0 as move_weight, 10e0 as move_fill, n_points, nom_v, turbo_ghz, fw.model_root, fub, fb.partition, {_columns(_KNOWN, 9)}, fw.workload, round(activity, 9) as activity, round(bits_per_cycle, 9) as bits_per_cycle,
round(c0, 6) as volts_at_0, round(c1, 6) as volts_a_ghz, round(tm.intercept, 6) as delay_a, round(tm.slope, 6) as delay_k, round(pm.intercept, 6) as perf_a, round(pm.exponent, 6) as perf_b, round(pm.r2, 6) as perf_r2
from fw join fb on fb.design = fw.design and fb.model_root = fw.model_root join l on l.design = fw.design left join po on po.design = fw.design left join vc on vc.design = fw.design left join tm on tm.design = fw.design and tm.partition = fb.partition left join pm on pm.design = fw.design and pm.workload = fw.workload""", ("wide", "performance"))
def _(s, d):
    """The documents read back: a row a block and workload, with what they say of the design."""
    m = explore.read_compact(compact(s, d)).select("m.*").withColumn("f", F.explode("fubs")).withColumn("w", F.explode("f.workloads"))
    at = lambda c, k: F.try_element_at(c, F.lit(k) if isinstance(k, str) else k)
    delay, speed = at("timing", F.col("f.partition")), at("perf", F.col("w.workload"))
    return rounded(
        m.select(
            "design", "latest_build", "model_kind", F.round("intercept", 9).alias("intercept"), at("coefficients", "move_term").alias("move_weight"), at("fill", "move_term").alias("move_fill"),
            F.size("operating_points").cast("long").alias("n_points"), at("operating_points", "nom")["voltage_v"].alias("nom_v"), at("operating_points", "turbo")["frequency_ghz"].alias("turbo_ghz"),
            "f.model_root", "f.fub", "f.partition", *[at("f.physical", c).alias(c) for c in _KNOWN], "w.workload", "w.activity", "w.bits_per_cycle",
            F.col("dvfs.c0").alias("volts_at_0"), F.col("dvfs.c1").alias("volts_a_ghz"), delay["a"].alias("delay_a"), delay["k"].alias("delay_k"), speed["a"].alias("perf_a"), speed["b"].alias("perf_b"), speed["r2"].alias("perf_r2"),
        ),
        intercept=9, activity=9, bits_per_cycle=9, **dict.fromkeys(_KNOWN, 9),
    )


# costs: the given events as stages of commands, a command a user
@query("stage_totals", """with e as (select 'user ' || cast(user_id as varchar) as command, event_type as name, event_id, value from events)
select command, name, round(coalesce(sum(value), 0), 6) as wall_s, round(coalesce(sum(value / 2) filter (where event_id % 3 > 0), 0), 6) as cpu_s, round(max(abs(value) + 1), 6) as max_rss_mb, cast(coalesce(sum(event_id % 100) filter (where event_id % 2 = 0), 0) as bigint) as rows, count(*) as calls, min(event_id) as first from e group by 1, 2""", ("wide",))
def _(s, d):
    value = F.col("value")
    stages = s.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.lit("user "), "user_id").alias("command"), F.col("event_type").alias("name"), value.alias("wall_s"), F.when(F.col("event_id") % 3 > 0, value / 2).alias("cpu_s"),
        (F.abs(value) + 1).alias("max_rss_mb"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 100).cast("long").alias("rows"), F.col("event_id").cast("long").alias("place"),
    )
    return rounded(stage_totals(stages, ["command"]))


# identity: reports over the same cells
def reports(s: SparkSession, d: str) -> DataFrame:
    """Long records: an object a cell and instance, in units that vary by build."""
    w = table(s, d, "wide")
    unit = F.when(F.col("build_number") % 3 == 0, "W").when(F.col("build_number") % 3 == 1, "mW").otherwise("uW")
    obj = F.concat(F.lit("soc/"), "fub", F.lit("/i"), (F.col("build_number") % 3).cast("string"))
    return w.select("design", "build", "workload", "operating_point", obj.alias("object"), F.lit("be_hier").alias("object_kind"), F.lit("be_mw").alias("metric"), F.col("be_mw").alias("value"), unit.alias("unit"), F.lit("r").alias("source_file"), F.lit("signoff").alias("source"), F.lit(0).cast("long").alias("ordinal"))


def block_map(s: SparkSession) -> DataFrame:
    """Odd blocks are split in two objects, even ones replicated under a glob; blocks 1 and 3 share an object."""
    rows = []
    for n in range(1, 26):
        names = [f"soc/Brand#{n}/i0", f"soc/Brand#{n}/i1"] if n % 2 else [f"soc/Brand#{n}/i*"]
        rows += [(f"Brand#{n}", f"fe/Brand#{n}", name, f"P{n % 5}", 1.0) for name in names]
    rows.append(("Brand#3", "fe/Brand#3", "soc/Brand#1/i0", "P3", 3.0))
    return s.createDataFrame(rows, "fub string, fe_hier string, be_hier string, partition string, be_share double")


LONG = """
l as (select *, 'soc/' || fub || '/i' || cast(build_number % 3 as varchar) as object, cast(substring(fub, 7) as int) as n, build_number % 3 as i from wide),
x as (select l.*, case when n % 2 = 0 then fub || '@' || cast(i as varchar) else fub end as to_fub, case when n = 1 and i = 0 then 0.25e0 else 1e0 end as weight from l where n % 2 = 0 or i < 2
  union all select l.*, 'Brand#3', 0.75e0 from l where n = 1 and i = 0)
"""


@query("unit_conversion", f"with {LONG} select design, build, object, workload, operating_point, round(be_mw * case i when 0 then 1000 when 1 then 1 else 0.001 end, 9) as value, 'mw' as unit from l")
def _(s, d):
    return rounded(identity.convert_units(reports(s, d)).select("design", "build", "object", "workload", "operating_point", "value", "unit"), value=9)


@query("duplicate_source_rows", f"""with {LONG}, r as (select 1 as n_copies from l where build_number % 2 = 0 and workload = 'typical' union all select 2 from l where build_number % 8 = 0 and workload = 'typical')
select 'duplicate_source_row' as flag, cast(sum(n_copies) as bigint) as n from r union all select 'unit_normalized', count(*) filter (where i <> 1) + count(*) filter (where i <> 1 and workload = 'typical' and build_number % 2 = 0) + 2 * count(*) filter (where i <> 1 and workload = 'typical' and build_number % 8 = 0) from l""")
def _(s, d):
    """Reports of even builds name their typical rows twice, of every eighth build four times: each copy but the first counts."""
    rows = identity.convert_units(reports(s, d))
    number = F.substring("build", 2, 9).cast("int")
    again = rows.where((number % 2 == 0) & (F.col("workload") == "typical"))
    copies = F.when(number % 8 == 0, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    planted = rows.unionByName(again.withColumn("copy_", F.explode(copies)).drop("copy_"))
    return quality.source_counts(planted)


@query("source_counts", f"with {LONG} select 'unit_normalized' as flag, count(*) filter (where i <> 1) as n from l union all select 'unmapped_objects', count(*) filter (where n % 2 = 1 and i = 2) from l")
def _(s, d):
    long = identity.convert_units(reports(s, d))
    return quality.source_counts(long, identity.resolve_objects(long, block_map(s))[1])


@query("resolve_objects", f"with {LONG} select design, build, object, workload, operating_point, to_fub as fub, round(weight, 6) as weight from x")
def _(s, d):
    mapped, _ = identity.resolve_objects(reports(s, d), block_map(s))
    return rounded(mapped.select("design", "build", "object", "workload", "operating_point", "fub", "weight"))


@query("unmapped_objects", f"with {LONG} select object, count(*) as n from l where n % 2 = 1 and i = 2 group by object")
def _(s, d):
    return identity.resolve_objects(reports(s, d), block_map(s))[1].groupBy("object").agg(F.count("*").alias("n"))


@query("aggregate_metric", f"with {LONG} select design, build, to_fub as fub, workload, operating_point, round(sum(be_mw * case i when 0 then 1000 when 1 then 1 else 0.001 end * weight), 6) as be_mw from x group by 1, 2, 3, 4, 5")
def _(s, d):
    mapped, _ = identity.resolve_objects(identity.convert_units(reports(s, d)), block_map(s))
    return rounded(identity.pivot_wide(identity.aggregate_metrics(mapped), ["be_mw"]))


@query("measurement_pivot", f"with {LONG} select design, build, to_fub as fub, workload, operating_point, round(min(be_mw), 9) as be_mw from x group by 1, 2, 3, 4, 5")
def _(s, d):
    mapped, _ = identity.resolve_objects(reports(s, d), block_map(s))
    return rounded(MeasurementStore(mapped).pivot(["be_mw"]), be_mw=9)


@query("lineage_issues", f"""with {LONG}, m as (select distinct cast(substring(fub, 7) as int) as n, fub from wide), r as (select distinct design, build from x),
s as (select distinct design, build, string_split(to_fub, '@')[1] as fub from x) select r.design, r.build, m.fub, case when s.fub is null then 'fe_hier_not_in_reports;be_hier_not_in_reports;incomplete_physical_mapping' else 'fe_hier_not_in_reports;incomplete_physical_mapping' end as issues from r cross join m left join s on s.design = r.design and s.build = r.build and s.fub = m.fub""")
def _(s, d):
    mapped, _ = identity.resolve_objects(reports(s, d), block_map(s))
    return identity.lineage(mapped, block_map(s)).select("design", "build", F.split("fub", "@")[0].alias("fub"), F.array_join("lineage_issues", ";").alias("issues")).distinct()


@query("replica_share", f"""with {LONG}, e as (select design, build, workload, operating_point, string_split(to_fub, '@')[1] as base, to_fub, be_mw from x where n % 2 = 0), c as (select design, build, base, count(distinct to_fub) as k from e group by 1, 2, 3)
select design, build, to_fub as fub, workload, operating_point, round(be_mw, 9) as be_mw, round(100.0 / k, 9) as fe_physical_mw, 0.5 as activity from e join c using (design, build, base)""")
def _(s, d):
    mapped, _ = identity.resolve_objects(reports(s, d), block_map(s))
    keys = ["design", "build", "workload", "operating_point"]
    instances = mapped.where(F.col("fub").contains("@")).select(*keys, "fub", F.col("value").alias("be_mw"), F.lit(None).cast("double").alias("fe_physical_mw"), F.lit(None).cast("double").alias("activity"))
    modules = instances.select(*keys, F.split("fub", "@")[0].alias("fub")).distinct().select(*keys, "fub", F.lit(None).cast("double").alias("be_mw"), F.lit(100.0).alias("fe_physical_mw"), F.lit(0.5).alias("activity"))
    return rounded(identity.share_modules(instances.unionByName(modules), ["fe_physical_mw", "activity"]), be_mw=9, fe_physical_mw=9)


@query("intent_issues", f"""with {LATEST}, b as (select fub, partition, operating_point, voltage_v from wide join l using (design) where build_number = bn and workload = 'typical' group by all),
e(domain, element, state, voltage) as (values ('PD0', 'P0', 'nom', 0.75e0), ('PD0', 'P0', 'turbo', 0.85e0), ('PD1', 'P1', 'nom', 0.75e0), ('PD1', 'P1', 'turbo', 0.80e0), ('PD1b', 'P1/Brand#6', 'nom', 0.75e0), ('PD2', 'P2', 'nom', 0.75e0)),
f as (select distinct fub, partition from b), h as (select f.fub, count(distinct domain) as n, min(domain) as first from f left join e on partition || '/' || fub = element or (partition || '/' || fub) like element || '/%' group by 1),
o as (select distinct operating_point, voltage_v from b), j as (select h.fub, n, first, bool_or(first is not null and e.state is null) as lost, bool_or(abs(e.voltage - voltage_v) > 0.005) as off from h cross join o left join e on e.domain = first and e.state = operating_point group by 1, 2, 3)
select fub, first as power_domain, concat_ws(';', case when n = 0 then 'no_power_domain' end, case when n > 1 then 'multiple_power_domains' end, case when lost then 'domain_state_missing' end, case when off then 'domain_voltage_mismatch' end) as issues from j""")
def _(s, d):
    rows = select_slice(kept(table(s, d, "wide")), operating_point=None)
    blocks = rows.select("fub", F.concat_ws("/", "partition", "fub").alias("be_hier"), F.lit(None).cast("string").alias("fe_hier")).distinct()
    states = [("PD0", "P0", "nom", 0.75), ("PD0", "P0", "turbo", 0.85), ("PD1", "P1", "nom", 0.75), ("PD1", "P1", "turbo", 0.80), ("PD1b", "P1/Brand#6", "nom", 0.75), ("PD2", "P2", "nom", 0.75)]
    domains = s.createDataFrame([(a, b, "VDD", c, v) for a, b, c, v in states], "domain string, element string, supply_net string, state string, voltage double")
    points = rows.select("operating_point", "voltage_v").distinct()
    return identity.intent_table(blocks, domains, points).select("fub", "power_domain", F.array_join("intent_issues", ";").alias("issues"))


@query("keyed_replace", "with n as (select design, build, fub, be_mw * 2 as be_mw from wide where build_number between 3 and 5 and design < 'ASIB') select design, build, fub, round(be_mw, 9) as be_mw from wide w where not exists (select 1 from n where n.design = w.design and n.build = w.build) union all select design, build, fub, round(be_mw, 9) from n")
def _(s, d):
    w = kept(table(s, d, "wide"))
    new = w.where("build_number between 3 and 5 and design < 'ASIB'").select("design", "build", "fub", (F.col("be_mw") * 2).alias("be_mw"))
    return rounded(tables.keyed_replace(w.select("design", "build", "fub", "be_mw"), new, ["design", "build"]), be_mw=9)


@query("append_last_wins", "select design, build, fub, workload, operating_point, round(case when build_number >= 3 then be_mw * 2 else be_mw end, 9) as be_mw from wide")
def _(s, d):
    w = kept(table(s, d, "wide")).select(*KEY, "be_mw", "build_number", F.lit(0).alias("ordinal"))
    new = w.where("build_number >= 3").withColumn("be_mw", F.col("be_mw") * 2)
    return rounded(tables.append_last_wins(w, new, KEY).select(*KEY, "be_mw"), be_mw=9)


@query("sql_over_views", "select design, count(*) as n from wide where workload = 'idle' group by design")
def _(s, d):
    return tables.run_sql(s, "select design, count(*) as n from measurements where workload = 'idle' group by design", measurements=table(s, d, "wide"))


@query("metadata_json", "select cast(json_extract(props, '$.k') as int) as k, count(*) as n from events group by 1")
def _(s, d):
    props = F.get_json_object("props", "$.k").cast("int")
    return s.read.parquet(f"{d}/events.parquet").groupBy(props.alias("k")).agg(F.count("*").alias("n"))
