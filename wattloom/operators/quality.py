"""Data quality: validation that rejects rows, sanitizing flags, and trust in metrics.

Each check is (code, condition, blocking); a row's codes keep the order of the checks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import Config
from wattloom.functions.expr import issue_list, pearson

KEY = ["design", "build", "fub", "stage", "workload", "operating_point"]
#: Fixed: the columns of the wide table by role.
POWER = ["fe_logical_mw", "fe_physical_mw", "be_mw", "be_clock_mw", "be_register_mw", "be_comb_mw", "be_memory_mw", "fe_leakage_mw", "be_leakage_mw"]
FEATURES = ["be_voltus_mw", "cg_efficiency", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "frequency_ghz", "voltage_v", "activity", "net_count", "wire_length_um", "avg_net_length_um", "bits_per_cycle"]
TIMING = ["clock_period_ps", "wns_ps", "tns_ps", "violating_endpoints", "fmax_ghz"]
NUMERIC = [*POWER, *FEATURES, *TIMING]
REQUIRED = ["design", "build", "fub", "stage", "fe_logical_mw", "fe_physical_mw", "be_mw"]
NON_NEGATIVE = [c for c in NUMERIC if c not in ("wns_ps", "tns_ps")]
GROUPS = ["be_clock_mw", "be_register_mw", "be_comb_mw", "be_memory_mw"]
PHYSICAL = ["wire_cap_pf", "cell_cap_pf", "area"]
TRUST = ["fe_logical_mw", "fe_physical_mw", "be_voltus_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "activity", "bits_per_cycle", "cg_efficiency", "wire_length_um", "avg_net_length_um", "frequency_ghz", "voltage_v", "wns_ps", "fmax_ghz"]
#: Fixed thresholds that no setting changes.
RATIO_RANGE, Z_LIMIT, Z_LEAST = (0.2, 5.0), 4.0, 10
#: Lineage and intent issues by the check that they raise.
BLOCKING_ISSUES = ["fe_hier_not_in_reports", "be_hier_not_in_reports", "incomplete_physical_mapping"]
TIMING_ISSUES = ["no_partition", "partition_timing_missing"]
DOMAIN_MISSING = ["no_power_domain", "multiple_power_domains"]
DOMAIN_MISMATCH = ["domain_voltage_mismatch", "domain_state_missing"]
@dataclass(frozen=True)
class Facts:
    """What checks are told: the settings, the columns there are, and what was prepared over all rows."""

    cfg: Config
    has: frozenset[str]
    marks: dict[str, Column]  # issues of lineage and intent, by check
    duplicate: Column
    leakage_spread_pct: Column  # over workloads, of a block's leakage

    def some(self, condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def lacks(self, columns: list[str]) -> Column:
        return F.exists(F.array(*[F.col(c).isNull() if c in self.has else F.lit(True) for c in columns]), lambda x: x)

    def negative(self) -> Column:
        return F.exists(F.array(*[self.some(F.col(c) < 0) for c in NON_NEGATIVE if c in self.has]), lambda x: x)

    def leakage(self) -> Column:
        over = self.some(F.col("be_leakage_mw") > F.col("be_mw") * 1.001) | self.some(self.leakage_spread_pct > self.cfg.leakage_workload_tol_pct)
        return over if "be_leakage_mw" in self.has else _no()

    def groups(self) -> Column:
        groups = [F.col(c) for c in GROUPS if c in self.has]
        if not groups:
            return _no()
        total = sum((F.coalesce(c, F.lit(0.0)) for c in groups), F.lit(0.0))
        return F.coalesce(*groups).isNotNull() & (F.when(F.col("be_mw") > 0, F.abs(total - F.col("be_mw")) / F.col("be_mw") * 100) > self.cfg.group_sum_tol_pct)

    def zero(self) -> Column:
        return F.abs("be_mw") < self.cfg.near_zero_mw

    def magnitude(self) -> Column:
        size = F.when(F.col("median_") > 0, F.col("be_mw") / F.col("median_"))
        return ~self.zero() & ((size > self.cfg.unit_magnitude_ratio) | (size < 1 / self.cfg.unit_magnitude_ratio))

    def stale(self) -> Column:
        old = F.col("build_status") == "superseded" if "build_status" in self.has else _no()
        late = F.datediff("newest_", "build_date") > self.cfg.stale_days if "build_date" in self.has else _no()
        return self.some(old) | self.some(late)

    def outlier(self) -> Column:
        return self.some(F.col("z_be_") > Z_LIMIT) | self.some(_outlier_ratio(F.col("be_mw"), F.col("fe_physical_mw")))

    def timing(self) -> Column:
        return (F.col("wns_ps") > F.col("clock_period_ps")) | (F.col("clock_period_ps") <= 0) if {"wns_ps", "clock_period_ps"} <= self.has else _no()

    def vectorless(self) -> Column:
        return F.lower("be_activity_mode").startswith("vectorless") if "be_activity_mode" in self.has else _no()


@dataclass(frozen=True)
class Check:
    """A check's label, whether its rows are unusable, and its condition on a row; None counts rows of other tables."""

    label: str
    blocking: bool
    test: Callable[[Facts], Column] | None = None


#: The checks in the order of a row's flags; register one by adding it.
CHECKS = {
    "missing_metric": Check("Missing power metrics", True, lambda f: f.lacks(["fe_logical_mw", "fe_physical_mw", "be_mw"])),
    "missing_physical": Check("Missing physical data", True, lambda f: f.lacks(PHYSICAL)),
    "duplicate": Check("Duplicate records", True, lambda f: f.duplicate),
    "negative": Check("Impossible negative values", True, Facts.negative),
    "leakage_suspect": Check("Leakage above the total, or varying with the workload", False, Facts.leakage),
    "group_sum_mismatch": Check("Power groups do not sum to the total", False, Facts.groups),
    "near_zero_be": Check("Zero or near-zero power", True, Facts.zero),
    "unit_suspect": Check("Magnitude unlike the design's", True, Facts.magnitude),
    "stale_build": Check("Stale or superseded builds", True, Facts.stale),
    "outlier": Check("Outliers", False, Facts.outlier),
    "lineage_mismatch": Check("Lineage mismatches", True, lambda f: f.marks["lineage_mismatch"]),
    "timing_missing": Check("Partition without timing", False, lambda f: f.marks["timing_missing"]),
    "timing_suspect": Check("Slack above the period, or no positive period", False, Facts.timing),
    "vectorless_power": Check("Power from vectorless activity", False, Facts.vectorless),
    "intent_mismatch": Check("Domain voltage unlike the operating point's", False, lambda f: f.marks["intent_mismatch"]),
    "intent_missing": Check("No power domain", False, lambda f: f.marks["intent_missing"]),
    "duplicate_source_row": Check("Duplicate rows in reports", False),
    "unit_normalized": Check("Unit conversions", False),
    "unmapped_objects": Check("Unmapped report objects", False),
}


def duplicated(df: DataFrame) -> Column:
    keys = [c for c in KEY if c in df.columns]
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def _no() -> Column:
    return F.lit(False)


def with_z(df: DataFrame, column: str, name: str) -> DataFrame:
    """|z| of the logarithm of positive values over the whole table; missing under ten of them."""
    log = F.when(F.col(column) > 0, F.ln(column))
    stats = df.agg(F.avg(log).alias("mean_"), F.stddev_pop(log).alias("sd_"), F.count(log).alias("n_"))
    z = F.abs(log - F.col("mean_")) / F.when(F.col("sd_") > 0, F.col("sd_")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).withColumn(name, F.when(F.col("n_") >= Z_LEAST, z)).drop("mean_", "sd_", "n_")  # stats is one row


def _outlier_ratio(be: Column, physical: Column) -> Column:
    r = F.when(be > 0, physical / be)
    return (r < RATIO_RANGE[0]) | (r > RATIO_RANGE[1])


def validate(df: DataFrame) -> DataFrame:
    """df with ``errors`` and ``warnings`` (arrays of codes) and ``reject_reason``.

    Text in a numeric column is an error where it is no number and counts as missing where it is blank; the column
    becomes a number. A required column that is absent is an error of every row; it is not added.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in NUMERIC if kinds.get(c) == "string"]
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    unread = [(f"non_numeric:{c}", ~blank(f"text_{c}") & F.col(c).isNull()) for c in texts]
    df = df.withColumns({f"text_{c}": F.col(c) for c in texts}).withColumns({c: F.col(c).try_cast("double") for c in texts})
    absent = [(f"missing_column:{c}", F.lit(True)) for c in REQUIRED if c not in kinds]
    missing = [(f"missing_value:{c}", blank(f"text_{c}") if c in texts else blank(c) if kinds[c] == "string" else F.col(c).isNull()) for c in REQUIRED if c in kinds]
    negative = [(f"negative:{c}", F.col(c) < 0) for c in NON_NEGATIVE if c in kinds]
    be = F.col("be_mw") if "be_mw" in kinds else F.lit(None).cast("double")
    physical = F.col("fe_physical_mw") if "fe_physical_mw" in kinds else F.lit(None).cast("double")
    df = (with_z(df, "be_mw", "z_be_") if "be_mw" in kinds else df.withColumn("z_be_", F.lit(None).cast("double"))).withColumn("duplicate_", duplicated(df))
    errors = issue_list(*absent, *unread, *missing, ("zero_be", be == 0), *negative, ("duplicate_key", F.col("duplicate_")))
    features = [c for c in FEATURES if c in kinds]
    some_missing = F.exists(F.array(*[F.col(c).isNull() for c in features]), lambda x: x) if features else _no()
    warnings = issue_list(("missing_feature", some_missing), ("outlier_ratio", _outlier_ratio(be, physical)), ("outlier_be", F.col("z_be_") > Z_LIMIT))
    out = df.withColumns({"errors": errors, "warnings": warnings}).drop("z_be_", "duplicate_", *[f"text_{c}" for c in texts])
    return out.withColumn("reject_reason", F.when(F.size("errors") > 0, F.array_join("errors", ";")))


def validation_issues(validated: DataFrame) -> DataFrame:
    """(level, code, n) of a validated table; feature columns that it lacks are one warning on no row."""
    code = lambda c, level: validated.select(F.lit(level).alias("level"), F.explode(c).alias("code"))
    out = code("errors", "error").unionByName(code("warnings", "warning")).groupBy("level", "code").agg(F.count("*").alias("n"))
    absent = [c for c in FEATURES if c not in validated.columns]
    if absent:
        out = out.unionByName(validated.sparkSession.createDataFrame([("warning", "absent_feature_columns:" + ",".join(absent), 0)], "level string, code string, n long"))
    return out


def _marks(issues: DataFrame, column: str, groups: dict[str, list[str]]) -> DataFrame:
    """Per design, build and block: whether any of its issues is one of a group."""
    return issues.groupBy("design", "build", "fub").agg(*[F.max(F.arrays_overlap(column, F.array(*[F.lit(c) for c in codes]))).alias(name) for name, codes in groups.items()])


def sanitize(df: DataFrame, cfg: Config | None = None, lineage: DataFrame | None = None, intent: DataFrame | None = None) -> DataFrame:
    """df with ``quality_flags`` (array) and ``usable``; no row is dropped.

    lineage and intent: tables of (design, build, fub) with arrays ``lineage_issues`` and ``intent_issues``.
    """
    cfg = cfg or Config()
    has = set(df.columns)
    names = df.columns
    be, leak = F.col("be_mw"), F.col("be_leakage_mw")
    dated = "build_date" in has
    by_design = df.groupBy("design").agg(F.median(be).alias("median_"), (F.max("build_date") if dated else F.lit(None).cast("date")).alias("newest_"))
    df = with_z(df, "be_mw", "z_be_").join(by_design, "design", "left")  # a row a design
    marks = {"lineage_mismatch": _no(), "timing_missing": _no(), "intent_mismatch": _no(), "intent_missing": _no()}
    for table, column, groups in ((lineage, "lineage_issues", {"lineage_mismatch": BLOCKING_ISSUES, "timing_missing": TIMING_ISSUES}), (intent, "intent_issues", {"intent_mismatch": DOMAIN_MISMATCH, "intent_missing": DOMAIN_MISSING})):
        if table is not None:
            df = df.join(_marks(table, column, {f"{k}_": v for k, v in groups.items()}), ["design", "build", "fub"], "left")
            marks |= {k: F.col(f"{k}_") for k in groups}
    spread_pct = _no().cast("double")
    if "be_leakage_mw" in has and "workload" in has:
        spread = Window.partitionBy("design", "build", "fub", "operating_point")
        mean = F.avg(leak).over(spread)
        spread_pct = F.when(mean > 0, (F.max(leak).over(spread) - F.min(leak).over(spread)) / mean * 100)
    facts = Facts(cfg, frozenset(has), marks, duplicated(df.select(*names)), spread_pct)
    row_checks = {code: c for code, c in CHECKS.items() if c.test is not None}
    flags = issue_list(*[(code, c.test(facts)) for code, c in row_checks.items()])
    blocking = F.array(*[F.lit(code) for code, c in row_checks.items() if c.blocking])
    return df.withColumn("quality_flags", flags).withColumn("usable", ~F.arrays_overlap("quality_flags", blocking)).select(*names, "quality_flags", "usable")


def flag_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def source_counts(long: DataFrame | None = None, unmapped: DataFrame | None = None) -> DataFrame:
    """(flag, n) of the checks that count rows of the long and unmapped tables."""
    out = None
    if long is not None:
        keys = [c for c in ("design", "build", "object", "fub", "metric", "workload", "operating_point", "source_file") if c in long.columns]
        repeats = long.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_source_row").alias("flag"), "n")
        converted = long.where(F.lower("unit_original") != F.lower("unit")).agg(F.count("*").alias("n")).select(F.lit("unit_normalized").alias("flag"), "n")
        out = repeats.unionByName(converted)
    if unmapped is not None:
        lost = unmapped.where("object_kind <> 'design'").agg(F.count("*").alias("n")).select(F.lit("unmapped_objects").alias("flag"), "n")
        out = lost if out is None else out.unionByName(lost)
    if out is None:
        raise ValueError("neither long nor unmapped records")
    return out.where("n > 0")


def quality_report(flagged: DataFrame) -> DataFrame:
    """One row: rows, block and build combinations, usable rows and their share."""
    return flagged.agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct("design", "build", "fub")).alias("n_fubs"), F.count_if("usable").alias("n_usable"), (100.0 * F.try_divide(F.count_if("usable"), F.count("*"))).alias("usable_pct"))


def metric_quality(df: DataFrame, metrics: list[str] | None = None, target: str = "be_mw", long: DataFrame | None = None) -> DataFrame:
    """One row a metric: coverage, correlation with the target and its range over builds, unit conversions, outliers, verdict and notes."""
    metrics = [m for m in metrics or TRUST if m in df.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    rows = df.select("build", F.col(target).alias("y"), F.explode(pairs).alias("p")).select("build", "y", "p.*")
    whole = rows.groupBy("metric").agg((100.0 * F.count("x") / F.count("*")).alias("coverage_pct"), pearson(F.col("x"), F.col("y")).alias("r_target"), F.avg("x").alias("mean_"), F.stddev_pop("x").alias("sd_"), F.count("x").alias("n_"))
    far = rows.join(F.broadcast(whole.select("metric", "mean_", "sd_", "n_")), "metric").where((F.col("n_") >= Z_LEAST) & (F.col("sd_") > 0) & (F.abs(F.col("x") - F.col("mean_")) > Z_LIMIT * F.col("sd_")))
    builds = rows.groupBy("metric", "build").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r")).where("n >= 10")
    spread = builds.groupBy("metric").agg(F.min("r").alias("r_min_build"), F.max("r").alias("r_max_build"))
    out = whole.drop("mean_", "sd_", "n_").join(spread, "metric", "left").join(far.groupBy("metric").agg(F.count("*").alias("outliers")), "metric", "left")
    if long is None:
        out = out.withColumn("unit_conversions", F.lit(0).cast("long"))
    else:
        out = out.join(long.where(F.lower("unit_original") != F.lower("unit")).groupBy("metric").agg(F.count("*").alias("unit_conversions")), "metric", "left")
    out = out.fillna(0, ["outliers", "unit_conversions"])
    coverage, gap = F.col("coverage_pct"), F.col("r_max_build") - F.col("r_min_build")
    verdict = F.when(coverage < 50, "unusable").when(gap > 0.25, "unstable").when(coverage < 90, "partial").otherwise("trusted")
    notes = F.concat_ws(
        "; ",
        F.when(coverage < 90, F.format_string("coverage %.0f%%", coverage)),
        F.when(gap > 0.25, F.format_string("r varies %.2f..%.2f across builds", F.col("r_min_build"), F.col("r_max_build"))),
        F.when(F.col("unit_conversions") > 0, F.concat(F.col("unit_conversions").cast("string"), F.lit(" unit conversions"))),
        F.when(F.col("outliers") > 0, F.concat(F.col("outliers").cast("string"), F.lit(" outliers"))),
    )
    return out.withColumns({"verdict": verdict, "notes": notes})
