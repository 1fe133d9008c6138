"""From run folders to stored tables: read, convert, resolve, aggregate, pivot, validate, store.

Each source is read once over all runs; design, build and a run's settings come from the folder that a file
lies under. The long table is written first and everything else is made from what was written.
"""

from __future__ import annotations

import json
import shlex
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import catalog
from wattloom.config import Config
from wattloom.functions.expr import fmax
from wattloom.operators import identity, quality
from wattloom.profiling import step
from wattloom.operators.derive import with_derived, with_features
from wattloom.sources.reports import READERS, SPECS, read_intent, read_reports
from wattloom.sources.tables import read_table, split_rejected, store

METRICS = ["fe_logical_mw", "fe_physical_mw", "be_mw", "be_leakage_mw", "fe_leakage_mw", "be_voltus_mw", "be_clock_mw", "be_register_mw", "be_comb_mw", "be_memory_mw", "cg_efficiency", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "wire_length_um", "avg_net_length_um", "net_count", "activity", "bits_per_cycle", "clock_period_ps", "wns_ps", "tns_ps", "violating_endpoints"]
#: Fixed: what replicas of a block become (only per_instance keeps them apart; mean has sum's rows), and how blocks share an object.
REPLICA_POLICIES, MERGE_BASES, KINDS = ("sum", "per_instance", "mean"), ("share", "equal"), ("explicit_map", "same_hierarchy")
TABLES = ["measurements", "rejected", "measurements_long", "lineage", "unmapped", "performance", "power_profile", "power_intent", "quality_flags", "measurements_sanitized"]
_META = "folder string, design string, build string, run_id string, build_date string, status string, design_type string, milestone string, tools string, sim_clock_period_ps double, object_kind string"


def find_runs(spark: SparkSession, root: str) -> list[dict]:
    """Metadata of each run under root/design/build, in order of path; a row a run."""
    files = spark.read.text(f"{root.rstrip('/')}/*/*/metadata.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return [json.loads(r.value) | {"path": r.path.rpartition("/")[0]} for r in files.orderBy("path").collect()]


def settings(meta: dict) -> dict:
    """What reports of a run need to know of it, and the columns that its rows carry."""
    flow, points = meta.get("activity_flow") or {}, meta.get("operating_points") or {}
    nominal = points.get("nom") or next(iter(points.values()), {})
    period = flow.get("sim_clock_period_ps") or (1000 / nominal["frequency_ghz"] if nominal.get("frequency_ghz") else None)
    tools = ";".join(f"{k}={v}" for k, v in (meta.get("tools") or {}).items())
    return {
        "folder": meta["path"], "design": str(meta["design"]), "build": str(meta["build"]), "run_id": meta.get("run_id"), "build_date": meta.get("build_date"), "status": meta.get("status", "current"), "design_type": meta.get("design_type", "unspecified"),
        "milestone": meta.get("milestone", "signoff"), "tools": tools, "sim_clock_period_ps": None if period is None else float(period), "object_kind": {"fe": "fe_hier", "be": "be_hier"}.get(flow.get("hierarchy", "be")),
    }


def _run_folder(path: str, folders: list[str]):
    """The run folder that a file lies under; all are equally deep, as they match one pattern."""
    [depth] = {f.count("/") for f in folders}
    return F.substring_index(path, "/", depth + 1)


def _found(read):
    """A table over a glob, or none where nothing matches it."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _names(cfg: Config) -> dict:
    own = {k: cfg.identity[k] for k in ("divider", "strip_top", "lowercase") if k in cfg.identity}
    return own | {"rules": [tuple(r) for r in cfg.identity.get("name_rules", [])]}


def read_long(spark: SparkSession, root: str, runs: list[dict], cfg: Config | None = None) -> DataFrame:
    """All long records of the runs, with their provenance; a source is one read whatever the number of runs."""
    cfg = cfg or Config()
    known = {s["folder"]: s for s in map(settings, runs)}
    frames = []
    for source in READERS:
        if source not in cfg.disabled_sources:
            frames.append(_found(lambda source=source: read_reports(spark, f"{root.rstrip('/')}/*/*", source, cfg.source_patterns.get(source), known)))
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError(f"no reports under {root}")
    rows = reduce(DataFrame.unionByName, frames)
    meta = spark.createDataFrame([tuple(s[c.split()[0]] for c in _META.split(", ")) for s in known.values()], _META)
    folders = meta.drop("object_kind", "sim_clock_period_ps").withColumnsRenamed({"run_id": "meta_run_id", "status": "build_status"})
    out = rows.withColumn("folder", _run_folder("source_file", list(known))).join(folders, "folder").drop("folder")
    name = identity.normalize_name(F.trim("object"), **_names(cfg))
    return out.withColumn("object", F.when(F.col("object_kind").isin("fe_hier", "be_hier", "partition"), name).otherwise(F.col("object")))


def inconsistent(long: DataFrame) -> DataFrame:
    """(design, build, source_file, error) of reports whose own run or build is not the run's: stale or misplaced files."""
    wrong_run = F.col("run_id").isNotNull() & F.col("meta_run_id").isNotNull() & (F.col("run_id") != F.col("meta_run_id"))
    wrong_build = F.col("report_build").isNotNull() & (F.col("report_build") != F.col("build"))
    said = F.when(wrong_run, F.concat(F.lit("run id "), "run_id", F.lit(" is not the run's "), "meta_run_id")).otherwise(F.concat(F.lit("build "), "report_build", F.lit(" is not the run's")))
    return long.where(wrong_run | wrong_build).select("design", "build", "source_file", said.alias("error")).distinct()


def missing_sources(long: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(design, build, source_file, error) of sources that a run must have and lacks."""
    cfg = cfg or Config()
    wanted = [k for k, (_, _, optional) in SPECS.items() if not optional and k not in cfg.disabled_sources]
    has = long.groupBy("design", "build").agg(F.collect_set("source").alias("has"))
    lost = has.select("design", "build", F.explode(F.array_except(F.array(*[F.lit(k) for k in wanted]), "has")).alias("source"))
    return lost.select("design", "build", F.lit(None).cast("string").alias("source_file"), F.concat("source", F.lit(": no files")).alias("error"))


def accepted(long: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records in canonical units with report date and run id filled in, failures); if strict, without inconsistent files."""
    stale = inconsistent(long)
    failed = long.where("error is not null").select("design", "build", "source_file", "error")
    # a file that broke off while it was streamed counts for nothing
    broken = long.where("error is not null").select("source_file").distinct()
    good = identity.convert_units(long.where("error is null").join(broken, "source_file", "left_anti"))
    failed = failed.unionByName(good.where("unit_error").select("design", "build", "source_file", F.concat(F.lit("unknown unit of "), "metric").alias("error")).distinct()).unionByName(stale)
    if strict:
        good = good.join(stale.select("source_file").distinct(), "source_file", "left_anti")
    good = good.where(~F.col("unit_error")).withColumns({"run_id": F.coalesce("run_id", "meta_run_id"), "report_date": F.coalesce("report_date", "build_date")})
    return good.drop("unit_error", "error", "report_build", "meta_run_id"), failed


def read_map(spark: SparkSession, path: str, cfg: Config | None = None) -> DataFrame:
    """The block map, its names normalized. A block with two partitions or owners, or a repeated row, is an error."""
    cfg = cfg or Config()
    blocks = read_table(spark, path)
    if cfg.identity.get("kind") == "same_hierarchy":
        # one path names a block on both sides, so the map may give either
        for c, other in (("be_hier", "fe_hier"), ("fe_hier", "be_hier")):
            if c not in blocks.columns and other in blocks.columns:
                blocks = blocks.withColumn(c, F.col(other))
    for c in ("fub", "fe_hier", "be_hier"):
        if c not in blocks.columns:
            raise ValueError(f"the block map has no column {c}")
    for c in ("be_share", "partition", "owner", "synth_object", "model_root"):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast("string"))
    torn = blocks.groupBy("fub").agg(*[F.countDistinct(c).alias(c) for c in ("partition", "owner", "fe_hier")], (F.count("*") - F.countDistinct(F.struct("fe_hier", "be_hier"))).alias("again")).where("partition > 1 or owner > 1 or again > 0")
    bad = [r.fub for r in torn.select("fub").limit(5).collect()]
    if bad:
        raise ValueError(f"the block map contradicts or repeats itself for {bad}")
    name = lambda c: identity.normalize_name(F.trim(c), **_names(cfg))
    return blocks.withColumns({"fe_hier": name("fe_hier"), "be_hier": name("be_hier")})


class Work:
    """Tables between steps, written so that a step's plan does not hold the plans of all before it; deleted at the end."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root}/_work"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with step(name):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def close(self) -> None:
        _delete(self.spark, self.root)


def wide_from_long(good: DataFrame, blocks: DataFrame, work: Work, per_instance: bool = True, equal: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(wide, lineage, unmapped, the records that blocks claim)."""
    mapped, unmapped = identity.resolve_objects(good.where(F.col("object_kind") != "window"), blocks, per_instance, equal)
    mapped = work.keep(mapped, "mapped")
    design = ["frequency_ghz", "voltage_v", "ipc", "throughput_gops"]
    values = work.keep(identity.aggregate_metrics(mapped.where(~F.col("metric").isin(*design))), "values")
    wide = work.keep(identity.pivot_wide(values, METRICS), "pivot")
    early = ["fe_logical_mw", "fe_physical_mw", "fe_leakage_mw", "cg_efficiency"]
    wide = identity.share_modules(wide, early) if per_instance else wide
    mode = mapped.where("metric = 'be_mw'").groupBy("design", "build", "fub", "workload", "operating_point").agg(F.min_by("activity_mode", F.struct("source_file", "ordinal")).alias("be_activity_mode"))
    names = blocks.groupBy(F.col("fub").alias("base_")).agg(F.min("partition").alias("partition"), F.min("owner").alias("owner"), F.min("model_root").alias("root_"))
    runs = good.groupBy("design", "build").agg(*[F.max(c).alias(c) for c in ("build_date", "build_status", "design_type", "milestone", "tools")], F.max("run_id").alias("run_id"))
    wide = wide.join(points(good), ["design", "build", "operating_point"], "left").join(runs, ["design", "build"], "left").join(mode, ["design", "build", "fub", "workload", "operating_point"], "left")
    wide = wide.withColumn("base_", F.split("fub", "@")[0]).join(names, "base_", "left")
    instance = F.try_element_at(F.split("fub", "@"), F.lit(2))
    root = F.coalesce("root_", F.concat_ws(".", "design", "partition", "base_"))
    wide = wide.withColumns({"stage": F.lit("FE_BE"), "model_root": F.when(instance.isNotNull(), F.concat_ws("@", root, instance)).otherwise(root), "build_date": F.col("build_date").try_cast("date"), "fmax_ghz": fmax(F.col("clock_period_ps"), F.col("wns_ps")), "tool": F.lit("pipeline"), "imported_at": F.current_timestamp()})
    return work.keep(with_derived(wide.drop("base_", "root_").withColumnRenamed("tools", "tool_version")), "wide"), identity.lineage(mapped, blocks), unmapped, mapped


def _first(metric: str):
    here = (F.col("metric") == metric) & F.col("value").isNotNull()
    return F.min_by("value", F.when(here, F.struct("source_file", "ordinal")))


def points(good: DataFrame) -> DataFrame:
    """Frequency and voltage of each design, build and operating point."""
    rows = good.where(F.col("metric").isin("frequency_ghz", "voltage_v"))
    return rows.groupBy("design", "build", F.col("object").alias("operating_point")).agg(*[_first(m).alias(m) for m in ("frequency_ghz", "voltage_v")])


def performance_from_long(good: DataFrame) -> DataFrame:
    rows = good.where(F.col("metric").isin("ipc", "throughput_gops"))
    out = rows.groupBy("design", "build", "workload", "operating_point").agg(*[_first(m).alias(m) for m in ("ipc", "throughput_gops")])
    return out.join(points(good), ["design", "build", "operating_point"], "left")


def profile_from_long(good: DataFrame) -> DataFrame:
    """Power over time: a row a window, apart from the blocks, as its object is the design."""
    keys = ["design", "build", "workload", "operating_point"]
    at = F.split("object", r"\.\.")
    rows = good.where("object_kind = 'window'").withColumns({"t_start_ns": at[0].cast("double"), "t_end_ns": at[1].cast("double")})
    metrics = ["profile_total_mw", "profile_dynamic_mw", "profile_leakage_mw"]
    return rows.groupBy(*keys, "t_start_ns", "t_end_ns").agg(*[_first(m).alias(m) for m in metrics], *[F.min(c).alias(c) for c in ("source_file", "tool", "tool_version", "run_id")])


def intent_from_runs(spark: SparkSession, root: str, runs: list[dict], blocks: DataFrame, good: DataFrame, cfg: Config) -> DataFrame | None:
    """The power-intent table of the runs that have a file."""
    found = _found(lambda: read_intent(spark, f"{root.rstrip('/')}/*/*", cfg.upf_pattern))
    if found is None:
        return None
    folders = spark.createDataFrame([(m["path"], str(m["design"]), str(m["build"])) for m in runs], "folder string, design string, build string")
    domains = found.where("error is null").withColumn("folder", _run_folder("path", [m["path"] for m in runs])).join(folders, "folder").select("design", "build", "domain", "element", "supply_net", "state", "voltage")
    own = blocks.groupBy("fub").agg(F.min("partition").alias("partition"), F.min("be_hier").alias("be_hier"), F.min("fe_hier").alias("fe_hier"), F.min("model_root").alias("root_"))
    grid = domains.select("design", "build").distinct().crossJoin(own)  # runs x blocks is the table asked for
    grid = grid.withColumn("model_root", F.coalesce("root_", F.concat_ws(".", "design", "partition", "fub"))).drop("root_")
    return identity.intent_table(grid, domains, points(good).select("design", "build", "operating_point", "voltage_v"))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ingest(spark: SparkSession, root: str, map_path: str, out: str, cfg: Config | None = None, only: tuple[str, str] | None = None) -> DataFrame:
    """Reads all runs (or one) and replaces their (design, build) in the stored tables; returns what failed.

    What failed is kept in the folder ``failed`` until the next ingest. Flags and the sanitized view of an earlier state go, as they no longer hold.
    """
    cfg = cfg or Config()
    for key, known in (("replica_policy", REPLICA_POLICIES), ("merge_basis", MERGE_BASES), ("kind", KINDS)):
        if cfg.identity.get(key, known[0]) not in known:
            raise ValueError(f"{key} is one of {', '.join(known)}")
    blocks = read_map(spark, map_path, cfg)
    runs = [m for m in find_runs(spark, root) if only is None or (str(m["design"]), str(m["build"])) == only]
    if not runs:
        raise ValueError(f"no runs under {root}")
    raw = read_long(spark, root if only is None else root, runs, cfg)
    with step("reports"):
        store(raw, f"{out}/reports")
    mine = spark.createDataFrame([(str(m["design"]), str(m["build"])) for m in runs], "design string, build string")
    raw = spark.read.schema(raw.schema).parquet(f"{out}/reports").join(mine, ["design", "build"], "left_semi")
    work = Work(spark, out)
    good, failed = accepted(raw, cfg.strict_consistency)
    good, blocks = work.keep(good, "good"), work.keep(blocks, "blocks")
    wide, lines, unmapped, mapped = wide_from_long(good, blocks, work, cfg.identity.get("replica_policy") == "per_instance", cfg.identity.get("merge_basis") == "equal")
    intent = intent_from_runs(spark, root, runs, blocks, good, cfg)
    if intent is not None:
        intent = work.keep(intent, "intent")
        with step("store power_intent"):
            store(intent, f"{out}/power_intent")
        domain = intent.select("design", "build", F.col("fub").alias("base_"), "power_domain")
        wide = wide.withColumn("base_", F.split("fub", "@")[0]).join(domain, ["design", "build", "base_"], "left").drop("base_")
    clean, rejected = split_rejected(work.keep(quality.validate(wide), "validated"))
    for name, df in (("measurements", clean), ("rejected", rejected), ("measurements_long", mapped), ("lineage", lines), ("unmapped", unmapped), ("performance", performance_from_long(good)), ("power_profile", profile_from_long(good))):
        with step(f"store {name}"):
            store(df, f"{out}/{name}")
    for name in ("quality_flags", "measurements_sanitized", "metric_quality"):
        _delete(spark, f"{out}/{name}")
    failed = failed.unionByName(missing_sources(raw, cfg))
    with step("failed"):
        failed.write.mode("overwrite").parquet(f"{out}/failed")
    failed = spark.read.schema(failed.schema).parquet(f"{out}/failed")
    with step("catalog"):
        record_runs(spark, out, runs, raw, failed)
    work.close()
    return failed


def record_runs(spark: SparkSession, out: str, runs: list[dict], raw: DataFrame, failed: DataFrame) -> None:
    """The catalog's rows of an ingest: builds, their files, and the import itself."""
    root = f"{out}/catalog"
    builds = [(s["design"], s["build"], s["build_date"], s["run_id"], s["status"], json.dumps(m.get("tools") or {}), s["folder"], s["design_type"]) for m in runs for s in [settings(m)]]
    catalog.record(root, "build", spark.createDataFrame(builds, "design string, build string, build_date string, run_id string, status string, tools string, run_dir string, design_type string"))
    files = raw.groupBy("design", "build", "source", F.col("source_file").alias("path")).agg(*[F.min(c).alias(c) for c in ("tool", "tool_version", "run_id", "report_date", "workload", "operating_point")], F.count("metric").alias("n_records"))
    hashes = _found(lambda: spark.read.format("binaryFile").load([m["path"] + "/*" for m in runs] + [m["path"] + "/*/*" for m in runs]).select("path", F.sha2("content", 256).alias("sha256")))
    files = files if hashes is None else files.join(hashes, "path", "left")
    catalog.record(root, "source_file", files)
    counts = raw.groupBy("design", "build").agg(F.countDistinct("source_file").alias("n_reports"), F.count("metric").alias("rows_imported"))
    errors = failed.groupBy("design", "build").agg(F.to_json(F.array_sort(F.collect_set("error"))).alias("errors"), F.count("*").alias("rows_rejected"))
    catalog.record(root, "import_run", counts.join(errors, ["design", "build"], "left").withColumn("dataset", F.lit(f"{out}/measurements")))


def plan_jobs(spark: SparkSession, root: str, map_path: str, parts: str, template: str = "{cmd}") -> list[str]:
    """A command line a run for a scheduler; the engine itself needs none, as one job reads all runs."""
    out = []
    for m in find_runs(spark, root):
        words = ["python", "-m", "wattloom.cli", "ingest", root, map_path, f"{parts.rstrip('/')}/{m['design']}__{m['build']}", "--only", f"{m['design']}/{m['build']}"]
        out.append(template.format(design=m["design"], build=m["build"], cmd=" ".join(map(shlex.quote, words))))
    return out


def merge_partitions(spark: SparkSession, parts: str, out: str) -> list[str]:
    """Puts tables that single-run jobs wrote under parts/*/ into one store; the one writer of it. Returns the tables found."""
    done = []
    for name in TABLES[:8]:
        # several roots of one partitioned table: design and build are read off the files' folders
        try:
            rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{parts.rstrip('/')}/*/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            continue
        folder = lambda key: F.try_url_decode(F.regexp_extract(F.col("_metadata.file_path"), f"/{key}=([^/]*)/", 1))
        store(rows.withColumns({"design": folder("design"), "build": folder("build")}), f"{out}/{name}")
        done.append(name)
    if not done:
        raise ValueError(f"no partitions under {parts}")
    for name in ("quality_flags", "measurements_sanitized", "metric_quality"):
        _delete(spark, f"{out}/{name}")
    return done


def load_table(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """A stored table; none if it has no rows."""
    try:
        return spark.read.parquet(f"{out}/{name}")
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return None


def load_dataset(spark: SparkSession, out: str, raw: bool = False, cfg: Config | None = None) -> DataFrame:
    """The wide table with its features: the sanitized rows where there are some and settings do not say otherwise, else all."""
    cfg = cfg or Config()
    clean = None if raw or not cfg.use_sanitized else load_table(spark, out, "measurements_sanitized")
    rows = clean if clean is not None else load_table(spark, out, "measurements")
    if rows is None:
        raise ValueError(f"no measurements under {out}")
    return with_features(rows)


def run_sanitize(spark: SparkSession, out: str, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags the stored rows, stores flags, usable rows and the trust in each metric; returns (report, counts)."""
    cfg = cfg or Config()
    rows, long, unmapped = load_dataset(spark, out, raw=True, cfg=cfg), load_table(spark, out, "measurements_long"), load_table(spark, out, "unmapped")
    flagged = quality.sanitize(rows, cfg, load_table(spark, out, "lineage"), load_table(spark, out, "power_intent"))
    store(flagged.select("design", "build", "fub", "workload", "operating_point", "quality_flags", "usable"), f"{out}/quality_flags")
    store(flagged.where("usable").drop("usable"), f"{out}/measurements_sanitized")
    trust = quality.metric_quality(rows, long=long)
    trust.write.mode("overwrite").parquet(f"{out}/metric_quality")
    report, counts = quality.quality_report(flagged), quality.flag_counts(flagged)
    if long is not None:
        counts = counts.unionByName(quality.source_counts(long, unmapped))
    as_map = counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("flag", "n"))))).alias("counts"))
    trust_json = spark.read.parquet(f"{out}/metric_quality").agg(F.to_json(F.array_sort(F.collect_list(F.struct("metric", "verdict", "coverage_pct")))).alias("metric_quality"))
    catalog.record(f"{out}/catalog", "quality_run", report.crossJoin(as_map).crossJoin(trust_json))  # one row each
    return report, counts
