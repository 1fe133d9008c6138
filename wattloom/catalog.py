"""The catalog: eight small metadata tables as Parquet folders, written by key and read by SQL.

A keyed table is partitioned by its key's first columns where those are design and build, so that replacing a build
rewrites that build's folder only; the others are appended to and read by their newest row a key.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: columns of each table; JSON where a value is a list or a map.
TABLES = {
    "build": "design string, build string, build_date string, run_id string, status string, tools string, run_dir string, design_type string",
    "source_file": "design string, build string, source string, path string, sha256 string, tool string, tool_version string, run_id string, report_date string, workload string, operating_point string, n_records long",
    "import_run": "source_file string, sha256 string, rows_imported long, rows_rejected long, dataset string, design string, build string, n_reports long, errors string",
    "quality_run": "n_rows long, n_usable long, usable_pct double, counts string, metric_quality string",
    "model": "model_file string, best_model string, best_mape double, baseline_mape double, test_builds string, dataset_sha256 string, metrics string",
    "budget_status": "design string, scope string, workload string, operating_point string, build string, milestone string, target double, actual double, unit string, tolerance_pct double, margin_pct double, status string, metric string",
    "anomaly": "design string, build string, model_root string, partition string, owner string, rule string, severity string, value double, threshold double, status string, evidence string, technique string",
    "profile_run": "command string, total_wall_s double, peak_rss_mb double, python string, stages string",
}
#: Tables whose rows of a design and build are replaced, and the key of which only the newest row counts.
REPLACED = ("build", "source_file", "anomaly")
NEWEST = {"model": ["model_file"]}


def record(root: str, table: str, rows: DataFrame) -> None:
    """Adds rows to a table, with the time; rows of the same design and build, or of the same key, go out of sight."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ \w+)", TABLES[table])]
    kinds = dict(c.split() for c in re.split(r", (?=\w+ \w+)", TABLES[table]))
    out = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names], F.current_timestamp().alias("recorded_at"))
    if table in REPLACED:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("design", "build").parquet(f"{root}/{table}")
    else:
        out.write.mode("append").parquet(f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table as it stands; without rows if nothing was recorded."""
    schema = TABLES[table] + ", recorded_at timestamp"
    try:
        rows = spark.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if table in NEWEST:
        last = Window.partitionBy(*NEWEST[table]).orderBy(F.col("recorded_at").desc())
        rows = rows.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_")
    return rows


def query(spark: SparkSession, root: str, text: str) -> DataFrame:
    """A SELECT over the tables of the catalog."""
    from wattloom.sources.tables import run_sql

    return run_sql(spark, text, **{t: read(spark, root, t) for t in TABLES})


def import_history(spark: SparkSession, root: str) -> DataFrame:
    """Imports in order of time, their errors as arrays."""
    return read(spark, root, "import_run").withColumn("errors", F.coalesce(F.from_json("errors", "array<string>"), F.array().cast("array<string>"))).orderBy("recorded_at")


def profiles(spark: SparkSession, root: str, last: int = 5) -> DataFrame:
    """The last profiled runs, their stages decoded."""
    stages = "array<struct<name: string, wall_s: double, cpu_s: double, max_rss_mb: double, rows: long, jobs: long, tasks: long, task_s: double, task_cpu_s: double, shuffle_mb: double, spill_mb: double>>"
    return read(spark, root, "profile_run").orderBy(F.col("recorded_at").desc()).limit(last).withColumn("stages", F.from_json("stages", stages))
