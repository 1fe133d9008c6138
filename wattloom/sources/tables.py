"""Flat tables, stored tables with keyed replacement, and SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMERIC = re.compile(r"_(mw|pf|ps|v|ghz|um|pct)$|^(area|activity|cell_count|fanout|bits_per_cycle|cg_efficiency|net_count)$")


def read_table(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """CSV or Parquet; names trimmed, lower case, blanks as underscores; numbers parsed softly, or left as text if not ``typed``."""
    if re.search(r"\.(parquet|pq)/?$", path):
        df = spark.read.parquet(path)
    elif path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"neither CSV nor Parquet: {path}")
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    soft = {c: F.col(c).try_cast("double") for c, t in df.dtypes if typed and t == "string" and NUMERIC.search(c)}
    trimmed = {c: F.trim(c) for c, t in df.dtypes if t == "string" and c not in soft}
    return df.withColumns(soft | trimmed)


def keyed_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new: what ingesting a run again does."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def append_last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, of each key the last: new before old, then the later ordinal."""
    both = old.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.col("age_").desc(), F.col("ordinal").desc())
    return both.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_", "age_")


def store(df: DataFrame, path: str, keys: tuple[str, ...] = ("design", "build")) -> None:
    """Replaces the partitions that df has and leaves the others; writing it twice changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    """A flat table as Parquet, or as CSV where the path says so."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def import_file(spark: SparkSession, path: str, out: str, append: bool = False) -> tuple[int, int]:
    """A flat file into stored tables: validated, derived, split into clean and rejected rows; returns their numbers.

    An append adds rows without looking for repeated keys; those that repeat within the file are rejected.
    """
    from wattloom.operators.derive import with_derived
    from wattloom.operators.quality import NUMERIC as METRICS
    from wattloom.operators.quality import REQUIRED, validate

    rows = validate(read_table(spark, path, typed=False))
    absent = [c for c in REQUIRED if c not in rows.columns]
    if absent:
        raise ValueError(f"required columns are missing: {', '.join(absent)}")
    for c in METRICS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    for c in ("workload", "operating_point", "partition", "owner", "model_root"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit({"workload": "default", "operating_point": "default"}.get(c)).cast("string"))
    rows = rows.withColumn("model_root", F.coalesce("model_root", "fub"))
    clean, rejected = split_rejected(with_derived(rows).withColumns({"source_file": F.lit(path), "imported_at": F.current_timestamp()}))
    if append:
        clean.write.mode("append").partitionBy("design", "build").parquet(f"{out}/measurements")
    else:
        store(clean, f"{out}/measurements")
    rejected.write.mode("append" if append else "overwrite").parquet(f"{out}/rejected_rows")
    return clean.count(), rejected.count()


def split_rejected(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and rejected ones with their reasons."""
    bad = F.size("errors") > 0
    return validated.where(~bad).drop("errors", "warnings", "reject_reason"), validated.where(bad)


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A SELECT over named tables; nothing else is let through."""
    if not re.match(r"(?is)^\s*(select|with)\b", text):
        raise ValueError("only SELECT is allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
