"""Slices of the wide table: builds in natural order, latest builds, default corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.expr import natural_key


def build_ranks(df: DataFrame, per: list[str] | None = None) -> DataFrame:
    """(per, build, build_rank) from 1, in natural order; a row a build."""
    per = ["design"] if per is None else per
    builds = df.select(*per, "build").distinct()
    return builds.withColumn("build_rank", F.row_number().over(Window.partitionBy(*per).orderBy(natural_key(F.col("build")), "build")))


def latest_builds(df: DataFrame) -> DataFrame:
    """(design, build) of each design's latest build."""
    key = F.struct(natural_key(F.col("build")).alias("k"), F.col("build").alias("build"))
    return df.groupBy("design").agg(F.max(key)["build"].alias("build"))


def with_rank(df: DataFrame) -> DataFrame:
    return df.join(build_ranks(df), ["design", "build"])


def default_corner(df: DataFrame, column: str, preferred: str) -> DataFrame:
    """One row: the preferred value if any row has it, else the first in string order."""
    return df.agg(F.coalesce(F.max(F.when(F.col(column) == preferred, F.col(column))), F.min(column)).alias(column))


def select_slice(df: DataFrame, *, latest: bool = True, workload: str | None = "typical", operating_point: str | None = "nom", **equal: str) -> DataFrame:
    """Rows equal to ``equal``, of the latest builds, at the default corner (chosen over all designs)."""
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    if latest and "build" not in equal:
        df = df.join(latest_builds(df), ["design", "build"], "left_semi")
    for column, preferred in (("workload", workload), ("operating_point", operating_point)):
        if preferred is not None and column not in equal:
            df = df.join(F.broadcast(default_corner(df, column, preferred)), column, "left_semi")
    return df
