"""A scorecard of every build: power by partition, its change since the build before, data quality and anomalies, and a grade.

What a lead looks at when a build is done: does a partition's power at the reference corner rise, do its rows hold up to the
checks of data quality, did a rule find something. The engine's operators do the work: derived metrics, sanitizing, anomaly rules.

    python -m jobs.build_scorecard --config jobs/build_scorecard.json [--input DIR] [--output DIR]

``input`` holds the relational tables, or a folder ``measurements`` of wide rows, which is taken then. Written, each partitioned
by design and build: ``flags`` (a row a measurement: its flags and whether it is usable), ``findings`` (of all rules) and
``scorecard``. A run replaces the partitions of the builds that it read, so a rerun changes nothing and builds of
earlier runs that are no longer in the input stay.

Defined results: a partition without rows at the reference corner has no power and no change; the first build has no change;
a null partition is one of its own; equal keys count as often as they occur; an empty input writes nothing.

Grades: ``red`` for a finding of high severity or a rise over ``rise_pct``; else ``amber`` for another finding or fewer than
``usable_pct`` of rows usable; else ``green``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import log, main
from wattloom.functions.expr import ratio
from wattloom.operators import anomalies, quality
from wattloom.operators.derive import with_derived, with_features
from wattloom.plans.fixture import table
from wattloom.sources.tables import store

KEY = ["design", "build", "partition"]
SCORES = "partition string, n_rows long, n_usable long, n_blocks long, power_mw double, dynamic_mw double, previous_mw double, change_pct double, high long, medium long, grade string, design string, build string"


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df's builds under path and returns what it wrote, so that no later step computes it again."""
    store(df, path)
    builds = df.select("design", "build").distinct()
    # names that look like numbers or dates stay text: the schema says so
    return df.sparkSession.read.schema(df.schema).parquet(path).join(builds, ["design", "build"], "left_semi")


def measured(spark: SparkSession, folder: str, output: str) -> DataFrame:
    """The wide rows under a folder: stored ones if there are, else the relational tables', written under output first: every step reads them."""
    try:
        rows = spark.read.parquet(f"{folder}/measurements")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = table(spark, folder, "wide")
        rows.write.mode("overwrite").parquet(f"{output}/_measured")
        rows = spark.read.schema(rows.schema).parquet(f"{output}/_measured")
    return with_features(with_derived(rows))


def power(rows: DataFrame) -> DataFrame:
    """Per design, build and partition: blocks, power and dynamic power at the design's reference corner, and the build before's."""
    ctx = anomalies.context(rows)
    at = (F.col("workload") == F.col("ref_workload")) & (F.col("operating_point") == F.col("ref_op"))
    exact = lambda c: F.sum(F.when(at, F.col(c)).cast("decimal(28,9)")).cast("double")
    sums = ctx.groupBy(*KEY, "build_rank").agg(F.countDistinct(F.when(at, F.col("fub"))).alias("n_blocks"), exact("be_mw").alias("power_mw"), exact("be_dynamic_mw").alias("dynamic_mw"))
    before = Window.partitionBy("design", "partition").orderBy("build_rank")  # a row a build
    last = F.when(F.lag("build_rank").over(before) == F.col("build_rank") - 1, F.lag("power_mw").over(before))
    return sums.withColumn("previous_mw", last).withColumn("change_pct", ratio(F.col("power_mw") - F.col("previous_mw"), F.col("previous_mw")) * 100).drop("build_rank")


def scored(flags: DataFrame, found: DataFrame, powers: DataFrame, rise_pct: float, usable_pct: float) -> DataFrame:
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in KEY]
    checked = flags.groupBy(*KEY).agg(F.count("*").alias("n_rows"), F.count_if("usable").alias("n_usable"))
    counts = found.groupBy(*KEY).agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    out = powers.join(checked, same(powers, checked)).drop(*[checked[c] for c in KEY])
    out = out.join(counts, same(powers, counts), "left").drop(*[counts[c] for c in KEY]).fillna(0, ["high", "medium"])
    red = (F.col("high") > 0) | F.coalesce(F.col("change_pct") > rise_pct, F.lit(False))
    amber = (F.col("medium") > 0) | (F.col("n_usable") * 100 < F.col("n_rows") * usable_pct)
    return out.withColumn("grade", F.when(red, "red").when(amber, "amber").otherwise("green")).select(*[c.split()[0] for c in SCORES.split(", ")])


def run(spark: SparkSession, input: str, output: str, rise_pct: float = 10.0, usable_pct: float = 50.0) -> DataFrame:
    """Writes flags, findings and scorecard of all builds under ``input``; returns the scorecard as it stands."""
    rows = measured(spark, input, output)
    log.info("reads %s", input)
    key = ["design", "build", "partition", "fub", "workload", "operating_point"]
    flags = _stored(quality.sanitize(rows).select(*key, "quality_flags", "usable"), f"{output}/flags")
    found = _stored(anomalies.findings(rows), f"{output}/findings")
    store(scored(flags, found, power(rows), rise_pct, usable_pct), f"{output}/scorecard")
    cards = spark.read.schema(SCORES).parquet(f"{output}/scorecard")
    n = flags.agg(F.count("*").alias("rows"), F.count_if("usable").alias("usable")).first()
    grades = {r.grade: r["count"] for r in cards.groupBy("grade").count().collect()}  # a row a grade
    log.info("wrote %s: %d rows, %d of them usable; partitions of builds by grade: %s", output, n.rows, n.usable, grades)
    return cards


if __name__ == "__main__":
    main("build scorecard", str(Path(__file__).with_suffix(".json")), lambda spark, c: run(spark, c["input"], c["output"], c["rise_pct"], c["usable_pct"]), ["input", "output"])
