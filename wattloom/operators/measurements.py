"""Single measurements out of the long table, with their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Fixed: the stage that each source reports on.
STAGES = {"estimate": "FE", "signoff": "BE", "groups": "BE", "profile": "BE", "timing": "BE", "parasitics": "BE", "implementation": "BE", "activity": "ACTIVITY", "performance": "PERF", "second_engine": "BE", "metadata": "META"}
KEY = ["design", "build", "fub", "stage", "metric", "workload", "operating_point"]


class MeasurementStore:
    """Queries over long records; ``lineage`` gives blocks their model root."""

    def __init__(self, long: DataFrame, lineage: DataFrame | None = None):
        if "stage" not in long.columns:
            stage = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
            long = long.withColumn("stage", F.coalesce(F.try_element_at(stage, F.col("source")), F.lit("OTHER")))
        if "model_root" not in long.columns and lineage is not None:
            roots = lineage.groupBy("design", "build", "fub").agg(F.min("model_root").alias("model_root"))
            long = long.join(roots, ["design", "build", "fub"], "left")
        if "model_root" not in long.columns:
            long = long.withColumn("model_root", F.col("fub"))
        if "hierarchy" not in long.columns and "object" in long.columns:
            long = long.withColumn("hierarchy", F.col("object"))
        self.rows = long

    def select(self, **equal: str | None) -> DataFrame:
        out = self.rows
        for column, value in equal.items():
            if value is not None and column in out.columns:
                out = out.where(F.col(column).cast("string") == str(value))
        return out

    def get(self, **equal: str | None) -> Row:
        """The one measurement that matches: KeyError if none does, ValueError if several differ in their key."""
        found = self.select(**equal)
        keys = found.select(*KEY).distinct().limit(2).collect()
        if not keys:
            raise KeyError(f"no measurement matches {equal}")
        if len(keys) > 1:
            raise ValueError(f"several measurements match {equal}; add workload, operating_point or build")
        return found.orderBy(*[c for c in ("source_file", "ordinal") if c in found.columns] or ["value"]).first()

    def get_value(self, default: float | None = None, **equal: str | None) -> float | None:
        try:
            return self.get(**equal)["value"]
        except KeyError:
            return default

    def find(self, **equal: str | None) -> DataFrame:
        return self.select(**equal)

    def metrics(self, stage: str | None = None) -> list[str]:
        return sorted(r.metric for r in self.select(stage=stage).select("metric").distinct().collect())  # a row a metric

    def fubs(self, design: str | None = None, build: str | None = None) -> list[str]:
        return sorted(r.fub for r in self.select(design=design, build=build).where("fub <> '*'").select("fub").distinct().collect())  # a row a block

    def pivot(self, metrics: list[str], index: tuple[str, ...] = ("design", "build", "fub", "workload", "operating_point")) -> DataFrame:
        """Wide rows over ``index`` (a missing workload or operating point is ``default``), the first value of each metric."""
        rows = self.rows.withColumns({c: F.coalesce(c, F.lit("default")) for c in ("workload", "operating_point") if c in index})
        order = F.struct(*[c for c in ("source_file", "ordinal") if c in rows.columns], "value")
        first = lambda m: F.min_by("value", F.when((F.col("metric") == m) & F.col("value").isNotNull(), order))
        return rows.groupBy(*index).agg(*[first(m).alias(m) for m in metrics])
