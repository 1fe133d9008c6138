"""Run folders made by rule, with the truth that they were made from and the defects that were planted.

Every value is a function of a seed and its keys, so a tree of any size is made in parallel, a part of it can be made again, and
two trees of one seed are equal. Spark makes the truth, then the text of each report from the truth's rows; tasks write
the files, each under its own name, through Arrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import importable

#: Workloads with their activity, and operating points with volts and GHz.
WORKLOADS, POINTS = {"compute": 0.3, "idle": 0.03, "typical": 0.15}, {"nom": (0.75, 1.0), "turbo": (0.85, 1.25)}
PARTITIONS, CYCLES, NETS = 3, 20_000, 4
RUN, CORNER = ["design", "build"], ["workload", "operating_point"]


def _u(seed: int, name: str, *keys: str) -> Column:
    """A number in [0, 1) from the seed, a name and these keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1_000_003)) / 1_000_003.0


def truth(spark: SparkSession, designs: int, builds: int, blocks: int, seed: int = 42) -> DataFrame:
    """A row a design, build, block, workload and operating point, with what its reports should say."""
    runs = spark.range(designs * builds).select(F.concat(F.lit("chip"), F.floor(F.col("id") / builds).cast("string")).alias("design"), (F.col("id") % builds + 1).alias("n"))
    runs = runs.withColumn("build", F.concat(F.lit("B"), F.col("n").cast("string")))
    rows = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    corners = F.array(*[F.struct(F.lit(w).alias("workload"), F.lit(a).alias("base"), F.lit(p).alias("operating_point"), F.lit(v).alias("voltage_v"), F.lit(f).alias("frequency_ghz")) for w, a in WORKLOADS.items() for p, (v, f) in POINTS.items()])
    rows = rows.select("*", F.inline(corners)).withColumns({"fub": F.concat(F.lit("F"), F.col("block").cast("string")), "partition": F.concat(F.lit("P"), (F.col("block") % PARTITIONS).cast("string"))})
    size = (500 + 1500 * _u(seed, "area", "design", "block")) * (1 + 0.01 * _u(seed, "drift", "design", "block", "n") * F.col("n"))
    # what is counted is a whole number in every report
    rows = rows.withColumns({"area": F.round(size, 2), "toggles": F.round(F.col("base") * (0.8 + 0.4 * _u(seed, "activity", "design", "block", "workload")) * NETS * CYCLES)})
    rows = rows.withColumns({"activity": F.col("toggles") / NETS / CYCLES, "bits_per_cycle": F.col("toggles") / CYCLES, "wire_cap_pf": F.col("area") * (0.02 + 0.02 * _u(seed, "wire", "design", "block")), "cell_cap_pf": F.col("area") * 0.05, "cell_count": F.floor(F.col("area") / 2).cast("double"), "fanout": 2 + 2 * _u(seed, "fanout", "design", "block")})
    v, f = F.col("voltage_v"), F.col("frequency_ghz")
    rows = rows.withColumns({"dynamic": F.col("activity") * (F.col("wire_cap_pf") + F.col("cell_cap_pf")) * v * v * f, "be_leakage_mw": F.col("area") * 0.002 * v * v * v})
    rows = rows.withColumn("be_mw", F.col("dynamic") + F.col("be_leakage_mw"))
    early = lambda name, low, width: F.col("be_mw") * (low + width * _u(seed, name, "design", "n", "block", *CORNER))
    period = 1000 / f
    return rows.withColumns(
        {"fe_physical_mw": early("physical", 0.92, 0.1), "fe_logical_mw": early("logical", 0.8, 0.25), "fe_leakage_mw": F.col("be_leakage_mw") * 0.95, "be_clock_mw": F.col("dynamic") * 0.25, "be_register_mw": F.col("dynamic") * 0.3, "be_comb_mw": F.col("dynamic") * 0.45 + F.col("be_leakage_mw"), "clock_period_ps": period, "wns_ps": F.round(period * (0.1 - 0.15 * _u(seed, "slack", "design", "n", "partition", "operating_point")), 1), "cg_efficiency": F.round(0.5 + 0.4 * _u(seed, "gating", "design", "block"), 3)}
    ).drop("base", "toggles")


def defects(rows: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """(design, build, block, kind): what is planted, in a share of blocks, or of runs where block is null."""
    def one_of(kinds: list[str], *keys: str) -> Column:
        at, out = _u(seed, "defect", *keys), F.lit(None).cast("string")
        for i, k in reversed(list(enumerate(kinds, 1))):
            out = F.when(at < share * i / len(kinds), k).otherwise(out)
        return out

    blocks = rows.select(*RUN, "n", "block").distinct()
    runs = rows.select(*RUN, "n").distinct()
    kind, of_run = one_of(["zero_power", "negative_area"], "design", "n", "block"), one_of(["superseded", "watts", "no_parasitics"], "design", "n")
    out = blocks.select(*RUN, "block", kind.alias("kind")).unionByName(runs.select(*RUN, F.lit(None).cast("int").alias("block"), of_run.alias("kind")))
    return out.where("kind is not null")


def _file(rows: DataFrame, keys: list[str], path: Column, head: Column, line: Column) -> DataFrame:
    """(path, text) of a report a key: its head and a line a row, in order of blocks."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("block").alias("block"), line.alias("line"))))
    held = rows.groupBy(*keys).agg(lines.alias("lines"))
    return held.select(F.concat_ws("/", "design", "build", path).alias("path"), F.concat(head, F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def reports(rows: DataFrame, planted: DataFrame) -> DataFrame:
    """(path, text) of all files of the runs."""
    of_block = planted.where("block is not null").select(*RUN, "block", F.col("kind").alias("own"))
    of_run = planted.where("block is null").select(*RUN, F.col("kind").alias("all"))
    rows = rows.join(of_block, [*RUN, "block"], "left").join(of_run, RUN, "left")
    is_ = lambda c, kind: F.coalesce(F.col(c) == kind, F.lit(False))
    rows = rows.withColumns({"be_mw": F.when(is_("own", "zero_power"), 0.0).otherwise(F.col("be_mw")), "area": F.when(is_("own", "negative_area"), -F.col("area")).otherwise(F.col("area"))})
    name, said = F.lower("fub"), F.format_string
    corner = F.concat_ws("_", *CORNER)
    top = F.concat(F.lit("Tool: synthetic  Version: 1\nRun: "), "design", F.lit("_"), "build", F.lit("\nBuild: "), "build", F.lit("\n"))
    under = lambda *lines: F.concat(top, F.lit("\n".join(lines)))
    at, each = [*RUN, *CORNER], [*RUN, "all"]
    once = rows.where((F.col("workload") == "typical") & (F.col("operating_point") == "nom"))
    unit, scale = F.when(is_("all", "watts"), "W").otherwise("mW"), F.when(is_("all", "watts"), 1000.0).otherwise(1.0)
    path = lambda folder, file: F.concat(F.lit(f"{folder}/"), corner, F.lit(f"/{file}"))
    points = rows.where("block = 0 and workload = 'typical'").groupBy(*each).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("operating_point", F.struct("voltage_v", "frequency_ghz"))))).alias("operating_points"), F.min("n").alias("n"))
    status = F.when(is_("all", "superseded"), "superseded").otherwise("current")
    flow = F.struct(F.lit(1000.0).alias("sim_clock_period_ps"), F.lit("be").alias("hierarchy"))
    about = F.struct("design", "build", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") * 7).cast("int")).cast("string").alias("build_date"), F.concat_ws("_", *RUN).alias("run_id"), status.alias("status"), flow.alias("activity_flow"), "operating_points")
    files = points.select(F.concat_ws("/", *RUN, F.lit("metadata.json")).alias("path"), F.to_json(about).alias("text"))
    for mode, short in (("rtl", "logical"), ("physical", "physical")):
        line = said("fe/%s 0 0 %.6f %.6f %.3f", name, F.col("fe_leakage_mw"), F.col(f"fe_{short}_mw"), F.col("cg_efficiency"))
        files = files.unionByName(_file(rows, at, path("pprtl", f"{short}_power.rpt"), under(f"Mode: {mode}", "Power units: mW", "Hierarchy Internal Switching Leakage Total CG"), line))
    tree = F.concat(top, F.lit("Power units: "), unit, F.lit("\nHierarchy Int Switch Leak Total %\nchip 0 0 0 0 100"))
    files = files.unionByName(_file(rows, [*at, "all"], path("primepower", "power_hier.rpt"), tree, said("  %s 0 0 %.9f %.9f 1", name, F.col("be_leakage_mw") / scale, F.col("be_mw") / scale)))
    files = files.unionByName(_file(rows, at, path("primepower", "power_groups.rpt"), under("Power units: mW", "Hierarchy clock_network register combinational Total"), said("%s %.6f %.6f %.6f %.6f", name, *[F.col(f"be_{c}") for c in ("clock_mw", "register_mw", "comb_mw", "mw")])))
    stages = rows.where("workload = 'typical'").dropDuplicates([*RUN, "operating_point", "partition"])
    files = files.unionByName(_file(stages, [*RUN, "operating_point"], F.concat(F.lit("primetime/"), "operating_point", F.lit("/timing_summary.rpt")), under("Time units: ps", "Partition Clock Period WNS TNS Violating"), said("%s clk %.3f %.1f 0 0", F.col("partition"), F.col("clock_period_ps"), F.col("wns_ps"))))
    files = files.unionByName(_file(once.where(~is_("all", "no_parasitics")), RUN, F.lit("starrc/parasitics_summary.rpt"), under("Cap units: pF", "Instance Nets Res WireCap PinCap"), said("%s 1 1 %.6f %.6f", name, F.col("wire_cap_pf"), F.col("cell_cap_pf"))))
    files = files.unionByName(_file(once, RUN, F.lit("implementation/qor_summary.rpt"), under("Area units: um2", "Hierarchy CellArea CellCount AvgFanout Utilization"), said("%s %.2f %.0f %.6f 0.7", name, F.col("area"), F.col("cell_count"), F.col("fanout"))))
    nets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(NETS)), lambda i: F.concat(F.lit("(n"), i.cast("string"), F.lit(" (TC "), F.when(i == 1, F.round(F.col("bits_per_cycle") * CYCLES)).otherwise(0).cast("long").cast("string"), F.lit("))"))), " ")
    quiet = rows.where("operating_point = 'nom'")
    saif = _file(quiet, [*RUN, "workload"], F.concat(F.lit("activity/"), "workload", F.lit(".saif")), F.lit(f"(SAIFILE (TIMESCALE 1 ns) (DURATION {CYCLES})\n(INSTANCE chip"), F.concat(F.lit("(INSTANCE "), name, F.lit("\n(NET "), nets, F.lit("))")))
    return files.unionByName(saif.withColumn("text", F.concat("text", F.lit("))\n"))))


def write_files(files: DataFrame, root: str) -> int:
    """Writes each text under root by its path; returns how many. A file that is written again is replaced."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                store.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{base}/{path}") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def generate(spark: SparkSession, out: str, designs: int = 2, builds: int = 3, blocks: int = 10, dirty: float = 0.0, seed: int = 42) -> int:
    """Writes ``out``: runs/ (design/build folders), map.csv, truth and defects (Parquet); returns the number of report files."""
    importable(spark)
    out = out.rstrip("/")
    truth(spark, designs, builds, blocks, seed).write.mode("overwrite").parquet(f"{out}/truth")
    rows = spark.read.parquet(f"{out}/truth")
    defects(rows, dirty, seed).write.mode("overwrite").parquet(f"{out}/defects")
    blocks_ = rows.select("fub", "partition").distinct().select("fub", F.concat(F.lit("fe/"), F.lower("fub")).alias("fe_hier"), F.lower("fub").alias("be_hier"), "partition", F.concat(F.lit("owner_"), "partition").alias("owner"))
    blocks_.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/map.csv")  # a row a block
    return write_files(reports(rows, spark.read.parquet(f"{out}/defects")), f"{out}/runs")
