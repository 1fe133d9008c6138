"""Command line: ingest run folders, and run analyses over the stored tables or the given ones.

Examples::

    python -m wattloom.cli ingest runs/ mapping/fub_map.csv store/
    python -m wattloom.cli sanitize store/
    python -m wattloom.cli analyze deltas store/ --design chip
    python -m wattloom.cli explore sweep store/ --design chip --feature frequency_ghz --values 0.8,1.0,1.2
    python -m wattloom.cli query error_by_design_physical /root/testdata/sf0.001
    python -m wattloom.cli sql store/ "select design, count(*) from measurements group by design"

A command exits with 1 on a user's error, and with --strict where it finds what it warns of.
"""

from __future__ import annotations

import argparse
import json
import platform
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.config import PRESETS, Config, read_budgets, read_identity, read_scenarios
from wattloom.profiling import profiled, stage_totals, stages_of, step


def session() -> SparkSession:
    return SparkSession.builder.appName("wattloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


#: Analyses of stored rows by name: what ``analyze`` shows.
ANALYSES: dict[str, Callable] = {}


def analysis(f):
    ANALYSES[f.__name__] = f
    return f


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("wattloom")
    p.add_argument("--config", help="settings as TOML")
    p.add_argument("--profile", help="a store whose catalog records what the command cost")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str, **flags):
        c = commands.add_parser(name, help=text)
        for a in arguments:
            c.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        for a, kind in flags.items():
            name = "--" + a.replace("_", "-")
            c.add_argument(name, action="store_true") if kind is bool else c.add_argument(name, type=kind)
        return c

    command("ingest", "read run folders into stored tables", "root", "map", "out", strict=bool, only=str)
    command("generate", "run folders made by rule, with their truth", "out", designs=int, builds=int, blocks=int, dirty=float, seed=int)
    command("plan", "a command a run, for a scheduler", "root", "map", "parts", template=str)
    command("merge", "put single-run tables into one store", "parts", "out")
    command("sources", "list report formats")
    command("queries", "list named queries")
    command("query", "run a named query over a folder of tables", "name", "dir")
    command("validate", "check a flat file", "path", strict=bool)
    command("import", "a flat file into stored tables", "path", "out", append=bool)
    command("sanitize", "flags of stored measurements", "store")
    command("anomalies", "findings over stored measurements", "store", strict=bool)
    c = command("analyze", "an analysis of stored measurements", "what", "store", design=str, csv=str)
    c.epilog = ", ".join(ANALYSES)
    command("train", "fit and score models, write their metadata", "store", "out", cv=bool)
    command("predict", "power if features change", "store", design=str, fub=str, build=str, workload=str, operating_point=str, set=str, scale=str, model=str, csv=str)
    command("export", "compact models as JSON, a file a design", "store", "out", model=str)
    command("trace", "a workload trace (CSV) over exported models", "models", "csv", out=str)
    command("explore", "a sweep, the operating points, or a file of scenarios", "what", "store", design=str, workload=str, feature=str, values=str, file=str, scale=bool)
    command("budget", "targets and their status", "store", "file?", strict=bool)
    command("converge", "gaps, trends and what closes them", "store", "file?", strict=bool)
    command("techniques", "what saves power, and where", "store", design=str)
    command("qualify", "a second engine against signoff", "store", strict=bool)
    command("lineage", "blocks and what reports say of them", "store", design=str, fub=str)
    command("measure", "one measurement: column=value ...", "store").add_argument("equal", nargs="+")
    command("report", "a Markdown report", "store", "out", budgets=str)
    command("tables", "rows of stored and catalog tables", "store")
    command("catalog", "a SELECT over the catalog", "store", "text")
    command("sql", "a SELECT over the stored tables", "store", "text")
    command("init", "write settings with their defaults", "path", preset=str)
    command("identity", "show an identity preset, by name or of a file", "path")
    command("presets", "list identity presets")
    command("costs", "the last profiled commands, and their stages summed", "store", last=int)
    command("doctor", "versions of what the engine runs on")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "init":
            Path(a.path).write_text((Config(identity=read_identity(a.preset)) if a.preset else Config()).to_toml())
            return 0
        cfg = Config.read(a.config) if a.config else Config()
        if a.command == "presets":
            print("\n".join(f"{k}: {text}" for k, (text, _) in PRESETS.items()))
            return 0
        if not a.profile:
            return run(session(), a, cfg)
        spark = session()
        with profiled(spark, a.command, f"{a.profile}/catalog"):
            if a.command == "ingest":  # names its own steps
                return run(spark, a, cfg)
            with step(a.command):
                return run(spark, a, cfg)
    except (ValueError, KeyError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1


def stored(spark: SparkSession, folder: str) -> dict:
    """The stored tables that hold rows; a partitioned table without any has no schema to read."""
    from wattloom.ingest import TABLES, load_table

    found = {name: load_table(spark, folder, name) for name in TABLES}
    return {k: v for k, v in found.items() if v is not None}


def show(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=False)


@analysis
def summary(rows, _):
    from wattloom.operators import stats

    return stats.summarize(rows)


@analysis
def correlation(rows, _):
    from wattloom.operators import quality, stats

    return stats.with_p(stats.associations(rows, "be_mw", [c for c in ["fe_logical_mw", "fe_physical_mw", *quality.FEATURES, "wire_cap_fraction"] if c in rows.columns]))


@analysis
def errors(rows, _):
    from wattloom.operators import stats

    return stats.stage_metrics(rows, "physical", ["design", "build"])


@analysis
def energy(rows, _):
    from wattloom.operators import models

    return models.decomposition_totals(models.decompose(rows, models.fit(rows, "datamove")))


@analysis
def deltas(rows, _):
    from wattloom.operators import builds
    from wattloom.operators.select import select_slice

    return builds.build_deltas(select_slice(rows, latest=False))


@analysis
def hotspots(rows, _):
    from wattloom.operators import builds
    from wattloom.operators.select import select_slice

    return builds.hotspots(select_slice(rows, latest=False)).select("design", "build", "model_root", "be_mw", "share_pct", "density", "delta_pct", "hotspot", "regressed", "low_cg")


@analysis
def frontier(rows, tables):
    from wattloom.operators import builds
    from wattloom.operators.select import select_slice

    return builds.frontier(select_slice(rows, latest=False), tables.get("performance"))


@analysis
def findings(rows, _):
    from wattloom.operators import anomalies

    return anomalies.report(rows).orderBy("design", "place")


@analysis
def workloads(rows, tables):
    from wattloom.operators import workload

    power = workload.design_power(rows)
    return workload.energy_per_op(power, tables["performance"]) if "performance" in tables else power


@analysis
def profile(rows, tables):
    if "power_profile" not in tables:
        raise ValueError("no power profile is stored")
    return tables["power_profile"].groupBy("design", "build", "workload", "operating_point").agg(F.count("*").alias("windows"), F.avg("profile_total_mw").alias("mean_mw"), F.max("profile_total_mw").alias("peak_mw"))


@analysis
def intent(rows, tables):
    from wattloom.operators import identity

    if "power_intent" not in tables:
        raise ValueError("no power intent is stored")
    return identity.intent_summary(tables["power_intent"])


def overrides(text: str | None, scale: bool) -> dict:
    from wattloom.operators.models import parse_override

    return dict(parse_override(x, scale) for x in (text or "").split(",") if x)


def run(spark: SparkSession, a: argparse.Namespace, cfg: Config) -> int:
    from wattloom import catalog, ingest, queries, report
    from wattloom.operators import anomalies, closure, explore, models, quality, stats
    from wattloom.operators.measurements import MeasurementStore
    from wattloom.operators.select import latest_builds, select_slice
    from wattloom.sources.reports import source_table
    from wattloom.sources.generate import generate
    from wattloom.sources.tables import import_file, read_table, run_sql, write_table

    data = lambda raw=False: ingest.load_dataset(spark, a.store, raw, cfg)
    if a.command == "ingest":
        only = tuple(a.only.split("/")) if a.only else None
        failed = ingest.ingest(spark, a.root, a.map, a.out, cfg, only)
        n = failed.count()
        show(failed)
        return int(a.strict and n > 0)
    if a.command == "plan":
        print("\n".join(ingest.plan_jobs(spark, a.root, a.map, a.parts, a.template or "{cmd}")))
    elif a.command == "merge":
        print("\n".join(ingest.merge_partitions(spark, a.parts, a.out)))
    elif a.command == "sources":
        show(source_table(spark, cfg.disabled_sources, cfg.source_patterns))
    elif a.command == "queries":
        print("\n".join(queries.QUERIES))
    elif a.command == "query":
        if a.name not in queries.QUERIES:
            raise ValueError(f"no such query: {a.name}")
        show(queries.QUERIES[a.name](spark, a.dir))
    elif a.command == "validate":
        found = quality.validation_issues(quality.validate(read_table(spark, a.path, typed=False)))
        show(found)
        return int(a.strict and found.where("level = 'error'").limit(1).count() > 0)
    elif a.command == "import":
        print("rows stored and rejected:", *import_file(spark, a.path, a.out, a.append))
    elif a.command == "sanitize":
        for df in ingest.run_sanitize(spark, a.store, cfg):
            show(df)
    elif a.command == "anomalies":
        found = anomalies.report(data(), cfg=cfg)
        show(found.orderBy("design", "place"))
        catalog.record(f"{a.store}/catalog", "anomaly", found)
        return int(a.strict and found.where("status <> 'cleared'").limit(1).count() > 0)
    elif a.command == "generate":
        given = {k: v for k in ("designs", "builds", "blocks", "dirty", "seed") if (v := getattr(a, k)) is not None}
        print(generate(spark, a.out, **given), "report files")
    elif a.command == "analyze":
        if a.what not in ANALYSES:
            raise ValueError(f"no such analysis: {a.what}; there are {', '.join(ANALYSES)}")
        rows = data() if not a.design else data().where(F.col("design") == a.design)
        found = ANALYSES[a.what](rows, stored(spark, a.store))
        show(found)
        if a.csv:
            write_table(found, a.csv)
    elif a.command == "train":
        done = models.train(data(), cfg=cfg)
        meta = {"best_model": done.best, "test_builds": done.held_out, "metrics": done.metrics, "metrics_train": done.metrics_train, "notes": done.notes, "models": {k: models.described(m) for k, m in done.models.items()}}
        if a.cv:
            meta["cv"] = {r.kind: r.asDict() for r in models.cross_validate(data(), list(done.models), cfg)[1].collect()}
        Path(a.out).write_text(json.dumps(meta, indent=2))
        row = [(a.out, done.best, done.metrics[done.best]["mape"], done.metrics.get("baseline", {}).get("mape"), json.dumps(done.held_out), json.dumps(done.metrics))]
        catalog.record(f"{a.store}/catalog", "model", spark.createDataFrame(row, "model_file string, best_model string, best_mape double, baseline_mape double, test_builds string, metrics string"))
        print(json.dumps({k: v["mape"] for k, v in done.metrics.items()}))
    elif a.command == "predict":
        rows = data()
        for c in ("design", "fub", "build", "workload", "operating_point"):
            rows = rows if getattr(a, c) is None else rows.where(F.col(c) == getattr(a, c))
        rows = rows if a.build else rows.join(latest_builds(rows), ["design", "build"], "left_semi")
        if not rows.limit(1).count():
            raise ValueError("no rows of that design, block, build and corner")
        model = models.fit(data(), a.model or cfg.whatif_model, cfg)
        found = models.what_if_totals(models.what_if(rows, model, overrides(a.set, False) | overrides(a.scale, True)), ["design", "workload", "operating_point"])
        show(found)
        if a.csv:
            write_table(found, a.csv)
    elif a.command == "export":
        model = models.fit(data(), a.model or "datamove", cfg)
        docs = explore.export_compact(data(), model, stored(spark, a.store).get("performance"))
        docs.repartition("design").write.mode("overwrite").partitionBy("design").text(a.out)
    elif a.command == "trace":
        docs = spark.read.text(a.models).select("design", F.col("value").alias("document"))
        timeline = explore.run_trace(docs, spark.read.option("header", True).schema("design string, interval_no int, duration_s double, workload string, operating_point string, frequency_ghz double, voltage_v double, activity_scale double").csv(a.csv))
        show(timeline.orderBy("design", "interval_no"))
        show(explore.trace_totals(timeline))
        show(explore.trace_shares(timeline))
        if a.out:
            timeline.write.mode("overwrite").option("header", True).csv(a.out)
    elif a.command == "explore":
        rows, at = data(), a.workload or "typical"
        if a.what == "sweep":
            asked = explore.sweep(a.design, at, a.feature, [float(v) for v in a.values.split(",")], a.scale)
        elif a.what == "opmap":
            asked = explore.operating_map(rows, a.design, at, [tuple(map(float, v.split("/"))) for v in (a.values or "").split(",") if v])
        elif a.what == "scenario":
            asked = explore.with_baselines(explore.from_control_file(read_scenarios(a.file)))
        else:
            raise ValueError(f"explore {a.what}: there are sweep, opmap and scenario")
        model = models.fit(rows, cfg.whatif_model, cfg)
        show(explore.evaluate(rows, explore.scenario_table(spark, asked), model, stored(spark, a.store).get("performance")).orderBy("place"))
    elif a.command in ("budget", "converge"):
        asked, rows = closure.budget_table(spark, read_budgets(a.file or cfg.budgets_file)), data(raw=True)
        history, ranks = closure.budget_history(rows, asked), closure.ranks_of(rows)
        if a.command == "budget":
            found = closure.budget_status(history, ranks, stored(spark, a.store).get("lineage"))
            show(found.orderBy("budget"))
            catalog.record(f"{a.store}/catalog", "budget_status", found.join(asked.select("budget", F.col("at_workload").alias("workload"), F.col("at_op").alias("operating_point")), "budget").withColumn("unit", F.when(F.col("metric") == "cdyn_pf", "pF").otherwise("mW")))
            return int(a.strict and found.where("status = 'OVER'").limit(1).count() > 0)
        found = closure.converge(history, ranks)
        show(found.orderBy("budget"))
        lines, left = closure.closure_plan(data(), asked, found)
        show(lines.orderBy("budget", "rank"))
        show(left.orderBy("budget", "technique"))
        return int(a.strict and found.where("verdict <> 'CONVERGED'").limit(1).count() > 0)
    elif a.command == "techniques":
        rows = data()
        names = [a.design] if a.design else [r.design for r in rows.select("design").distinct().orderBy("design").collect()]  # a row a design
        savings, needs = closure.assess_all(rows, closure.budget_table(spark, [closure.Budget(n, "design", "be_mw", 0.0) for n in names]))
        show(savings.withColumn("design", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("budget") + 1)).drop("budget").orderBy("design", F.col("saving_mw").desc()))
        show(needs)
    elif a.command == "qualify":
        found = stats.qualify(data(), tolerance=cfg.qualify_tolerance_pct)
        show(found)
        show(stats.qualify(data(), by=["partition"], tolerance=cfg.qualify_tolerance_pct))
        return int(a.strict and found.where("not passed").limit(1).count() > 0)
    elif a.command == "lineage":
        rows = stored(spark, a.store)["lineage"]
        for c in ("design", "fub"):
            rows = rows if getattr(a, c) is None else rows.where(F.col(c) == getattr(a, c))
        show(rows.orderBy("design", "build", "fub"))
    elif a.command == "measure":
        tables = stored(spark, a.store)
        print(MeasurementStore(tables["measurements_long"], tables.get("lineage")).get(**dict(x.split("=", 1) for x in a.equal)).asDict())
    elif a.command == "report":
        Path(a.out).write_text(report.write_report(spark, a.store, cfg, read_budgets(a.budgets) if a.budgets else None))
    elif a.command == "tables":
        rows = [("store", k, v.count()) for k, v in stored(spark, a.store).items()] + [("catalog", t, catalog.read(spark, f"{a.store}/catalog", t).count()) for t in catalog.TABLES]
        show(spark.createDataFrame(rows, "place string, name string, n long"))
    elif a.command == "catalog":
        show(catalog.query(spark, f"{a.store}/catalog", a.text))
    elif a.command == "sql":
        show(run_sql(spark, a.text, **stored(spark, a.store)))
    elif a.command == "costs":
        runs = catalog.profiles(spark, f"{a.store}/catalog", a.last or 5)
        show(runs.select("recorded_at", "command", "total_wall_s", "peak_rss_mb", F.size("stages").alias("n_stages")))
        show(stage_totals(stages_of(runs), ["command"]).orderBy("command", "first"))
    elif a.command == "identity":
        print(json.dumps(read_identity(a.path), indent=2))
    elif a.command == "doctor":
        import numpy
        import pandas
        import pyarrow

        for name, version in (("python", platform.python_version()), ("spark", spark.version), ("numpy", numpy.__version__), ("pandas", pandas.__version__), ("pyarrow", pyarrow.__version__)):
            print(f"{name} {version}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
