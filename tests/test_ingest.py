"""Run folders end to end: what is stored, twice, and from the command line."""

import json

import pytest
from pyspark.sql import functions as F
from wattloom import catalog, cli
from wattloom import ingest as engine
from wattloom.config import PRESETS, Config, read_budgets, read_identity, read_scenarios
from wattloom.ingest import ingest
from wattloom.profiling import profiled
from wattloom.report import write_report
from wattloom.sources.tables import import_file


def write_run(root, build, scale, extra=None):
    run = root / "runs" / "chip" / build
    files = {
        "metadata.json": json.dumps({"design": "chip", "build": build, "build_date": "2024-01-01", "run_id": build, "status": "current", "operating_points": {"nom": {"voltage_v": 0.8, "frequency_ghz": 1.0}}}),
        "pprtl/typical_nom/l_power.rpt": f"Mode: rtl\nPower units: mW\nHierarchy Internal Switching Leakage Total\nfe/a 1 1 1 {8 * scale}\nfe/b 1 1 1 {4 * scale}\n",
        "pprtl/typical_nom/p_power.rpt": f"Mode: physical\nPower units: mW\nHierarchy Internal Switching Leakage Total\nfe/a 1 1 1 {9 * scale}\nfe/b 1 1 1 {5 * scale}\n",
        "primepower/typical_nom/power_hier.rpt": f"Power units: mW\nHierarchy Int Switch Leak Total %\nchip 1 1 1 {16 * scale} 100\n  a 1 1 1 {10 * scale} 60\n  b 1 1 1 {6 * scale} 40\n  lost 1 1 1 1 1\n",
        "primetime/nom/timing_summary.rpt": "Time units: ps\nPartition Clock Period WNS TNS Violating Endpoints\nP0 clk 1000 -20 -50 3 100\n",
        "implementation/qor_summary.rpt": "Area units: um2\nHierarchy CellArea CellCount AvgFanout Utilization\na 100 20 2.5 0.7\nb 50 10 2.0 0.7\n",
        "perf/typical_nom.csv": "metric,value,unit\nipc,1.5,1\nthroughput_gops,20,gops\n",
        "starrc/parasitics_summary.rpt": "no table here\n",
        "primepower/typical_nom/power_profile.csv": f"# Power units: mW\nt_start_ns,t_end_ns,total_mw,dynamic_mw\n0,10,{15 * scale},12\n10,20,{17 * scale},13\n",
        "intent/a.upf": "create_power_domain PD -elements {a}\nset_domain_supply_net PD -primary_power_net VDD\nadd_port_state VDD -state {nom 0.9}\n",
        "intent/b.upf": "create_power_domain OTHER -elements {b}\n",
    } | (extra or {})
    for name, text in files.items():
        (run / name).parent.mkdir(parents=True, exist_ok=True)
        (run / name).write_text(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("ingest")
    write_run(root, "B1", 1.0)
    write_run(root, "B2", 1.2)
    (root / "map.csv").write_text("fub,fe_hier,be_hier,partition,owner\nA,fe/a,a,P0,x\nB,fe/b,b,P0,y\n")
    return root


def test_ingest_is_complete_and_idempotent(spark, root):
    for _ in range(2):
        failed = ingest(spark, str(root / "runs"), str(root / "map.csv"), str(root / "store")).collect()
    files = {(r.build, r.source_file.rpartition("/")[2] if r.source_file else r.error) for r in failed}
    assert files == {(b, e) for b in ("B1", "B2") for e in ("parasitics_summary.rpt", "activity: no files")}
    rows = {(r.build, r.fub): r for r in spark.read.parquet(str(root / "store" / "measurements")).collect()}
    assert len(rows) == 4
    a = rows["B1", "A"]
    assert (a.be_mw, a.fe_logical_mw, a.fe_physical_mw, a.area, a.wns_ps, a.voltage_v, a.partition, a.owner) == (10.0, 8.0, 9.0, 100.0, -20.0, 0.8, "P0", "x")
    assert a.fmax_ghz == pytest.approx(1000 / 1020) and rows["B2", "B"].be_mw == pytest.approx(7.2)
    assert {r.object for r in spark.read.parquet(str(root / "store" / "unmapped")).collect()} == {"lost"}
    assert spark.read.parquet(str(root / "store" / "performance")).count() == 2
    issues = spark.read.parquet(str(root / "store" / "lineage")).select(F.flatten(F.collect_list("lineage_issues")).alias("i")).first().i
    assert set(issues) == {"incomplete_physical_mapping"}  # capacitances could not be read
    perf = spark.read.parquet(str(root / "store" / "performance")).where("build = 'B1'").first()
    assert (perf.ipc, perf.throughput_gops, perf.frequency_ghz, perf.voltage_v) == (1.5, 20.0, 1.0, 0.8)
    windows = spark.read.parquet(str(root / "store" / "power_profile")).where("build = 'B1'").orderBy("t_start_ns").collect()
    assert [(w.workload, w.t_start_ns, w.t_end_ns, w.profile_total_mw) for w in windows] == [("typical", 0.0, 10.0, 15.0), ("typical", 10.0, 20.0, 17.0)]
    intent = {r.fub: (r.power_domain, list(r.intent_issues)) for r in spark.read.parquet(str(root / "store" / "power_intent")).where("build = 'B1'").collect()}
    assert intent == {"A": ("PD", ["domain_voltage_mismatch"]), "B": (None, ["no_power_domain"])} and a.power_domain == "PD"
    assert (a.milestone, a.design_type, a.build_status, a.run_id) == ("signoff", "unspecified", "current", "B1")
    cat = str(root / "store" / "catalog")
    assert {r.build for r in catalog.read(spark, cat, "build").collect()} == {"B1", "B2"}
    files = catalog.read(spark, cat, "source_file").where("build = 'B1' and source = 'signoff'").collect()
    assert len(files) == 1 and len(files[0].sha256) == 64 and files[0].n_records == 6
    assert catalog.import_history(spark, cat).count() == 4 and "no files" in str(catalog.import_history(spark, cat).first().errors)


def test_the_plan_does_not_grow_with_runs(spark, tmp_path):
    sizes = []
    for n in (1, 4):
        for i in range(n):
            write_run(tmp_path / str(n), f"B{i}", 1.0)
        runs = engine.find_runs(spark, str(tmp_path / str(n) / "runs"))
        sizes.append(len(engine.read_long(spark, str(tmp_path / str(n) / "runs"), runs)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_stale_reports_are_dropped_by_path(spark, tmp_path):
    old = "Run: B0\nPower units: mW\nHierarchy Int Switch Leak Total %\nchip 1 1 1 99 100\n  a 1 1 1 99 60\n"
    write_run(tmp_path, "B1", 1.0, {"primepower/idle_nom/power_hier.rpt": old})
    (tmp_path / "map.csv").write_text("fub,fe_hier,be_hier,partition,owner\nA,fe/a,a,P0,x\nB,fe/b,b,P0,y\n")
    failed = ingest(spark, str(tmp_path / "runs"), str(tmp_path / "map.csv"), str(tmp_path / "strict"))
    assert {"run id B0 is not the run's B1"} <= {r.error for r in failed.collect()}
    assert {r.workload for r in spark.read.parquet(str(tmp_path / "strict" / "measurements")).collect()} == {"typical"}
    long = spark.read.parquet(str(tmp_path / "strict" / "measurements_long"))
    assert long.where("source = 'signoff'").count() == 4  # the other report of that name stays
    ingest(spark, str(tmp_path / "runs"), str(tmp_path / "map.csv"), str(tmp_path / "lax"), Config(strict_consistency=False))
    assert spark.read.parquet(str(tmp_path / "lax" / "measurements_long")).where("source = 'signoff'").count() == 6


def test_replicas_by_policy_and_map_errors(spark, tmp_path):
    tree = "Power units: mW\nActivity: Vectorless\nHierarchy Int Switch Leak Total %\nchip 1 1 1 16 100\n  a 1 1 1 10 60\n  r0 1 1 1 2 60\n  r1 1 1 1 4 60\n"
    early = "Mode: {}\nPower units: mW\nHierarchy Internal Switching Leakage Total\nfe/a 1 1 1 8\nfe/r 1 1 1 5\n"
    write_run(tmp_path, "B1", 1.0, {"primepower/typical_nom/power_hier.rpt": tree, "pprtl/typical_nom/l_power.rpt": early.format("rtl"), "pprtl/typical_nom/p_power.rpt": early.format("physical")})
    (tmp_path / "map.csv").write_text("fub,fe_hier,be_hier,partition,owner\nA,fe/a,a,P0,x\nR,fe/r,r*,P0,y\n")
    got = {}
    for policy in ("sum", "per_instance", "mean"):
        cfg = Config(identity=Config().identity | {"replica_policy": policy})
        ingest(spark, str(tmp_path / "runs"), str(tmp_path / "map.csv"), str(tmp_path / policy), cfg)
        rows = spark.read.parquet(str(tmp_path / policy / "measurements")).collect()
        got[policy] = {r.fub: (r.be_mw, r.fe_logical_mw) for r in rows}
        assert {r.be_activity_mode for r in rows} == {"vectorless"}
    assert got["mean"] == got["sum"] == {"A": (10.0, 8.0), "R": (6.0, 5.0)} and got["per_instance"] == {"A": (10.0, 8.0), "R@0": (2.0, 2.5), "R@1": (4.0, 2.5)}
    with pytest.raises(ValueError, match="replica_policy"):
        ingest(spark, str(tmp_path / "runs"), str(tmp_path / "map.csv"), str(tmp_path / "none"), Config(identity={"replica_policy": "most"}))
    (tmp_path / "bad.csv").write_text("fub,fe_hier,be_hier,partition\nA,fe/a,a,P0\nA,fe/a,b,P1\n")
    with pytest.raises(ValueError, match="A"):
        engine.read_map(spark, str(tmp_path / "bad.csv"))


def test_presets_change_how_names_become_blocks(spark, tmp_path):
    for name, (text, own) in PRESETS.items():
        assert text and read_identity(name) == Config().identity | own
    (tmp_path / "map.csv").write_text("fub,fe_hier,partition\nA,top/u_core_phys,P0\nB,top/U.esc_3,P0\n")
    read = lambda name: {r.fub: (r.fe_hier, r.be_hier) for r in engine.read_map(spark, str(tmp_path / "map.csv"), Config(identity=read_identity(name))).collect()}
    assert read("same_hierarchy") == {"A": ("top/u_core_phys",) * 2, "B": ("top/U.esc_3",) * 2}
    with pytest.raises(ValueError, match="be_hier"):
        read("flattened_backend")
    (tmp_path / "map.csv").write_text("fub,fe_hier,be_hier\nA,top/u_core,top/u_core_phys\nB,top\\\\U.esc_3,top/x_r12\n")
    assert read("separate_hierarchies")["A"] == ("top/u_core", "top/u_core") and read("separate_hierarchies")["B"][1] == "top/x"
    assert read("rtl_activity_only") == {"A": ("top/u_core", "top/u_core"), "B": ("topu/esc", "top/x")}
    with pytest.raises(ValueError, match="kind"):
        ingest(spark, str(tmp_path), "map.csv", str(tmp_path / "none"), Config(identity={"kind": "guess"}))


def test_what_failed_is_kept_until_the_next_ingest(spark, root, tmp_path):
    out = str(tmp_path / "store")
    failed = ingest(spark, str(root / "runs"), str(root / "map.csv"), out)
    kept = spark.read.parquet(f"{out}/failed")
    assert failed.count() == kept.count() > 0 and {r.error for r in failed.collect()} == {r.error for r in kept.collect()}
    again = ingest(spark, str(root / "runs"), str(root / "map.csv"), out)
    assert again.count() == spark.read.parquet(f"{out}/failed").count() == len(again.collect())


def test_an_ingest_names_its_steps(spark, root, tmp_path):
    out = str(tmp_path / "store")
    with profiled(spark, "ingest", f"{out}/catalog"):
        ingest(spark, str(root / "runs"), str(root / "map.csv"), out)
    stages = {s.name: s for s in catalog.profiles(spark, f"{out}/catalog").first().stages}
    assert {"reports", "good", "validated", "store measurements", "failed", "catalog"} <= set(stages)
    assert stages["reports"].tasks > 0 and stages["reports"].wall_s > 0


def test_single_runs_merge_to_the_same_store(spark, root, tmp_path):
    ingest(spark, str(root / "runs"), str(root / "map.csv"), str(tmp_path / "whole"))
    lines = engine.plan_jobs(spark, str(root / "runs"), str(root / "map.csv"), str(tmp_path / "parts"), "sub -J {design}-{build} {cmd}")
    assert [line.split()[2] for line in lines] == ["chip-B1", "chip-B2"] and all("--only chip/" in line for line in lines)
    for b in ("B1", "B2"):
        ingest(spark, str(root / "runs"), str(root / "map.csv"), str(tmp_path / "parts" / f"chip__{b}"), only=("chip", b))
    assert "measurements" in engine.merge_partitions(spark, str(tmp_path / "parts"), str(tmp_path / "merged"))
    rows = lambda d: sorted((r.build, r.fub, r.be_mw, r.fe_logical_mw, r.area) for r in spark.read.parquet(str(tmp_path / d / "measurements")).collect())
    assert rows("merged") == rows("whole") and len(rows("whole")) == 4


def test_sanitized_view_until_the_next_ingest(spark, root, tmp_path):
    out = str(tmp_path / "store")
    ingest(spark, str(root / "runs"), str(root / "map.csv"), out)
    report, counts = engine.run_sanitize(spark, out)
    assert report.first().n_rows == 4 and {r.flag for r in counts.collect()} >= {"missing_physical", "intent_missing", "unmapped_objects"}
    assert engine.load_table(spark, out, "measurements_sanitized") is None and engine.load_dataset(spark, out).count() == 4
    assert json.loads(catalog.read(spark, f"{out}/catalog", "quality_run").first().counts)["missing_physical"] == 4
    ingest(spark, str(root / "runs"), str(root / "map.csv"), out)
    assert engine.load_table(spark, out, "quality_flags") is None


def test_the_report_has_all_sections_or_says_why_not(spark, root, tmp_path):
    out = str(tmp_path / "store")
    ingest(spark, str(root / "runs"), str(root / "map.csv"), out)
    text = write_report(spark, out, budgets=[])
    assert text.count("\n## ") >= 29 and "FE physical power" in text and "chip B2" in text
    assert text.count("(not available") <= 2


def test_flat_files(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Design,Build,FUB,Stage,FE Logical MW,FE Physical MW,BE MW,extra\nd,B1,a,FE_BE,8,9,10,x\nd,B1,b,FE_BE,8,9,bad,y\nd,B1,c,FE_BE,8,9,0,z\n")
    out = str(tmp_path / "store")
    assert import_file(spark, str(tmp_path / "f.csv"), out) == (1, 2)
    assert import_file(spark, str(tmp_path / "f.csv"), out, append=True) == (1, 2)
    rows = spark.read.parquet(f"{out}/measurements").collect()
    assert len(rows) == 2 and (rows[0].physical_error_mw, rows[0].extra) == (1.0, "x")
    assert {r.reject_reason for r in spark.read.parquet(f"{out}/rejected_rows").collect()} == {"non_numeric:be_mw", "zero_be"}


def test_command_line(spark, root, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["sql", str(root / "store"), "select count(*) as n from measurements"]) == 0
    assert "4" in capsys.readouterr().out
    assert cli.main(["query", "nothing", "x"]) == 1
    assert cli.main(["sql", str(root / "store"), "drop table x"]) == 1
    assert cli.main(["ingest", str(root / "runs"), str(root / "map.csv"), str(root / "other"), "--strict"]) == 1
    store = str(root / "store")
    assert cli.main(["sanitize", store]) == 0 and cli.main(["sources"]) == 0 and cli.main(["anomalies", store]) == 0
    for what in ("summary", "errors", "deltas", "frontier", "workloads", "profile", "intent"):
        assert cli.main(["analyze", what, store]) == 0, what
    assert cli.main(["analyze", "nothing", store]) == 1
    assert cli.main(["analyze", "deltas", store, "--csv", str(root / "deltas.csv")]) == 0 and spark.read.option("header", True).csv(str(root / "deltas.csv")).count() > 0
    for build, code in (("B1", 0), ("B9", 1)):  # a choice of build and corner
        assert cli.main(["predict", store, "--model", "scaled", "--scale", "fe_physical=0.5", "--build", build, "--operating-point", "nom"]) == code
    capsys.readouterr()
    assert cli.main(["measure", store, "fub=A", "build=B2", "metric=fe_physical_mw"]) == 0 and "10.79" in capsys.readouterr().out
    (root / "budgets.toml").write_text('[[budget]]\ndesign = "chip"\nbe_mw = 15.0\n')
    assert cli.main(["budget", store, str(root / "budgets.toml"), "--strict"]) == 1 and cli.main(["converge", store, str(root / "budgets.toml")]) == 0
    assert cli.main(["catalog", store, "select status from budget_status"]) == 0 and "OVER" in capsys.readouterr().out
    assert cli.main(["predict", store, "--model", "scaled", "--scale", "fe_physical=0.5"]) == 0 and cli.main(["lineage", store, "--fub", "A"]) == 0
    assert cli.main(["presets"]) == 0 and "same_hierarchy" in capsys.readouterr().out
    assert cli.main(["identity", "rtl_activity_only"]) == 0 and '"lowercase": true' in capsys.readouterr().out
    assert cli.main(["identity", "none"]) == 1 and cli.main(["init", str(root / "p.toml"), "--preset", "none"]) == 1
    assert cli.main(["init", str(root / "p.toml"), "--preset", "same_hierarchy"]) == 0 and Config.read(str(root / "p.toml")).identity["kind"] == "same_hierarchy"
    assert cli.main(["init", str(root / "c.toml")]) == 0 and cli.main(["--config", str(root / "c.toml"), "tables", store]) == 0
    assert cli.main(["plan", str(root / "runs"), "map.csv", "parts"]) == 0 and "--only chip/B2" in capsys.readouterr().out
    assert cli.main(["techniques", store]) == 0 and cli.main(["doctor"]) == 0


def test_control_files(tmp_path):
    (tmp_path / "b.toml").write_text('[defaults]\ndesign = "chip"\n[[budget]]\nbe_mw = 5.0\n[[budget]]\nscope = "fub:A"\nmetric = "cdyn_pf"\ntarget = 7\nowner = "x"\ntolerance_pct = {route = 9.0}\n')
    b = read_budgets(str(tmp_path / "b.toml"))
    assert [(x.design, x.scope, x.metric, x.target, x.tolerance_pct["route"]) for x in b] == [("chip", "design", "be_mw", 5.0, 5.0), ("chip", "fub:A", "cdyn_pf", 7, 9.0)]
    (tmp_path / "bad.toml").write_text('[[budget]]\ndesign = "chip"\nmetric = "area"\ntarget = 7\n')
    with pytest.raises(ValueError, match="area"):
        read_budgets(str(tmp_path / "bad.toml"))
    (tmp_path / "s.toml").write_text('[[scenario]]\nname = "fast"\nfrequency_ghz = 1.5\nset = {activity = 0.3}\nscale = {wire_cap_pf = 0.9}\n')
    assert read_scenarios(str(tmp_path / "s.toml"))[0]["overrides"] == {"activity": 0.3, "wire_cap_pf": "x0.9", "frequency_ghz": 1.5}
    (tmp_path / "c.toml").write_text("unknown = 1\n" + Config(stale_days=7).to_toml())
    assert Config.read(str(tmp_path / "c.toml")) == Config(stale_days=7)


def test_catalog(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert catalog.read(spark, root, "build").count() == 0
    build = lambda d, b, run: spark.createDataFrame([(d, b, run)], "design string, build string, run_id string")
    for rows in (build("d", "B1", "1"), build("d", "B2", "1"), build("d", "B1", "2")):
        catalog.record(root, "build", rows)
    assert {(r.build, r.run_id) for r in catalog.read(spark, root, "build").collect()} == {("B1", "2"), ("B2", "1")}
    for mape in (5.0, 4.0):
        catalog.record(root, "model", spark.createDataFrame([("m", "physics", mape)], "model_file string, best_model string, best_mape double"))
    assert [r.best_mape for r in catalog.query(spark, root, "select best_mape from model").collect()] == [4.0]
    stages = json.dumps([{"name": "extract", "wall_s": 1.5, "cpu_s": 1.0, "max_rss_mb": 10.0, "rows": 3}])
    catalog.record(root, "profile_run", spark.createDataFrame([("ingest", 2.0, stages)], "command string, total_wall_s double, stages string"))
    assert catalog.profiles(spark, root).first().stages[0].rows == 3
    with pytest.raises(ValueError):
        catalog.query(spark, root, "drop table build")
