"""Each report format, from a literal file to long records."""

import pytest
from pyspark.sql import functions as F
from wattloom.operators.identity import convert_units
from wattloom.sources.reports import READERS, ReportError, parse_upf, read_reports
from wattloom.sources.tables import append_last_wins, read_table, run_sql, store

FILES = {
    "pprtl/typical_nom/x_power.rpt": "Mode: physical-aware   Workload: typical\nPower units: mW\nHierarchy Internal Switching Leakage Total ClockGatingEff\n---- ---- ---- ---- ---- ----\ntop/a 1 2 0.5 3.5 0.8\ntop/b 1 2 - 4.0 n/a\n",
    "primepower/typical_nom/power_hier.rpt": "Power units: W\nHierarchy Int Switch Leak Total %\n-------\nchip 1 1 0.1 2.1 100\n  part 1 1 0.1 2.1 100\n    u_a 0.5 0.5 0.05 1.05 50\n    u_b 0.5 0.5 0.05 1.05 50\n",
    "primepower/typical_nom/power_groups.rpt": "Power units: mW\nHierarchy clock_network register combinational memory Total\npart/u_a 1 2 3 4 10\n",
    "primepower/typical_nom/power_profile.csv": "# Power units: mW\nt_start_us,t_end_us,total_mw,dynamic_mw\n0,1,5,4\n1,2,6,5\n",
    "primetime/nom/timing_summary.rpt": "Time units: ns\nPartition Clock Period WNS TNS Violating Endpoints\nP0 clk 1.0 -0.02 -0.5 3 100\n",
    "starrc/parasitics_summary.rpt": "Cap units: fF\nInstance Nets TotalCap WireCap PinCap\nu_a 10 3000 1000 2000\n",
    "implementation/qor_summary.rpt": "Area units: um2\nHierarchy CellArea CellCount AvgFanout Utilization WireLength AvgNetLen\nu_a 100 20 2.5 0.7 900 45\n",
    "activity/typical.saif": '(SAIFILE (SAIFVERSION "2.0") (TIMESCALE 1 ns) (DURATION 100) (INSTANCE tb (INSTANCE top (NET (a (TC 10)) (b (TC 30))) (INSTANCE u (PORT (p (TC 99))) (NET (c (TC 60)))))))',
    "perf/typical_nom.csv": "metric,value,unit\nipc,1.5,1\nthroughput_gops,20,gops\nother,1,1\n",
    "voltus/typical_nom/power_hier.rpt": "Power units: uW\nInstance Internal Switching Leakage Total\nu_a 1 1 1 3000\n",
    "metadata.json": '{"operating_points": {"nom": {"voltage_v": 0.75, "frequency_ghz": 1.0}}}',
}


@pytest.fixture(scope="module")
def run(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


WANT = {
    "estimate": {("top/a", "fe_physical_mw"): 3.5, ("top/a", "fe_leakage_mw"): 0.5, ("top/a", "cg_efficiency"): 0.8, ("top/b", "fe_physical_mw"): 4.0, ("top/b", "fe_leakage_mw"): None, ("top/b", "cg_efficiency"): None},
    "signoff": {("part", "be_mw"): 2100.0, ("part/u_a", "be_mw"): 1050.0, ("part/u_b", "be_leakage_mw"): 50.0},
    "groups": {("part/u_a", "be_clock_mw"): 1.0, ("part/u_a", "be_memory_mw"): 4.0},
    "profile": {("0..1000", "profile_total_mw"): 5.0, ("1000..2000", "profile_dynamic_mw"): 5.0},
    "timing": {("P0", "clock_period_ps"): 1000.0, ("P0", "wns_ps"): -20.0, ("P0", "violating_endpoints"): 3.0},
    "parasitics": {("u_a", "wire_cap_pf"): 1.0, ("u_a", "cell_cap_pf"): 2.0},
    "implementation": {("u_a", "area"): 100.0, ("u_a", "fanout"): 2.5, ("u_a", "avg_net_length_um"): 45.0},
    "activity": {("top", "net_count"): 3.0, ("top", "activity"): 100 / 3 / 100, ("top/u", "bits_per_cycle"): 0.6},
    "performance": {("chip", "ipc"): 1.5, ("chip", "throughput_gops"): 20.0},
    "second_engine": {("u_a", "be_voltus_mw"): 3.0},
    "metadata": {("nom", "voltage_v"): 0.75, ("nom", "frequency_ghz"): 1.0},
}


@pytest.mark.parametrize("source", READERS)
def test_reader(spark, run, source):
    rows = convert_units(read_reports(spark, run, source, design="chip", sim_clock_period_ps=1000)).orderBy("ordinal").collect()
    assert not any(r.error or r.unit_error for r in rows)
    got = {(r.object, r.metric): r.value for r in rows}
    for key, value in WANT[source].items():
        assert got[key] == pytest.approx(value), key
    if source == "estimate":
        assert {(r.workload, r.operating_point) for r in rows} == {("typical", "nom")}
    if source == "signoff":
        assert "chip" not in {r.object for r in rows}


def test_bad_files_are_rows_with_errors(spark, tmp_path):
    (tmp_path / "activity").mkdir()
    (tmp_path / "activity" / "w.saif").write_text("(SAIFILE (DURATION 0)")
    rows = read_reports(spark, str(tmp_path), "activity", sim_clock_period_ps=1000).collect()
    assert len(rows) == 1 and rows[0].error.startswith("ReportError")
    with pytest.raises(ReportError):
        list(READERS["estimate"][0]("Mode: odd\nHierarchy a b c d\n", {}))


def test_power_intent():
    text = "create_power_domain PD -elements {top/a \\\n top/b} # x\nset_domain_supply_net PD -primary_power_net VDD\nadd_port_state VDD -state {on 0.75} -state {off off} -state {hi 0.85}\n"
    assert parse_upf(text) == [("PD", "top/a", 0.85), ("PD", "top/b", 0.85)]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" Design ,Build,BE MW\n a ,B1,1.5\nb,B1,bad\n")
    df = read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["design", "build", "be_mw"] and [tuple(r) for r in df.orderBy("design").collect()] == [("a", "B1", 1.5), ("b", "B1", None)]
    with pytest.raises(ValueError):
        read_table(spark, "x.xls")
    path = str(tmp_path / "store")
    store(df, path)
    store(df.where("design = 'a'").withColumn("be_mw", F.lit(9.0)), path)
    store(df.where("design = 'a'").withColumn("be_mw", F.lit(9.0)), path)
    assert {r.design: r.be_mw for r in spark.read.parquet(path).collect()} == {"a": 9.0, "b": None}
    old = df.withColumn("ordinal", F.lit(0))
    assert append_last_wins(old, old.withColumn("be_mw", F.lit(2.0)), ["design"]).agg(F.sum("be_mw")).first()[0] == 4.0
    with pytest.raises(ValueError):
        run_sql(spark, "drop table x")


HEAD = '(SAIFILE (SAIFVERSION "2.0") (TIMESCALE 1 ns) (DURATION 100.0)\n'
NETS = "(NET (a (T0 1) (TC 4)) (b (TC 2) // a comment )\n (TC 6)) (c (T1 3)))\n"


def test_activity_is_read_as_a_stream(spark, tmp_path):
    from wattloom.sources import reports

    depth = 5000
    deep = HEAD + "".join(f'(INSTANCE "top" u{i}\n'.replace('"top" ', "") for i in range(depth)) + NETS + "(PORT (p (TC 99)))" + ")" * depth + ")\n"
    wide = HEAD + "(INSTANCE top\n" + "".join(f"(INSTANCE m{i} {NETS})\n" for i in range(20_000)) + NETS + "))\n"
    for name, text in (("deep", deep), ("wide", wide), ("torn", wide[: len(wide) // 2]), ("other", "(NOTHING)\n"), ("late", HEAD.replace("(DURATION 100.0)", "") + "(INSTANCE t (INSTANCE a" + NETS + ")) (DURATION 5))\n")):
        (tmp_path / "activity").mkdir(exist_ok=True)
        (tmp_path / "activity" / f"{name}.saif").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a file is read in many splits
    try:
        got = reports.read_reports(spark, str(tmp_path), "activity", sim_clock_period_ps=1000.0).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: [r for r in got if r.source_file.endswith(f"/{name}.saif")]
    assert len(of("deep")) == 3 * (depth - 1) and {r.value for r in of("deep") if r.metric == "net_count"} == {3.0}
    assert {(r.metric, round(r.value, 9)) for r in of("deep")} == {("activity", round(10 / 3 / 100, 9)), ("bits_per_cycle", 0.1), ("net_count", 3.0)}
    assert len(of("wide")) == 60_000 and {r.workload for r in of("wide")} == {"wide"} and sorted(r.ordinal for r in of("wide")) == list(range(60_000))
    for name, why in (("torn", "unbalanced"), ("other", "not a SAIF"), ("late", "no duration")):
        assert [why in r.error for r in of(name) if r.error] == [True]
    text = HEAD + "(INSTANCE top (INSTANCE a" + NETS + "(INSTANCE b" + NETS + "))))\n"
    assert [(o, m, round(v, 6)) for o, _, m, v, _ in reports.activity(text, {"sim_clock_period_ps": 1000.0})] == [("a/b", "activity", 0.033333), ("a/b", "bits_per_cycle", 0.1), ("a/b", "net_count", 3.0), ("a", "activity", 0.033333), ("a", "bits_per_cycle", 0.2), ("a", "net_count", 6.0)]
