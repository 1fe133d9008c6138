"""A generated tree, read back: the reports give the truth, planted defects are found."""

import pytest
from pyspark.sql import functions as F
from wattloom import ingest as engine
from wattloom.sources.generate import generate

TIGHT = ["be_mw", "be_leakage_mw", "fe_physical_mw", "fe_logical_mw", "fe_leakage_mw", "be_clock_mw", "be_register_mw", "be_comb_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "clock_period_ps", "wns_ps", "cg_efficiency", "voltage_v", "frequency_ghz", "activity", "bits_per_cycle"]
KEY = ["design", "build", "fub", "workload", "operating_point"]


@pytest.mark.parametrize("dirty", [0.0, 0.6])
def test_round_trip(spark, tmp_path, dirty):
    out = f"file://{tmp_path}/tree"
    designs, builds, blocks = (2, 8, 3) if dirty else (2, 3, 5)
    n = generate(spark, out, designs, builds, blocks, dirty)
    defects = spark.read.parquet(f"{out}/defects").collect()
    kinds = {k: {(d.design, d.build, d.block) for d in defects if d.kind == k} for k in ("zero_power", "negative_area", "superseded", "watts", "no_parasitics")}
    assert n == designs * builds * (1 + 6 * 4 + 2 + 2 + 3) - len(kinds["no_parasitics"])
    assert generate(spark, out, designs, builds, blocks, dirty) == n  # again: the same files
    failed = engine.ingest(spark, f"{out}/runs", f"{out}/map.csv", f"{out}/store").collect()
    lost = {(f.design, f.build) for f in failed if "parasitics" in f.error}
    assert lost == {(d, b) for d, b, _ in kinds["no_parasitics"]}
    truth = spark.read.parquet(f"{out}/truth")
    got = spark.read.parquet(f"{out}/store/measurements")
    bad = kinds["zero_power"] | kinds["negative_area"]
    wrong = truth.join(spark.createDataFrame(sorted(bad) or [("", "", 0)], "design string, build string, block int"), ["design", "build", "block"], "left_anti")
    assert got.count() == wrong.count()  # a row with a planted defect is rejected, no other is
    if dirty:
        assert all(kinds.values())
        rejected = spark.read.parquet(f"{out}/store/rejected")
        assert {(r.design, r.build, int(r.fub[1:])) for r in rejected.collect()} == bad
        assert {(r.design, r.build) for r in got.where("build_status = 'superseded'").select("design", "build").distinct().collect()} <= {(d, b) for d, b, _ in kinds["superseded"]}
    both = got.select(*KEY, *[F.col(c).alias(f"got_{c}") for c in TIGHT]).join(wrong, KEY)
    assert both.count() == got.count()
    for c in TIGHT:
        gone = {(d, b) for d, b, _ in kinds["no_parasitics"]} if c in ("wire_cap_pf", "cell_cap_pf") else set()
        off = both.where(F.col(f"got_{c}").isNull() | (F.abs(F.col(f"got_{c}") - F.col(c)) > 5e-3 * F.abs(F.col(c)) + 1e-9)).select("design", "build").distinct().collect()
        assert {(r.design, r.build) for r in off} <= gone, c
