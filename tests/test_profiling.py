"""What commands cost: steps, Spark's share of them, what the catalog keeps, and sums a stage."""

import pytest
from pyspark.sql import functions as F
from wattloom import catalog, cli
from wattloom.profiling import profiled, stage_totals, stages_of, step


def test_two_commands_are_recorded_and_summed_by_stage(spark, tmp_path):
    root = str(tmp_path / "catalog")
    for command, n in (("ingest", 2), ("report", 1)):
        with profiled(spark, command, root) as profile:
            for _ in range(n):
                with step("count", rows=1000) as s:
                    spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 3).alias("k")).count().collect()
            with step("nothing"):
                pass
        assert s.jobs >= 1 and s.tasks >= 4 and s.task_s >= 0 and s.shuffle_mb > 0 and profile.steps[-1].tasks == 0
        assert profile.total_wall_s >= sum(x.wall_s for x in profile.steps)
    runs = catalog.profiles(spark, root)
    assert [r.command for r in runs.collect()] == ["report", "ingest"] and all(r.peak_rss_mb > 0 for r in runs.collect())
    totals = {(r.command, r.name): r for r in stage_totals(stages_of(runs), ["command"]).collect()}
    assert {k: (r.calls, r.rows, r["first"]) for k, r in totals.items()} == {("ingest", "count"): (2, 2000, 0), ("ingest", "nothing"): (1, 0, 2), ("report", "count"): (1, 1000, 0), ("report", "nothing"): (1, 0, 1)}
    whole = {r.name: r.calls for r in stage_totals(stages_of(runs)).collect()}
    assert whole == {"count": 3, "nothing": 2}


def test_a_failed_step_is_recorded_and_its_job_group_ends(spark, tmp_path):
    root = str(tmp_path / "catalog")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "mine")
    try:
        with pytest.raises(RuntimeError), profiled(spark, "ingest", root), step("breaks"):
            raise RuntimeError("broken")
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [s.name for s in catalog.profiles(spark, root).first().stages] == ["breaks"]
    with step("no profile is open") as s:
        assert s is None


def test_stage_figures_that_are_missing(spark):
    schema = "name string, wall_s double, cpu_s double, max_rss_mb double, rows long, place int"
    [r] = stage_totals(spark.createDataFrame([("a", 1.5, None, None, None, 3), ("a", None, None, 2.0, 4, 1)], schema)).collect()
    assert (r.wall_s, r.cpu_s, r.max_rss_mb, r.rows, r.calls, r["first"]) == (1.5, 0.0, 2.0, 4, 2, 1)
    assert stage_totals(spark.createDataFrame([], schema)).count() == 0
    assert stages_of(catalog.profiles(spark, "/nowhere")).count() == 0


def test_commands_with_profiles(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    store = str(tmp_path / "store")
    (tmp_path / "f.csv").write_text("design,build,fub,stage,fe_logical_mw,fe_physical_mw,be_mw\nd,B1,a,FE_BE,8,9,10\n")
    assert cli.main(["--profile", store, "import", str(tmp_path / "f.csv"), store]) == 0
    assert cli.main(["--profile", store, "query", "no such query", store]) == 1  # a command that fails is recorded too
    assert cli.main(["costs", store]) == 0
    out = capsys.readouterr().out
    assert "import" in out and "query" in out
