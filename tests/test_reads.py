"""What is read many times is computed once: a query's plan reads the largest table once at most."""

import re

import pytest
from jobs import build_scorecard
from wattloom import queries

SF = "/root/testdata/sf0.001"
QUALITY = ["validation_issues", "sanitize_counts", "quality_report"]
ANOMALIES = ["anomaly_report", "anomaly_skipped", "anomaly_status", "anomaly_creeping_growth"]
EXPLORED = ["explore_sweep", "explore_opmap"]


def reads(df):
    return len(re.findall(r"Relation \[[^\]]*l_orderkey", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("name", [*QUALITY, *ANOMALIES])
def test_a_query_reads_its_table_once(spark, name):
    assert reads(queries.QUERIES[name](spark, SF)) <= 1


@pytest.mark.parametrize("name", ["model_baseline", "model_scaled"])
def test_a_split_does_not_compute_rows_again(spark, monkeypatch, name):
    seen, split = [], queries.models.split_by_build
    monkeypatch.setattr(queries.models, "split_by_build", lambda df: seen.append(df) or split(df))
    queries.QUERIES[name](spark, SF)
    assert [reads(df) for df in seen] == [0]


@pytest.mark.parametrize("name", EXPLORED)
def test_exploration_does_not_compute_rows_again(spark, monkeypatch, name):
    seen, evaluate = [], queries.explore.evaluate
    monkeypatch.setattr(queries.explore, "evaluate", lambda df, *rest: seen.append(df) or evaluate(df, *rest))
    queries.QUERIES[name](spark, SF)
    assert [reads(df) for df in seen] == [0]


def test_the_scorecard_does_not_compute_rows_again(spark, monkeypatch, tmp_path):
    seen, sanitize = [], build_scorecard.quality.sanitize
    monkeypatch.setattr(build_scorecard.quality, "sanitize", lambda df: seen.append(df) or sanitize(df))
    build_scorecard.run(spark, SF, str(tmp_path))
    assert [reads(df) for df in seen] == [0]


NAMED = ["model_scaled", "model_baseline", "explore_scenarios", "explore_sweep", "explore_wires", "sanitize_counts", "sanitize_flags", "quality_report", "validation_issues"]
NAMED += [f"anomaly_{n}" for n in ("by_owner", "report", "findings", "skipped", "status", "unexplained_regression", "clock_dominant", "activity_power_mismatch")]


@pytest.mark.parametrize("name", NAMED)
def test_a_run_reads_its_table_in_one_execution(spark, name):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in map(found.apply, range(found.size()))}

    before = max(executions(), default=-1)
    df = queries.QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    found = [text.count("lineitem.parquet") for n, text in executions().items() if n > before and "lineitem.parquet" in text]
    assert len(found) == 1 and found[0] <= 2  # a read in the initial plan, and in the final one
    assert reads(df) == 0
