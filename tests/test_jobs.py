"""Both jobs: against DuckDB, over growing input, and run again after a failure."""

import hashlib
import re

import duckdb
import pytest
from jobs import build_scorecard, text_intake
from jobs.queries import ORACLE_SQL, QUERIES, _config
from pyspark.sql import functions as F
from wattloom.plans.fixture import table

from tests.test_oracle import SF, TABLES, rows

SCHEMA = "doc_id long, text string, source string, id int, batch string, first_id long"
INTAKE = [{"table": "documents", "id": "doc_id", "text": "text", "source": "source"}]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
    assert before == {k: spark.conf.get(k) for k in before}


def deliver(spark, folder, texts):
    df = spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in texts], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")


def plain(batches):
    """The catalogue, a text at a time."""
    first, out = {}, []
    for number, texts in enumerate(batches):
        for _, digest in sorted((i is None, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in texts):
            if digest not in first:
                ids = [i for i, t, _ in texts if i is not None and hashlib.sha256((t or "").encode()).hexdigest() == digest]
                first[digest] = min(ids, default=None)
        for i, t, s in texts:
            t = t or ""
            digest = hashlib.sha256(t.encode()).hexdigest()
            counts = len(t.encode()), t.count("\n") + 1, len(re.findall(r"[^\x20\x09-\x0D]+", t)), len(re.findall(r"[0-9]+(?:\.[0-9]+)?", t))
            out.append((number, s, i, digest, *counts, first[digest], first[digest] is not None and i != first[digest]))
    return sorted(out, key=str)


def catalogue(df):
    return sorted(((r.batch, r.source, r.id, r.sha256, r.n_bytes, r.n_lines, r.n_words, r.n_figures, r.first_id, r.repeated) for r in df.collect()), key=str)


ONE = [(5, "power 12.5 mW\nat 1.25 GHz", "a"), (3, "power 12.5 mW\nat 1.25 GHz", "b"), (1, None, "a"), (2, "", None), (9, "long " * 50_000, "a"), (None, "no id", "a"), (None, "no id", "b"), (7, "id later\x0b x", "b"), (7, "id later\x0b x", "b"), (None, "id later\x0b x", "b")]
TWO = [(2, "power 12.5 mW\nat 1.25 GHz", "c"), (11, "é new", "a"), (12, "é new", "a"), (13, "no id", "2024"), (14, "0", "2024")]


def test_only_new_files_are_taken(spark, tmp_path):
    run = lambda: text_intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), INTAKE)
    deliver(spark, tmp_path / "in", ONE)
    assert catalogue(run()) == plain([ONE])
    assert catalogue(run()) == plain([ONE])
    files = sorted(p for p in (tmp_path / "out" / "texts").rglob("*.parquet"))
    deliver(spark, tmp_path / "in", TWO)
    assert catalogue(run()) == plain([ONE, TWO])
    assert set(files) < set((tmp_path / "out" / "texts").rglob("*.parquet"))  # the first run's files are as they were


def test_a_batch_that_failed_is_written_again(spark, tmp_path, monkeypatch):
    run = lambda: text_intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), INTAKE)
    deliver(spark, tmp_path / "in", ONE)
    run()
    deliver(spark, tmp_path / "in", TWO)
    take = text_intake.take

    def torn(rows, batch, *rest):
        take(rows, batch, *rest)
        raise RuntimeError("lost after its tables were written, before the checkpoint")

    monkeypatch.setattr(text_intake, "take", torn)
    with pytest.raises(Exception, match="lost after"):
        run()
    monkeypatch.undo()
    assert catalogue(run()) == plain([ONE, TWO])


def test_an_empty_table(spark, tmp_path):
    deliver(spark, tmp_path / "in", [])
    assert text_intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), INTAKE).count() == 0


def cards(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_scorecard_of_more_builds(spark, tmp_path):
    wide = table(spark, SF, "wide").where("build_number <= 6").drop("partition_number")
    wide.where("build_number <= 5").write.parquet(str(tmp_path / "in" / "measurements"))
    run = lambda: build_scorecard.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), **{k: _config(build_scorecard)[k] for k in ("rise_pct", "usable_pct")})
    first = cards(run())
    assert first and cards(run()) == first
    wide.where("build_number = 6").write.mode("append").parquet(str(tmp_path / "in" / "measurements"))
    both = run()
    assert {r.build for r in both.select("build").distinct().collect()} == {f"B{i}" for i in range(1, 7)}
    assert both.where("build <> 'B1' and previous_mw is null and power_mw is not null").count() < both.count() / 4
    found = spark.read.parquet(str(tmp_path / "out" / "findings"))
    high = found.where("severity = 'high'").groupBy("design", "build", "partition").agg(F.count("*").alias("n"))
    assert both.join(high, ["design", "build", "partition"]).where("n <> high or grade <> 'red'").count() == 0


def test_command_line(spark, tmp_path, monkeypatch):
    from jobs import common

    deliver(spark, tmp_path / "in", ONE)
    monkeypatch.setattr("sys.argv", ["text_intake", "--config", "jobs/text_intake.json", "--input", str(tmp_path / "in"), "--output", "o"])
    seen = {}
    monkeypatch.setattr(type(spark), "stop", lambda self: seen.setdefault("stopped", True))
    common.main("text intake", "jobs/text_intake.json", lambda s, c: seen.update(c), ["input", "output", "checkpoint"])
    assert seen["input"] == str(tmp_path / "in") and seen["output"] == "o" and seen["checkpoint"] == "/data/intake-checkpoint" and seen["stopped"]
