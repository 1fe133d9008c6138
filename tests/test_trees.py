import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F
from wattloom.config import Config
from wattloom.operators import models, trees
from wattloom.operators.derive import with_derived, with_features
from wattloom.plans.fixture import table

NAMES = ["fe_physical_mw", "area", "activity", "bits_per_cycle"]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide"))
    with_features(with_derived(table(spark, "/root/testdata/sf0.001", "wide"))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_monotone_and_better_than_the_mean(wide):
    tree = trees.fit(wide, NAMES, {"fe_physical_mw"}, "be_mw", rounds=40)
    x = np.column_stack([np.linspace(0, 400, 60), np.full(60, 50.0), np.full(60, 0.2), np.full(60, np.nan)])
    assert (np.diff(tree.predict_array(x)) >= -1e-9).all()
    e = wide.select(tree.predict().alias("p"), "be_mw").agg(F.avg(F.abs(F.col("p") - F.col("be_mw"))), F.avg(F.abs(F.col("be_mw") - tree.base))).first()
    assert e[0] < 0.5 * e[1]


def test_histograms_of_all_rows_grow_the_same_trees(wide, monkeypatch):
    one = trees.fit(wide, NAMES, {"fe_physical_mw"}, "be_mw", rounds=5)
    monkeypatch.setattr(trees, "LOCAL", 0)
    monkeypatch.setattr(trees, "WRITE_EVERY", 2)
    all_ = trees.fit(wide, NAMES, {"fe_physical_mw"}, "be_mw", rounds=5)
    assert len(one.trees) == len(all_.trees) and all(len(list(trees._leaves(t))) == 15 for t in all_.trees)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.random(500) * 400, rng.random(500) * 200, rng.random(500), np.where(rng.random(500) < 0.2, np.nan, rng.random(500) * 20)])
    assert np.allclose(one.predict_array(x), all_.predict_array(x), rtol=1e-6)


def test_stopping_takes_the_best_round_back():
    tree = trees.Tree(["x"], frozenset(), rounds=100, patience=4)
    errors = iter([5.0, 4.0, 3.0, 3.5, 3.4, 3.3, 3.2, 0.0])
    tree.boost(lambda: [0.0], lambda: next(errors))
    assert len(tree.trees) == 3


def test_a_tree_is_a_kind(wide, monkeypatch):
    monkeypatch.setattr(trees.Tree, "boost", lambda self, grow, error, plain=trees.Tree.boost: plain(dataclasses.replace(self, rounds=15), grow, error) and self)
    cfg = Config(tree_features=["fe_physical_mw", "area", "fanout", "voltage_v"], test_fraction=0.3)
    few = wide.where("build_number <= 8")
    done = models.train(few, ["baseline", "scaled", "tree"], cfg)
    assert done.models["tree"].features == ["fe_physical_mw", "area", "voltage_v"] and len(done.held_out) == 3
    assert done.metrics["tree"]["n"] == done.metrics["scaled"]["n"] and set(models.evaluate(few, done)) == {"baseline", "scaled", "tree"}
    assert done.best == min(done.metrics, key=lambda k: done.metrics[k]["mape"])
    folds, summary = models.cross_validate(few, ["scaled", "tree"], cfg)
    assert folds.where("kind = 'tree'").count() == folds.where("kind = 'scaled'").count() == 8
    s = {r.kind: r for r in summary.collect()}
    assert s["tree"].n == s["scaled"].n and s["tree"].n_folds == 8


def test_settings_change_the_models(wide):
    few = wide.where("build_number <= 4")
    assert list(models.fit(few, "linear").coefficients) == Config().linear_features
    own = Config(linear_features=["area"], physics_features=["dyn_term"], datamove_features=["leak_term", "move_term"], baseline_feature="fe_logical_mw", cv_min_builds=5, min_builds_warn=4)
    assert list(models.fit(few, "linear", own).coefficients) == ["area"] and list(models.fit(few, "physics", own).coefficients) == ["dyn_term"]
    assert set(models.fit(few, "datamove", own).coefficients) == {"leak_term", "move_term"}
    assert list(models.fit(few, "scaled", own).coefficients) == list(models.fit(few, "baseline", own).coefficients) == ["fe_logical_mw"]
    with pytest.raises(ValueError, match="5 builds"):
        models.leave_one_build_out(few, "linear", cfg=own)
    assert any("noisy" in n for n in models.train(few, ["baseline"]).notes) and not models.train(few, ["baseline"], own).notes
