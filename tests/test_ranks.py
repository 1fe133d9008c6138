import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from wattloom.operators import ranks
from wattloom.operators.ranks import Ask, quantiles

SHAPES = {
    "smooth": lambda g, n: [g.gauss(0, 1) for _ in range(n)],
    "ties": lambda g, n: [float(g.randrange(4)) for _ in range(n)],
    "far": lambda g, n: [10.0 ** g.uniform(-300, 300) * g.choice((-1, 1)) for _ in range(n)],
    "extreme": lambda g, n: [g.choice((-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324, g.random())) for _ in range(n)],
    "one": lambda g, n: [3.5] * n,
}


@pytest.mark.parametrize("gather", [50_000, 5])
def test_like_numpy(spark, monkeypatch, gather):
    monkeypatch.setattr(ranks, "GATHER", gather)
    monkeypatch.setattr(ranks, "BINS", 64 if gather == 5 else 128)
    g = random.Random(1)
    n = 400
    data = {k: f(g, n) for k, f in SHAPES.items()}
    parts = [g.choice(["a", "a", "b", None]) for _ in range(n)]
    holes = [g.random() < 0.2 for _ in range(n)]
    rows = [(p, *[None if h and k != "one" else v[i] for k, v in data.items()]) for i, (p, h) in enumerate(zip(parts, holes, strict=True))]
    df = spark.createDataFrame(rows, "part string, " + ", ".join(f"{k} double" for k in SHAPES)).withColumn("empty", F.lit(None).cast("double")).repartition(5).persist()
    asks = [Ask(k, q, only, but) for k in [*SHAPES, "empty"] for q in (0, 0.05, 0.5, 0.95, 1) for only, but in ((None, None), ("a", None), (None, "a"), ("none", None))]
    got = quantiles(df, {k: F.col(k) for k in [*SHAPES, "empty"]}, asks, part="part")
    df.unpersist()
    for ask, x in zip(asks, got, strict=True):
        own = sorted(r[1 + list(SHAPES).index(ask.column)] for r in rows if ask.column != "empty" and r[1 + list(SHAPES).index(ask.column)] is not None and ask.holds(r[0]))
        if not own:
            assert x is None
            continue
        at = ask.q * (len(own) - 1)
        low, high = own[math.floor(at)], own[math.ceil(at)]
        want = low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))
        assert x == want, ask
        if abs(low) < 1e100 and abs(high) < 1e100:
            assert np.isclose(x, np.quantile(own, ask.q))


def test_rounds_do_not_follow_rows(spark):
    rounds = []
    for n in (20_000, 200_000):
        df = spark.range(n, numPartitions=4).select((F.xxhash64("id") / 2.0**63).alias("v"))
        tracker, group = spark.sparkContext.statusTracker(), f"ranks-{n}"
        spark.sparkContext.setJobGroup(group, "x")
        ranks.GATHER, before = 100, ranks.GATHER
        try:
            [x] = quantiles(df, {"v": F.col("v")}, [Ask("v", 0.5)])
        finally:
            ranks.GATHER = before
            spark.sparkContext.setJobGroup("", "")
        assert x == df.select(F.median("v")).first()[0]
        rounds.append(len(tracker.getJobIdsForGroup(group)))
    assert rounds[1] <= rounds[0] + 2
