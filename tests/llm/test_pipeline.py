import itertools
import re

import corpus_pipeline
from pyspark.sql import functions as F
from wattloom.llm.common import load
from wattloom.llm.quality import statistics

SF = "/root/testdata/sf0.01"


def similar_groups(texts):
    """The least id reachable over pairs whose sets of five-word shingles have a similarity of 0.8 or more: brute force."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i in sorted(sets):
        shared = {}
        for g in sets[i]:
            for j in holders.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(g, []).append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = load(spark, SF, "documents").withColumn("row", F.lit("clash")).withColumn("fp", F.lit(1))
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(rows[name]) == docs.count()
    start = {r.doc_id: r.text for r in load(spark, SF, "documents").collect()}
    assert all(any(c.isalpha() for c in t) for t in rows["language_id"].values())
    for i, t in rows["quality_rules"].items():
        n, _, _, _, repeated = statistics(t)
        assert t == start[i] and n >= 10 and 100 * repeated <= 20 * n
    label = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    good = [i for i, t in rows["language_id"].items() if label.get(i) == 1 and statistics(t)[0] >= 10 and 5 * statistics(t)[4] <= statistics(t)[0]]
    assert sum(i in rows["quality_rules"] for i in good) >= 0.97 * len(good)
    kept = rows["simhash_near_dedup"]
    group = similar_groups(rows["quality_rules"])
    want = {i for i in group if group[i] == i}
    assert len(want) < len(group) and len(want ^ set(kept)) <= 0.01 * len(group)
    assert all(t == start[i] for i, t in kept.items())
    assert set(rows["suffix_array_dedup"]) == set(kept)
    seen = set()
    for i in sorted(kept):  # every byte under a 100-byte string that stood earlier goes, and no other
        raw = kept[i].encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 99):
            window = raw[at : at + 100]
            if window in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(window)
        left, at = b"", 0
        for g, run in itertools.groupby(gone):
            n = len(list(run))
            left += b"" if g else raw[at : at + n].decode(errors="ignore").encode()
            at += n
        assert rows["suffix_array_dedup"][i] == left.decode()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == set(kept) and all(r.n == r.t for r in packed)


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for name in ("documents", "labels"):
        load(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
