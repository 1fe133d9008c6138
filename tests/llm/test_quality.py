import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from wattloom.llm.common import load
from wattloom.llm.quality import features, fit, learn, op8_quality_rules, statistics, verdict, with_statistics

SF = "/root/testdata/sf0.01"


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_the_plain_ones(spark):
    rng = random.Random(3)
    texts = ["", " \n ", "a b c d e", "a b c d e a b c d e", "a " * 30, "x\ny\nx\n\n \n \nx ", "é中#$ <|> \u00a0 \x1c q", "l\r\nl\r\n"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [r.text for r in load(spark, SF, "documents").limit(150).collect()]
    for t in texts:
        assert statistics(t) == slow(t), t[:80]


def test_rules_find_planted_junk_and_keep_the_rest():
    rng = np.random.default_rng(1)
    n = 3000
    x = {k: rng.normal(size=n) for k in features()}
    bad = (x["words"] > 1) & (x["dup_lines"] > 0) | (x["repeat_share"] < -2)
    rules = learn(x, bad)
    assert 1 <= len(rules) <= 6
    hit = np.zeros(n, bool)
    for r in rules:
        c = np.ones(n, bool)
        for k in r:
            c &= k.covers(x)
        hit |= c
    assert (hit & ~bad).mean() < 0.01 and (hit & bad).sum() > 0.9 * bad.sum()
    assert learn(x, np.zeros(n, bool)) == [] and learn(x, np.ones(n, bool)) == []


def test_query(spark):
    rows = op8_quality_rules(spark, SF).collect()
    texts = {r.doc_id: r.text for r in load(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    label = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    for r in rows:
        want = slow(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a b", 3)], "doc_id long, text string, n_words int")
    stats = with_statistics(docs.select("doc_id", "text")).select("doc_id", "quality.*")
    labels = spark.createDataFrame([(1, None), (1, 0), (1, 1), (None, 1)], "doc_id long, quality int")
    assert [r.kept for r in stats.select(verdict(fit(stats, labels)).alias("kept")).collect()] == [False] * 3
    assert fit(stats.limit(0), labels.limit(0)) == []


def test_sampling_ties_repeats_and_long_texts(spark):
    rows = [(i % 700, 40.0 + i % 2, i % 2) for i in range(2100)]  # each row three times
    stats = spark.createDataFrame([(i, int(w), 200, 0, 0, 0) for i, w, _ in rows], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 2, "doc_id long, quality int")
    rules = fit(stats, labels)
    assert rules and fit(stats, labels, sample=100) and fit(stats.union(stats), labels) == rules
    kept = stats.select("n_words", verdict(rules).alias("kept")).distinct().collect()
    assert {(r.n_words, r.kept) for r in kept} == {(40, False), (41, True)}
    same = stats.withColumn("n_words", F.lit(50).cast("long"))  # ties: nothing tells good from bad
    assert fit(same, labels) == []
    assert statistics("a b c d e f " * 300_000) == (1_800_000, 1_800_000, 0, 0, 1_800_000)


def plain_gain(rows, p0, n0):
    """A condition's gain over rows (bad or not) that it covers, of p0 bad and n0 good ones."""
    p = sum(rows)
    return p * (np.log2(p / len(rows)) - np.log2(p0 / (p0 + n0))) if p else -1.0


def plain_grow(x, bad):
    """Every threshold between two neighbouring values of every feature is tried on every row."""
    rule, rows = [], range(len(bad))
    while len(rule) < 3 and any(bad[i] for i in rows) and not all(bad[i] for i in rows):
        p0 = sum(bad[i] for i in rows)
        best, gain = None, 1e-9
        for name, v in x.items():
            values = sorted({v[i] for i in rows})
            middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
            for above in (False, True):
                for m in middles:
                    g = plain_gain([bad[i] for i in rows if (v[i] >= m if above else v[i] <= m)], p0, len(rows) - p0)
                    if g > gain:
                        best, gain = (name, above, m), g
        if best is None:
            break
        rule.append(best)
        rows = [i for i in rows if plain_covers([best], x, i)]
    return rule


def plain_covers(rule, x, i):
    return all(x[name][i] >= m if above else x[name][i] <= m for name, above, m in rule)


def plain_learn(x, bad):
    rules, left = [], list(range(len(bad)))
    while any(bad[i] for i in left if i % 3 < 2) and not all(bad):
        grow, prune = [i for i in left if i % 3 < 2], [i for i in left if i % 3 == 2]
        rule = plain_grow({k: [v[i] for i in grow] for k, v in x.items()}, [bad[i] for i in grow])

        def worth(r):
            hit = [bad[i] for i in prune if plain_covers(r, x, i)]  # noqa: B023
            return (sum(hit) - (len(hit) - sum(hit))) / max(len(hit), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = [bad[i] for i in left if plain_covers(rule, x, i)]
        if not rule or len(hit) < 5 or sum(hit) / len(hit) < 0.95 or worth(rule) < 0.9:
            break
        rules.append(rule)
        left = [i for i in left if not plain_covers(rule, x, i)]
    return rules


def planted(seed, n=240):
    """Statistics with many ties, and labels by a random conjunction or two, some of them wrong."""
    rng = np.random.default_rng(seed)
    rows = [(int(w), int(w * c), int(s), int(d), int(min(w, r))) for w, c, s, d, r in zip(rng.integers(8, 60, n), rng.integers(2, 9, n), rng.integers(0, 6, n), rng.integers(0, 4, n), rng.integers(0, 6, n), strict=True)]
    bad = [(w > 40 and d > 1) or (s > 4 and c < w * 6) or rng.random() < 0.01 * (seed % 2) for w, c, s, d, _ in rows]
    return rows, bad


def plain_features(w, c, s, d, r):
    n = max(w, 1.0)
    return {"words": float(w), "word_length": c / n, "symbols_per_word": s / n, "dup_lines": float(d), "dup_lines_per_100_words": 100.0 * d / n, "repeat_share": r / n}


def test_grow_and_prune_equal_a_plain_search():
    found = 0
    for seed in range(12):
        rows, bad = planted(seed)
        each = [plain_features(*r) for r in rows]
        x = {k: [e[k] for e in each] for k in each[0]}
        got = learn({k: np.array(v) for k, v in x.items()}, np.array(bad))
        assert [[(c.feature, c.above, c.threshold) for c in rule] for rule in got] == plain_learn(x, bad), seed
        found += len(got)
    assert found >= 12


def test_the_case_equals_the_rules_row_by_row(spark):
    rows, bad = planted(3)
    rows += [(0, 0, 0, 0, 0), (9, 45, 5, 3, 0), (50, 200, 5, 3, 11), (50, 200, 5, 3, 10)]
    each = [plain_features(*r) for r in rows]
    x = {k: [e[k] for e in each] for k in each[0]}
    rules = learn({k: np.array(v[: len(bad)]) for k, v in x.items()}, np.array(bad))
    plain = [[(c.feature, c.above, c.threshold) for c in rule] for rule in rules]
    stats = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    kept = {r.doc_id: r.kept for r in stats.select("doc_id", verdict(rules).alias("kept")).collect()}
    want = {i: not (r[0] < 10 or 100 * r[4] > 20 * r[0] or any(plain_covers(rule, x, i) for rule in plain)) for i, r in enumerate(rows)}
    assert rules and kept == want and 0 < sum(want.values()) < len(want)
