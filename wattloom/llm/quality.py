"""Quality rules: a learned decision list over statistics of a text's words.

Sequential covering learns which documents to reject: grow a conjunction of thresholds on one
part of the labelled rows by information gain, prune its last conditions on the other part, keep
it if it is precise there, set aside what it covers and go on. The list is emitted as
one ordered Spark conditional expression, so that applying it is a native projection.

Defined results: null and empty texts have no words and fail the base rule; texts under five
words have no repeated window; labels with null quality are ignored, of contradicting labels the
lower counts; without labels of both kinds no rule is learned and the base rule alone decides;
repeated rows and ties get equal answers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, load, shared_dir, trim, worker_cache

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Labelled rows that fitting takes at most, by the order of hashes.
SAMPLE = 20_000
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.95
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        one = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        key = sum(one[i : n - WINDOW + 1 + i] * _MIX[i] for i in range(WINDOW))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        if same.any():
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[:-WINDOW] += twice
            edge[WINDOW:] -= twice
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``quality`` of STATISTICS; narrow."""
    from pyspark.sql.functions import pandas_udf

    shared_dir(docs.sparkSession)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache()
        for texts in batches:
            yield pd.DataFrame([statistics(t) if isinstance(t, str) else (0,) * 5 for t in texts], columns=STATISTICS)
        trim()

    of = pandas_udf(of, ", ".join(f"{c} long" for c in STATISTICS))

    return docs.withColumn("quality", of(F.col(text)))


def features() -> dict[str, Column]:
    """What conditions compare, from the statistics."""
    c = {n: F.col(n).cast("double") for n in STATISTICS}
    words = F.greatest(c["n_words"], F.lit(1.0))
    return {"words": c["n_words"], "word_length": c["word_chars"] / words, "symbols_per_word": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"], "dup_lines_per_100_words": 100 * c["n_dup_lines"] / words, "repeat_share": c["n_repeat_words"] / words}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule, inside = (), np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for name in x:
            values, y = x[name][inside], bad[inside]
            order = np.argsort(values, kind="stable")
            v, y = values[order], y[order]
            ends = np.nonzero(np.append(v[1:] > v[:-1], False))[0]
            if not len(ends):
                continue
            p, n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
            middle = (v[ends] + v[ends + 1]) / 2
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                score = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(pp + nn, 1e-9)) - np.log2(p0 / (p0 + n0))), -1)
                k = int(score.argmax())
                if score[k] > gain:
                    best, gain = Condition(name, above, float(middle[k])), score[k]
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.covers(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules; a document that one covers is rejected."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.arange(len(bad)) % 3 == 2  # a third prunes what the rest grows
    while bad[left & ~part].any() and (~bad).any():
        g = left & ~part
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g])
        p = left & part
        xp, yp = {k: v[p] for k, v in x.items()}, bad[p]

        def worth(r: Rule) -> float:
            c = _covered(r, xp, len(yp))  # noqa: B023
            return (yp[c].sum() - (~yp[c]).sum()) / max(c.sum(), 1)  # noqa: B023

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covered(rule, {k: v[left] for k, v in x.items()}, int(left.sum()))
        if not rule or c.sum() < 5 or bad[left][c].mean() < LEAST_PRECISION or worth(rule) < 2 * LEAST_PRECISION - 1:
            break
        rules.append(rule)
        left &= ~_covered(rule, x, len(bad))
    return rules


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from stats (doc_id, STATISTICS) and labels (doc_id, quality), at most ``sample`` rows, equal ones once.

    Rows are counted first; only those whose hash is under the threshold that leaves some ``sample`` are gathered.
    """
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = stats.join(one, "doc_id").select("doc_id", "label", *[c.alias(n) for n, c in features().items()]).distinct()
    names = list(features())
    rows = Scratch(stats.sparkSession, "labelled").save(rows.withColumn("h", F.xxhash64("doc_id", *names)), "rows")
    share = (sample + 4 * sample**0.5) / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.col("h") <= int(share * (1 << 64)) - (1 << 63))
    got = rows.select("h", "label", *names).toPandas().sort_values(["h", *names, "label"])[:sample]
    return learn({n: got[n].to_numpy(float) for n in names}, got["label"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """kept, as one ordered conditional expression over the statistics."""
    out = F.when(base_failed(), False)
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = out.when(test, False)
    return out.otherwise(True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    stats = scratch.save(with_statistics(docs).select("doc_id", "quality.*"), "statistics")
    rules = fit(stats, load(spark, sf_dir, "labels"))
    return stats.select("doc_id", *STATISTICS, base_failed().alias("base_failed"), verdict(rules).alias("kept"))


STATISTICS_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
g as (select doc_id, i, word || ' ' || lead(word, 1) over v || ' ' || lead(word, 2) over v || ' ' || lead(word, 3) over v || ' ' || lead(word, 4) over v as gram from w window v as (partition by doc_id order by i)),
t as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g where gram is not null) where n > 1),
r as (select doc_id, count(distinct i + k) as n from t, range(5) s(k) group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
u as (select doc_id, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
c as (select doc_id, count(*) as n, sum(length(word)) as chars from w group by doc_id)
select d.doc_id, coalesce(c.n, 0) as n_words, cast(coalesce(c.chars, 0) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  coalesce(u.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(c.n, 0) < 10 or 100 * coalesce(r.n, 0) > 20 * coalesce(c.n, 0) as base_failed
from d left join c using (doc_id) left join r using (doc_id) left join u using (doc_id)
"""


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8's rules are made of, without the learned verdict."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return with_statistics(docs).select("doc_id", "quality.*").select("doc_id", *STATISTICS, base_failed().alias("base_failed"))
