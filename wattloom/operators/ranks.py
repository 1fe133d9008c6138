"""Exact order statistics of columns that no task could hold: distributed selection by narrowing histograms.

Each round is one aggregate over all columns, parts and ranks that are asked for: values fall into equal bins between the least
and the greatest value that a rank may still have; counts, least and greatest value of each bin reach the driver; the
bin that holds the rank becomes the next range. A range shrinks with each round, as its ends are values
themselves, and a range of one value is the answer. Once all open ranges together hold GATHER values or less, these are fetched and
sorted. The number of rounds follows from how values spread (some three a million for smooth ones), not from
how rows are dealt; no task sorts a column, and no row of a group larger than GATHER leaves its executor.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a range, and values that the driver takes to end with.
BINS, GATHER = 128, 50_000


@dataclass(frozen=True)
class Ask:
    """A quantile of a column, over all rows, those of one part, or those of all parts but one."""

    column: str
    q: float
    only: str | None = None
    but: str | None = None

    def holds(self, part: str | None) -> bool:
        return (self.only is None or part == self.only) and (self.but is None or part != self.but)


def _bin(v: Column, low: Column, high: Column) -> Column:
    """The bin of v, rising with it: the least value is in the first, the greatest in the last."""
    wide = high - low == float("inf")  # twice the greatest double
    share = F.when(wide, (v / 2 - low / 2) / (high / 2 - low / 2)).otherwise((v - low) / (high - low))
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def quantiles(df: DataFrame, columns: dict[str, Column], asks: list[Ask], part: str | None = None) -> list[float | None]:
    """The asked quantiles, interpolated between the two nearest ranks; None where there is no value.

    columns: what each name stands for; nulls and NaN are no values. part: a column with as many values as a driver can hold, such
    as builds or kinds. The rows are read once a round: pass a table that is written.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("column"), c.cast("double").alias("v")) for k, c in columns.items()])
    rows = df.select(F.lit(None).cast("string").alias("part") if part is None else F.col(part).cast("string").alias("part"), F.inline(pairs)).where("v is not null and not isnan(v)")
    ends = defaultdict(dict)
    for r in rows.groupBy("column", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # a row a column and part
        ends[r.column][r.part] = r.n, r.low, r.high
    # a target: a rank of a column over the parts of an ask, its range, and how many values are below that
    found, open_ = {}, {}
    for ask in asks:
        own = [x for p, x in ends[ask.column].items() if ask.holds(p)]
        n = sum(x[0] for x in own)
        for k in {math.floor(ask.q * (n - 1)), math.ceil(ask.q * (n - 1))} if n else ():
            open_[ask.column, ask.only, ask.but, k] = 0, n, min(x[1] for x in own), max(x[2] for x in own)
    while True:
        for t, (_, _, low, high) in list(open_.items()):
            if low == high:
                found[t] = low
                del open_[t]
        if not open_:
            break
        ranges = defaultdict(int)
        for (column, *_), (_, n, low, high) in open_.items():
            ranges[column, low, high] = max(n, ranges[column, low, high])
        asked = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "range int, column string, low double, high double")
        # as many rows as ranks are asked for
        within = rows.join(F.broadcast(asked), "column").where("v >= low and v <= high")
        if sum(ranges.values()) <= GATHER:
            held = defaultdict(list)
            for r in within.select("range", "part", "v").collect():
                held[r.range].append((r.v, r.part))
            for i, (column, low, high) in enumerate(ranges):
                for t, (below, _, *ends_) in open_.items():
                    if t[0] == column and ends_ == [low, high]:
                        ask = Ask(column, 0, t[1], t[2])
                        found[t] = sorted(v for v, p in held[i] if ask.holds(p))[t[3] - below]
            break
        bins = defaultdict(list)
        for r in within.groupBy("range", _bin(F.col("v"), F.col("low"), F.col("high")).alias("bin"), "part").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest")).collect():  # at most BINS rows a range and part
            bins[r.range].append((r.bin, r.part, r.n, r.least, r.greatest))
        at = {r: i for i, r in enumerate(ranges)}
        for t, (below, _, low, high) in open_.items():
            ask, own = Ask(t[0], 0, t[1], t[2]), defaultdict(list)
            for b, p, *x in bins[at[t[0], low, high]]:
                if ask.holds(p):
                    own[b].append(x)
            order = sorted(own)
            tops, total = [], below
            for b in order:
                total += sum(x[0] for x in own[b])
                tops.append(total)
            k = bisect.bisect_right(tops, t[3])
            parts = own[order[k]]
            n = sum(x[0] for x in parts)
            open_[t] = tops[k] - n, n, min(x[1] for x in parts), max(x[2] for x in parts)
    out = []
    for ask in asks:
        n = sum(x[0] for p, x in ends[ask.column].items() if ask.holds(p))
        if not n:
            out.append(None)
            continue
        position = ask.q * (n - 1)
        low, high = (found[ask.column, ask.only, ask.but, k] for k in (math.floor(position), math.ceil(position)))
        share = position - math.floor(position)
        out.append(low if low == high else (1 - share) * low + share * high)
    return out
