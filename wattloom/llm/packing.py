"""Packing documents into sequences by cutting-stock column generation.

A document is cut into whole sequences and a remainder. Remainders are counted in classes of
GRAIN tokens; that histogram (128 numbers, whatever the corpus) is all that the driver sees. Gilmore
and Gomory's linear program over patterns of classes is solved by revised simplex, its columns
priced by knapsack dynamic programming, and rounded down. Remainders are ranked within their
classes, and ranks say which copy of which pattern a document goes to, without any search.

Classes round lengths up, so patterns leave small gaps. As texts may be cut freely, the share of
pattern copies that fills all gaps is given up beforehand, and the documents thus left over are
laid end to end over the gaps, then over sequences of their own; the last tokens make sequences
of powers of two. So nothing is padded but what rounding leaves at the very end.

Defined results: null and empty texts are one end token; repeated rows and repeated or null ids are
documents of their own (their pieces carry the same doc_id); one very long document is many
whole sequences; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, load
from wattloom.llm.tokens import encoded, expand

LENGTH = 2048
GRAIN = 16
#: Sequences whose prefix sums one window adds up.
BUCKET = 1 << 14
PIVOTS = 5_000
GAP = 2e-4


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth: an unbounded knapsack by dynamic programming over the room used."""
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for used in range(1, room + 1):
        worth[used], choice[used] = worth[used - 1], -1
        fits = np.searchsorted(sizes, used, side="right")
        if fits:
            values = worth[used - sizes[:fits]] + prices[:fits]
            k = int(values.argmax())
            if values[k] > worth[used] + 1e-12:
                worth[used], choice[used] = values[k], k
    pattern, used = np.zeros(len(sizes), np.int64), room
    while used > 0:
        k = choice[used]
        if k < 0:
            used -= 1
        else:
            pattern[k] += 1
            used -= sizes[k]
    return float(worth[room]), pattern


def solve(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, fractional copies of each) that hold all counts in least sequences.

    sizes ascending, all counts positive. Stops within GAP of the bound that prices give (their
    worth over that of the best pattern), or after PIVOTS pivots; any basis holds all counts.
    """
    patterns = np.diag(room // sizes)  # a row is a pattern
    inverse = np.diag(1.0 / (room // sizes))
    copies = inverse.diagonal() * counts
    bound = 0.0
    for _ in range(PIVOTS):
        worth, column = best_pattern(np.maximum(inverse.sum(axis=0), 0), sizes, room)
        total = float(copies.sum())
        bound = max(bound, total / max(worth, 1))
        if total - bound <= GAP * total:
            break
        enter = (inverse * column).sum(axis=1)  # small products: no threads of a linear algebra library
        ratio = np.where(enter > 1e-9, copies / np.where(enter > 1e-9, enter, 1), np.inf)
        leave = int(ratio.argmin())
        patterns[leave] = column
        row = inverse[leave] / enter[leave]
        inverse = inverse - enter[:, None] * row
        inverse[leave] = row
        copies = np.maximum((inverse * counts).sum(axis=1), 0)
    return patterns, copies


class Plan:
    """Which ranks of each class go to which pattern: from the histogram {class: (count, tokens)}."""

    def __init__(self, histogram: dict[int, tuple[int, int]], length: int = LENGTH, grain: int = GRAIN):
        sizes = np.array(sorted(histogram), np.int64)
        counts = np.array([histogram[c][0] for c in sizes], np.int64)
        tokens = np.array([histogram[c][1] for c in sizes], np.int64)
        self.ranges: dict[int, np.ndarray] = {}
        self.sequences = 0
        if not len(sizes):
            return
        patterns, copies = solve(sizes, counts.astype(float), length // grain)
        copies = np.floor(copies + 1e-9).astype(np.int64)
        while ((patterns * copies[:, None]).sum(axis=0) > counts).any():
            over = ((patterns * copies[:, None]).sum(axis=0) > counts) @ patterns.T > 0
            copies[over] = np.maximum(copies[over] - 1, 0)
        mean = tokens / counts
        used = ((patterns * copies[:, None]) @ mean).sum()
        gaps = length * copies.sum() - used
        rest = tokens.sum() - used
        if gaps > rest:  # give up so many copies that their documents fill the others' gaps
            share = (used + rest) / (used + gaps) - 1e-3
            copies = np.floor(copies * max(share, 0)).astype(np.int64)
        start = np.zeros(len(sizes), np.int64)
        rows: dict[int, list] = {}
        for pattern, n in zip(patterns, copies, strict=True):
            if not n or not pattern.any():
                continue
            slot = 0
            for k in np.nonzero(pattern)[0]:
                each = int(pattern[k])
                rows.setdefault(int(sizes[k]), []).append((start[k], start[k] + n * each, self.sequences, each, slot))
                start[k] += n * each
                slot += each
            self.sequences += int(n)
        self.ranges = {c: np.array(r, np.int64) for c, r in rows.items()}

    def place(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot) of each document, sequence -1 for those left over."""
        sequence, slot = np.full(len(classes), -1, np.int64), np.zeros(len(classes), np.int64)
        for c in np.unique(classes):
            table = self.ranges.get(int(c))
            if table is None:
                continue
            here = np.nonzero(classes == c)[0]
            here = here[ranks[here] < table[-1, 1]]
            first, _, base, each, at = table[np.searchsorted(table[:, 1], ranks[here], side="right")].T
            sequence[here] = base + (ranks[here] - first) // each
            slot[here] = at + (ranks[here] - first) % each
        return sequence, slot


def _running(rows: DataFrame, bucket: Column, order: list[str], amount: str, name: str) -> DataFrame:
    """rows with the sum of ``amount`` over all rows before, by (bucket, order), in two levels."""
    rows = rows.withColumn("bucket_", bucket)
    sums = rows.groupBy("bucket_").agg(F.sum(amount).alias("sum_"))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    sums = sums.select("bucket_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy("bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside_", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.join(sums, "bucket_").withColumn(name, F.col("base_") + F.col("inside_")).drop("bucket_", "base_", "inside_")


def plan_pieces(lengths: DataFrame, scratch: Scratch, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """(part, pos, start, length, sequence_id, offset) from lengths (part, pos, n_tokens)."""
    spark = lengths.sparkSession
    docs = lengths.select("part", "pos", F.floor(F.col("n_tokens") / length).alias("whole"), (F.col("n_tokens") % length).alias("rest")).withColumn("class", F.ceil(F.col("rest") / grain).cast("int"))
    by_part = docs.groupBy("part", "class").agg(F.count("*").alias("n"), F.sum("rest").alias("tokens"))
    by_part = scratch.save(by_part, "histogram")
    histogram = {r["class"]: (r.n, r.tokens) for r in by_part.where("class > 0").groupBy("class").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    plan = Plan(histogram, length, grain)

    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    in_part = Window.partitionBy("part", "class").orderBy("pos")
    ranked = docs.withColumn("n", F.row_number().over(in_part) - 1).join(bases, ["part", "class"]).withColumn("rank", F.col("base") + F.col("n"))

    @F.pandas_udf("sequence long, slot long")
    def placed(classes, ranks):
        import pandas as pd

        sequence, slot = plan.place(classes.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence": sequence, "slot": slot})

    at = scratch.save(ranked.withColumn("at", placed("class", "rank")).select("part", "pos", "whole", "rest", "at.*"), "placed")

    # whole sequences
    total = at.groupBy("part").agg(F.sum("whole").alias("n"))
    cut = _running(at.where("whole > 0").select("part", "pos", "whole"), F.col("part"), ["pos"], "whole", "first")
    whole = cut.select("part", "pos", F.col("first") + plan.sequences, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
    whole = whole.toDF("part", "pos", "first", "k").select("part", "pos", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    wholes = total.agg(F.sum("n")).first()[0] or 0

    # patterns, and the gap behind each
    before = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    inside = at.where("sequence >= 0").withColumn("offset", F.coalesce(F.sum("rest").over(before), F.lit(0)))
    packed = inside.select("part", "pos", (F.col("whole") * length).alias("start"), F.col("rest").alias("length"), F.col("sequence").alias("sequence_id"), "offset")
    ends = at.where("sequence >= 0").groupBy("sequence").agg(F.sum("rest").alias("used")).withColumn("room", length - F.col("used")).where("room > 0")
    gaps = scratch.save(_running(ends, F.floor(F.col("sequence") / BUCKET), ["sequence"], "room", "at").select("sequence", F.col("used").alias("offset"), "at", "room"), "gaps")
    left = scratch.save(_running(at.where("sequence < 0 and rest > 0").select("part", "pos", "whole", "rest"), F.col("part"), ["pos"], "rest", "at"), "left")

    # what the gaps do not hold: sequences of their own, the last of powers of two
    room, tokens = gaps.agg(F.sum("room")).first()[0] or 0, left.agg(F.sum("rest")).first()[0] or 0
    more = max(0, tokens - room)
    next_id = plan.sequences + wholes
    own = spark.range(more // length).select((F.col("id") + next_id).alias("sequence"), F.lit(0).cast("long").alias("offset"), (F.col("id") * length + room).alias("at"), F.lit(length).cast("long").alias("room"))
    tail, where, number = [], room + more // length * length, next_id + more // length
    for bit in reversed(range((more % length).bit_length())):
        if more % length >> bit & 1:
            tail.append((number, 0, where, 1 << bit))
            where, number = where + (1 << bit), number + 1
    room_rows = gaps.union(own).union(spark.createDataFrame(tail, "sequence long, offset long, at long, room long"))

    def cells(rows: DataFrame, size: str) -> DataFrame:
        cell = F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col(size) - 1) / length))
        return rows.withColumn("cell", F.explode(cell))  # an interval of at most ``length`` touches two

    g = cells(room_rows, "room").select("cell", "sequence", "offset", F.col("at").alias("g0"), (F.col("at") + F.col("room")).alias("g1"))
    d = cells(left, "rest").select("cell", "part", "pos", "whole", F.col("at").alias("d0"), (F.col("at") + F.col("rest")).alias("d1"))
    low, high = F.greatest("g0", "d0"), F.least("g1", "d1")
    meet = g.join(d, "cell").where((low < high) & (F.floor(low / length) == F.col("cell")))
    filled = meet.select("part", "pos", (F.col("whole") * length + low - F.col("d0")).alias("start"), (high - low).alias("length"), F.col("sequence").alias("sequence_id"), (F.col("offset") + low - F.col("g0")).alias("offset"))
    return whole.union(packed).union(filled)


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, control_as_text: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    held, _ = encoded(docs, scratch, path, False, end_id, control_as_text)
    pieces = plan_pieces(held.select("part", "pos", "n_tokens"), scratch, length)
    of = pieces.groupBy("part", "pos").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["start", "length", "sequence_id", "offset"]
        for batch in batches:
            out = []
            for doc, blob, cut in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "pieces")), strict=True):
                ids = expand(blob).astype("<u4")
                for p in cut:
                    out.append((doc, zlib.crc32(ids[p["start"] : p["start"] + p["length"]]), len(ids), *(p[c] for c in names)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "ids_crc32", "doc_tokens", *names])

    found = held.select("part", "pos", "doc_id", "ids").join(of, ["part", "pos"]).mapInArrow(run, "doc_id long, ids_crc32 long, doc_tokens long, start long, length long, sequence_id long, offset long")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
