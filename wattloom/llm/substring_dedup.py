"""Exact removal of repeated 100-byte strings, with suffix arrays built by Lyndon grouping.

A suffix array of a whole corpus does not fit one task, and byte by byte in Python it would take
some 3 microseconds a byte. Suffixes are therefore sorted only where they decide something:

1. Each 100-byte window is owned by the least hash of the 36-byte grams in it (the leftmost on
   ties), so equal windows have equal owners at equal offsets. An owner with the bytes of all
   the windows it owns is a class; the first of equal classes stands for the others, whose
   windows all are repeats. Repeats within a batch or a task are told before anything moves,
   so a passage that a third of the corpus holds is a few rows of a shuffle.
2. Owners of one gram in different classes may still share some windows. A window at offset o
   has o bytes left of the gram and 64-o right of it, so it has 32 bytes on one side: owners go to
   the groups of their left 32 and right 32 bytes, for the windows concerned.
3. In each such group, the bytes to the right of the gram, and those to the left read
   backwards, are symbols of 16 bytes. Their suffix arrays (see suffix_array.py) and the common
   prefixes of neighbours give, for each offset, which owners share the window there; all but
   the first in the order of the corpus are repeats. A group of more than HOT owners is not held in a
   task: its owners are dealt again by each whole window, sorted, and read as a stream.

Then each document's repeats are removed in one join. Windows are judged on the input. Equality is told by
bytes in step 3; in step 1 by the gram's 64-bit hash together with a 64-bit hash of the class's
bytes, so two different classes are taken for one with a probability of 2**-64 a pair that shares its gram and
2**-128 any other pair; windows of groups over HOT by 128 bits.

Defined results: null text counts as empty; texts under 100 bytes keep everything; rows that
share a doc_id are told apart and ordered by a 64-bit hash of their texts. Rows equal in both start nowhere
earlier than each other: they are one document, and all get its result (none loses a text for the other's sake).
A null doc_id sorts first; an empty table gives no rows; other
columns pass through ``remove_repeats`` and are ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, joined, lists, load, release, trim, worker_cache
from wattloom.llm.suffix_array import suffix_array

LENGTH = 100
GRAM = 36
SIDE = LENGTH - GRAM
HALF = SIDE // 2
SYMBOL = 16
#: Repeated classes that a task remembers between batches; it forgets all beyond that.
REMEMBERED = 100_000
#: Owners in one call of the suffix sorter.
TOGETHER = 1 << 15
#: Owners of a group that one task compares; larger groups are dealt again.
HOT = 1 << 15


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    with np.errstate(over="ignore"):
        x = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mult, width, four = 0xD6E8FEB86659FD93, 1, x
        while width < 32:
            x = x[:-width] * np.uint64(mult) + (x[width:] ^ (x[width:] >> np.uint64(29)))
            mult, width = (mult * mult + 2) & (1 << 64) - 1, width * 2
            four = x if width == 4 else four
        n = len(raw) - GRAM + 1
        x = x[:n] * np.uint64(mult) + four[32 : 32 + n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def owners(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first and last start of the windows owned) of each owner in a text."""
    h = gram_hashes(raw)
    n, width = len(raw) - LENGTH + 1, 1
    least, at = h, np.arange(len(h))
    span = SIDE + 1
    while width * 2 <= span:
        later = least[width:] < least[:-width]
        least, at, width = np.where(later, least[width:], least[:-width]), np.where(later, at[width:], at[:-width]), width * 2
    d = span - width
    own = np.where(least[d : d + n] < least[:n], at[d : d + n], at[:n])
    first = np.concatenate(([0], np.nonzero(own[1:] != own[:-1])[0] + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    pos = own[first]
    return h[pos], pos, first, last


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal disjoint ones that do not touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1])) if len(start) else np.zeros(0, bool)
    return start[new], end[np.concatenate((new[1:], [True]))] if len(start) else end


def _batch(columns: dict) -> object:
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, those unlike the one before: an owner of a repeated row is no repeat of itself."""
    return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _tie() -> Column:
    return F.xxhash64(F.col("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): doc orders the corpus."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text")).withColumn("tie", _tie())


FOUND = "key long, ctx long, doc long, tie long, pos long, lo int, hi int, repeat boolean"


def _find(batches: Iterator) -> Iterator:
    """Owners of each text; repeats known already carry their interval in (pos, ctx) and a spread key."""
    import pyarrow as pa
    import xxhash

    worker_cache()
    long, int_, digest = pa.int64(), pa.int32(), xxhash.xxh3_64_intdigest
    seen: dict[tuple[int, int], tuple[int, int, int]] = {}
    for batch in batches:
        parts = []
        docs, ties = batch.column("doc").to_pylist(), batch.column("tie").to_pylist()
        for doc, tie, text in zip(docs, ties, batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            if len(text) < LENGTH:
                continue
            h, pos, first, last = owners(np.frombuffer(text, np.uint8))
            ctx = [digest(text[a:b], p - a) for a, b, p in zip(first.tolist(), (last + LENGTH).tolist(), pos.tolist(), strict=True)]
            n = len(h)
            parts.append((h.view(np.int64), np.array(ctx, np.uint64).view(np.int64), np.full(n, doc), np.full(n, tie), pos, pos - last, pos - first))
        if not parts:
            continue
        key, ctx, doc, tie, pos, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, tie, doc, ctx, key))
        key, ctx, doc, tie, pos, lo, hi = (x[order] for x in (key, ctx, doc, tie, pos, lo, hi))
        own = _distinct(key, ctx, doc, tie, pos)
        key, ctx, doc, tie, pos, lo, hi = (x[own] for x in (key, ctx, doc, tie, pos, lo, hi))
        same = (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])
        repeat = np.concatenate(([False], same))
        # classes that repeat here are remembered: later ones in this task need not move
        for i in np.nonzero(np.concatenate((same, [False])) & ~repeat)[0].tolist():
            name, here = (key[i], ctx[i]), (doc[i], tie[i], pos[i])
            if name in seen and seen[name] < here:
                repeat[i] = True
            else:
                seen[name] = here
        if len(seen) > REMEMBERED:
            seen.clear()
        go = ~repeat
        yield _batch({"key": (key[go], long), "ctx": (ctx[go], long), "doc": (doc[go], long), "tie": (tie[go], long), "pos": (pos[go], long), "lo": (lo[go], int_), "hi": (hi[go], int_), "repeat": (repeat[go], pa.bool_())})
        yield from _spread(doc[repeat], tie[repeat], pos[repeat], lo[repeat], hi[repeat])
    seen.clear()
    trim()


def _spread(doc, tie, pos, lo, hi) -> Iterator:
    """Known repeats: one row for each stretch of a document, under a key that spreads them."""
    import pyarrow as pa

    if not len(doc):
        return
    long, int_ = pa.int64(), pa.int32()
    order = np.lexsort((pos, tie, doc))
    doc, tie, start, end = doc[order], tie[order], (pos - hi)[order], (pos - lo)[order] + LENGTH
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > end[:-1])))
    at = np.nonzero(cut)[0]
    end = np.maximum.reduceat(end, at)
    doc, tie, start = doc[at], tie[at], start[at]
    with np.errstate(over="ignore"):
        key = ((doc ^ tie).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    n = len(doc)
    yield _batch({"key": (key, long), "ctx": (end, long), "doc": (doc, long), "tie": (tie, long), "pos": (start, long), "lo": (np.zeros(n, int), int_), "hi": (np.zeros(n, int), int_), "repeat": (np.ones(n, bool), pa.bool_())})


RESOLVED = "doc long, tie long, start long, stop long, key long, lo int, hi int"
ORDER = ["key", "ctx", "doc", "tie", "pos"]


def _resolved(doc, tie, start, stop, key=None, lo=None, hi=None) -> object:
    import pyarrow as pa

    long, int_ = pa.int64(), pa.int32()
    none = [None] * len(doc)
    rest = [(none if x is None else x, t) for x, t in ((stop, long), (key, long), (lo, int_), (hi, int_))]
    return _batch(dict(zip(["doc", "tie", "start", "stop", "key", "lo", "hi"], [(doc, long), (tie, long), (start, long), *rest], strict=True)))


def _resolve(batches: Iterator) -> Iterator:
    """Of owners sorted by ORDER: intervals of repeats (key null), and first owners of grams in several classes.

    A stream: from one batch to the next it keeps the last owner and the first owner of the last class.
    """
    last = pending = None
    for table in joined(batches):
        column = {c: table.column(c).to_numpy(zero_copy_only=False) for c in (*ORDER, "lo", "hi", "repeat")}
        known = np.nonzero(column["repeat"])[0]
        if len(known):
            yield _resolved(*(column[c][known] for c in ("doc", "tie", "pos", "ctx")))
        some = np.nonzero(~column["repeat"])[0]
        if not len(some):
            continue
        key, ctx, doc, tie, pos = (column[c][some] for c in ORDER)
        lo, hi = column["lo"][some], column["hi"][some]
        before = [np.concatenate((c[:1] if last is None else last[i : i + 1], c[:-1])) for i, c in enumerate((key, ctx, doc, tie, pos))]
        change = [c != b for c, b in zip((key, ctx, doc, tie, pos), before, strict=True)]
        if last is None:
            change[0][0] = True
        own, first = np.logical_or.reduce(change), change[0] | change[1]
        last = np.array([c[-1] for c in (key, ctx, doc, tie, pos)])
        rep = np.nonzero(own & ~first)[0]
        if len(rep):
            yield _resolved(doc[rep], tie[rep], pos[rep] - hi[rep], pos[rep] - lo[rep] + LENGTH)
        f = np.nonzero(first)[0]
        if not len(f):
            continue
        several = np.zeros(len(f), bool)
        same = key[f[1:]] == key[f[:-1]]
        several[1:] |= same
        several[:-1] |= same
        if pending is not None and pending[0][0] == key[f[0]]:
            several[0] = True
            if not pending[1]:
                k, d, t, p, a, b = ([x] for x in pending[0])
                yield _resolved(d, t, p, None, k, a, b)
        s = f[several]
        if len(s):
            yield _resolved(doc[s], tie[s], pos[s], None, key[s], lo[s], hi[s])
        pending = tuple(int(c[f[-1]]) for c in (key, doc, tie, pos, lo, hi)), bool(several[-1])


NEAR = "key long, doc long, tie long, pos long, lo int, hi int, left binary, right binary"


def _surroundings(batches: Iterator) -> Iterator:
    """Each first owner with the bytes around its gram, under the keys of its left and right halves."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        out: list[tuple] = []
        for doc, tie, text, owned in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "raw", "owned")), strict=True):
            for o in owned:
                pos, key, lo, hi = o["start"], o["key"].to_bytes(8, "little", signed=True), o["lo"], o["hi"]
                left, right = text[max(0, pos - SIDE) : pos][::-1], text[pos + GRAM : pos + LENGTH]
                if hi >= HALF:
                    name = _signed(xxhash.xxh3_64_digest(b"L" + key + left[:HALF]))
                    out.append((name, doc, tie, pos, max(lo, HALF), hi, left, right))
                if lo < HALF:
                    name = _signed(xxhash.xxh3_64_digest(b"R" + key + right[:HALF]))
                    out.append((name, doc, tie, pos, lo, min(hi, HALF - 1), left, right))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            names = ["key", "doc", "tie", "pos", "lo", "hi", "left", "right"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _padded(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t.ljust(SIDE, b"\0") for t in texts), np.uint8).reshape(-1, SIDE)


def sorted_sides(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of owners by (group, bytes), and the bytes that each has in common with the one before it; -1 between groups.

    The text to sort is each owner's group and its bytes in symbols of SYMBOL bytes, named in order.
    """
    n, per = len(group), SIDE // SYMBOL
    words = np.ascontiguousarray(side).view(">u8").reshape(n * per, SYMBOL // 8)
    by = np.lexsort((words[:, 1], words[:, 0]))
    changed = np.concatenate(([False], (words[by[1:]] != words[by[:-1]]).any(axis=1)))
    names = np.empty(n * per, np.int64)
    names[by] = np.cumsum(changed)
    text = np.empty((n, per + 1), np.int64)
    text[:, 1:] = names.reshape(n, per)
    text[:, 0] = group + int(names.max(initial=0)) + 1  # group names above all others begin no symbol's suffix
    starts = np.array(suffix_array(text.ravel().tolist()), np.int64)
    order = starts[starts % (per + 1) == 0] // (per + 1)
    other = side[order[1:]] != side[order[:-1]]
    common = np.where(other.any(axis=1), other.argmax(axis=1), SIDE)
    common = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, np.concatenate(([-1], common))


def repeated_windows(group, rank, lo, hi, left, right) -> np.ndarray:
    """owners x offsets: whether the window there repeats that of an owner of lower rank in the group."""
    n = len(group)
    r_order, r_common = sorted_sides(group, right)
    l_order, l_common = sorted_sides(group, left)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    out = np.zeros((n, SIDE + 1), bool)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        here = np.nonzero((lo <= o) & (o <= hi))[0]
        if len(here) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < SIDE - o)
        l_class[l_order] = np.cumsum(l_common < o)
        window = r_class[here] * (n + 1) + l_class[here]
        order = np.lexsort((rank[here], window))
        sorted_ = window[order]
        out[here[order[1:]][sorted_[1:] == sorted_[:-1]], o] = True
    return out


COMPARED = RESOLVED + ", left binary, right binary"


def _compare(batches: Iterator, hot: int = HOT) -> Iterator:
    """Intervals of windows that repeat, of owners sorted by key; owners of groups over ``hot`` as they came (stop null)."""
    import pyarrow as pa

    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 2
    names = ["doc", "tie", "start", "stop", "key", "lo", "hi", "left", "right"]
    out = lambda values: pa.RecordBatch.from_arrays([pa.nulls(len(values[0]), k) if v is None else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)
    for table, long in lists(batches, "key", hot, least=min(hot, TOGETHER)):
        key, doc, tie, pos, lo, hi = (table.column(c).to_numpy() for c in ("key", "doc", "tie", "pos", "lo", "hi"))
        if long:
            yield out([doc, tie, pos, None, key, lo, hi, table.column("left").to_pylist(), table.column("right").to_pylist()])
            continue
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] = same
        twice[:-1] |= same
        if not twice.any():
            continue
        key, doc, tie, pos, lo, hi = (x[twice] for x in (key, doc, tie, pos, lo, hi))
        table = table.filter(pa.array(twice)).combine_chunks()
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((pos, tie, doc))] = np.arange(len(key))
        group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        left, right = (_padded(table.column(c).to_pylist()) for c in ("left", "right"))
        repeat = repeated_windows(group, rank, lo, hi, left, right)
        # offsets run against starts: a run of offsets a..b covers pos-b .. pos-a+LENGTH
        edge = np.diff(np.pad(repeat.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1] - 1
        yield out([doc[row], tie[row], pos[row] - b, pos[row] - a + LENGTH, *[None] * 5])


WINDOWS = "key long, ctx long, doc long, tie long, pos long"


def _windows(batches: Iterator) -> Iterator:
    """Each window of owners in large groups, by 128 bits of its bytes; pos is where the window starts."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        rows: list[tuple] = []
        for doc, tie, pos, key, lo, hi, left, right in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "start", "key", "lo", "hi", "left", "right")), strict=True):
            head = key.to_bytes(8, "little", signed=True)
            for o in range(lo, hi + 1):
                name = xxhash.xxh3_128_digest(head + left[:o] + b"|" + right[: SIDE - o], o)
                rows.append((_signed(name[:8]), _signed(name[8:]), doc, tie, pos - o))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ORDER)


def _later(batches: Iterator) -> Iterator:
    """Of windows sorted by ORDER, all but the first of each."""
    last = None
    for table in joined(batches):
        key, ctx, doc, tie, pos = columns = [table.column(c).to_numpy() for c in ORDER]
        before = [np.concatenate((c[:1] if last is None else last[i : i + 1], c[:-1])) for i, c in enumerate(columns)]
        change = [c != b for c, b in zip(columns, before, strict=True)]
        if last is None:
            change[0][0] = True
        last = np.array([c[-1] for c in columns])
        rep = np.nonzero(~(change[0] | change[1]) & np.logical_or.reduce(change))[0]
        if len(rep):
            yield _resolved(doc[rep], tie[rep], pos[rep], pos[rep] + LENGTH)


def repeats(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(doc, tie, spans array<struct<start, stop>>) of documents with repeated windows; spans may overlap."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    found = keyed.mapInArrow(_find, FOUND).repartition("key").sortWithinPartitions(*ORDER)
    resolved = scratch.save(found.mapInArrow(_resolve, RESOLVED), "resolved")
    release(spark)
    owned = resolved.where("key is not null").groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "start", "lo", "hi")).alias("owned"))
    texts = keyed.select("doc", "tie", F.col("text").cast("binary").alias("raw"))
    near = texts.join(owned, ["doc", "tie"]).dropDuplicates(["doc", "tie"]).mapInArrow(_surroundings, NEAR)
    compared = scratch.save(near.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _compare(batches, hot), COMPARED), "compared")
    release(spark)
    spans = resolved.where("key is null").select("doc", "tie", "start", "stop").union(compared.where("stop is not null").select("doc", "tie", "start", "stop"))
    large = compared.where("stop is null")
    if large.limit(1).count():
        windows = large.mapInArrow(_windows, WINDOWS).repartition("key").sortWithinPartitions(*ORDER)
        spans = spans.union(scratch.save(windows.mapInArrow(_later, RESOLVED), "later").select("doc", "tie", "start", "stop"))
    return spans.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _removal(spans, size: int) -> list[tuple[int, int]]:
    if not spans:
        return []
    start, stop = _merged(np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans]))
    return list(zip(start.tolist(), stop.tolist(), strict=True))


def _with_spans(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """Rows of docs as a struct ``row``, with ``raw`` bytes and ``spans``."""
    found = repeats(docs, scratch, hot)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text")).withColumn("tie", _tie())
    return rows.select("row", "doc", "tie", "text").join(found, ["doc", "tie"], "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes taken out of ``text`` (a character cut in part goes whole).

    A null text stays null; n_chars, where there is one, follows the text.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, s in zip(texts, spans, strict=True):
            if s is None:
                out.append(text)
                continue
            raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for a, b in _removal(list(s), len(raw)):
                kept.append(raw[at:a].decode(errors="ignore"))
                at = b
            out.append("".join(kept) + raw[at:].decode(errors="ignore"))
        return pd.Series(out, dtype=object)

    rows = _with_spans(docs, Scratch(docs.sparkSession, "repeats"))
    done = rows.select("row", F.when(F.col("row.text").isNotNull(), F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))).alias("cut_text"))
    new = {"text": F.col("cut_text"), "n_chars": F.length("cut_text").cast("long")}
    return done.select(*[new.get(c, F.col("row")[c]).cast(t).alias(c) if c in new else F.col("row")[c].alias(c) for c, t in docs.dtypes])


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                at, digest = 0, hashlib.sha256()
                found = _removal(spans, len(text))
                for a, b in found:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out.append((len(text), sum(b - a for a, b in found), len(found), digest.hexdigest()))
            n, removed, count, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long"), "text"), Scratch(docs.sparkSession, "repeats"), hot)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("row.doc_id", "text", "spans").mapInArrow(run, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents"))
