"""SimHash near-duplicates: an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight
bytes, so they share at least six positional bytes. A posting list per single byte would hold
1/256 of all fingerprints, and tallying its pairs would grow with the square of the corpus. The
index therefore keys its lists by four positional bytes at once: of four pairs of positions two differing
bytes leave two pairs alone, so six keys a fingerprint (the choices of two pairs) bring every such
pair of fingerprints together. Within a list the shared positional bytes of each pair are tallied, pairs
below the guaranteed six go, and the others are verified by Hamming distance. A list emits the
links of a spanning forest, never all pairs.

A list longer than LONG is not held: its rows are dealt again under each choice of two of the four
positions that the key leaves open. What meets then shares six positional bytes (the tally is the key), differs in
two bytes only, and so has at most 65,536 entries whatever the corpus is; there, neighbours are looked up by
their few differing bits.

**Similarity of shingles.** ``similar`` groups documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. SimHash cannot bring those together: at 0.8 two fingerprints differ in some 10 of 64 bits,
so no positional byte is sure to be shared, and even a key of three bytes out of a longer fingerprint would be shared by 2 %
of such pairs. There, a position's byte comes from the least of the shingles' hashes under the position's own
order instead, so that two documents share a position as often as their similarity says. The rest is the same
index: lists by five positional bytes (BANDS of them), shared positions tallied per pair within a list, pairs
below the count that all but 0.3 % of pairs at the threshold reach dropped, and the others verified by their whole shingle sets. A list
emits its maximum spanning forest by tally, never all pairs.

Defined results: null and empty texts and texts without a word have fingerprint zero and link
like any other; a text of one or two words is one shingle; repeated rows share a fingerprint;
a null doc_id takes part but never is the smallest id; an empty table gives no rows; other
columns of the input are ignored, so their names cannot clash. ``similar`` has the same results but
for texts without a word: these are similar to each other only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, batches_of_runs, connected_components, joined, lists, load, trim, worker_cache

SHINGLE = 3
SEED = 42
BITS = 2
#: The bits of each byte value, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: The lists' keys: each choice of two of the four pairs of byte positions.
PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
CHOICES = [a + b for a, b in itertools.combinations(PAIRS, 2)]
#: Fingerprints of a list that are tallied in one task.
LONG = 2048


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text, unsigned."""
    import xxhash

    words = text.lower().split()  # bytes: only A-Z change, and words end at 20 and 09-0D
    if not words:
        return 0
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= 1:
        return int.from_bytes(digest(joined, seed))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    counts = np.zeros((8, 256), np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        part = rows[at : at + (1 << 16)]
        counts += np.bincount((part + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((counts @ _BITS * 2 > n).ravel()).tobytes())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long. Narrow: no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_cache()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            prints = np.array([simhash(t or b"", shingle, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair shares."""
    other = a ^ b
    return (other.view(np.uint8).reshape(*other.shape, 8) == 0).sum(axis=-1)


def tallied(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a list that share the guaranteed number of positional bytes and are within ``bits`` bits."""
    found = []
    for at in range(0, len(prints), 256):
        rows = prints[at : at + 256]
        enough = shared_bytes(np.broadcast_to(rows[:, None], (len(rows), len(prints))).copy(), prints) >= 8 - bits
        i, j = np.nonzero(enough)
        keep = (i + at < j) & (np.bitwise_count(rows[i] ^ prints[j]) <= bits)
        found.append((i[keep] + at, j[keep]))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def looked_up(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs of sorted distinct fingerprints that differ in few places, by each set of differing bits."""
    spread = int(np.bitwise_or.reduce(prints ^ prints[0]))
    places = [1 << i for i in range(64) if spread >> i & 1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for mask in [sum(c) for k in range(1, bits + 1) for c in itertools.combinations(places, k)]:
        other = prints ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
        i = np.nonzero((prints[at] == other) & (prints < other))[0]
        found.append((i, at[i]))
    a, b = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n nodes and links (a, b): each node but the least of a component, and that least one."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    i = np.nonzero(root != np.arange(n))[0]
    return i, root[i]


def _key(number: int, positions: tuple[int, ...]) -> Column:
    """A list's key: the bytes at these positions, and which choice it is."""
    out = F.lit(number).cast("long")
    for i in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(F.lit(255)))
    return out


def links(prints: DataFrame, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """(a, b) that connect all fingerprints (fp, distinct longs) within ``bits`` bits (2 at most).

    One shuffle of six rows of 16 bytes a fingerprint; output at most linear in it.
    """
    if bits > 2:
        raise ValueError("four pairs of positions leave two alone for two differing bytes only")
    keys = F.array(*[_key(k, c) for k, c in enumerate(CHOICES)])
    dealt = prints.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")

    def emit(fp: np.ndarray, found):
        import pyarrow as pa

        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "choice"])

    def tally(batches: Iterator) -> Iterator:
        """Links of short lists (choice null); rows of long ones (b null)."""
        import pyarrow as pa

        for table, long in lists(batches, "key", LONG):
            key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(key >> 32)], ["a", "b", "choice"])
                continue
            cut = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            one, other = fp[two], fp[two + 1]
            ok = shared_bytes(one, other) >= 8 - bits
            ok &= np.bitwise_count(one ^ other) <= bits
            found = [(one[ok], other[ok])]
            for at, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
                own = fp[at : at + n]
                i, j = _forest(n, *tallied(own, bits))
                found.append((own[i], own[j]))
            yield emit(fp, found)

    def look_up(batches: Iterator) -> Iterator:
        for table in batches_of_runs(batches, "key"):
            key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            cut = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))
            found = [(fp[:0], fp[:0])]
            for at, end in zip(cut[:-1], cut[1:], strict=True):
                if end - at > 1:
                    own = np.sort(fp[at:end])
                    i, j = _forest(len(own), *looked_up(own, bits))
                    found.append((own[i], own[j]))
            yield emit(fp, found)

    schema = "a long, b long, choice long"
    short = scratch.save(dealt.mapInArrow(tally, schema), "tallied")
    found = short.where("b is not null").select("a", "b")
    long = short.where("b is null").select(F.col("a").alias("fp"), "choice")
    if not long.limit(1).count():
        return found
    finer = []
    for k, held in enumerate(CHOICES):
        rest = [i for i in range(8) if i not in held]
        subs = [_key(0, held + c) for c in itertools.combinations(rest, 2)]
        finer.append(F.when(F.col("choice") == k, F.array(*subs)))
    again = long.select("fp", F.posexplode(F.coalesce(*finer)).alias("n", "bytes"), "choice").select("fp", (F.shiftleft(F.col("choice") * 6 + F.col("n"), 48).bitwiseOR(F.col("bytes"))).alias("key"))
    return found.unionByName(again.repartition("key").sortWithinPartitions("key").mapInArrow(look_up, schema).select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, fp (long), fingerprint (hex), component_id (smallest linked doc_id)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(scratch, links(distinct.select("fp"), scratch, bits)).withColumnsRenamed({"node": "fp"})
    placed = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.save(placed.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Positional bytes of a list's key in ``similar``, and lists a document is in.
WIDTH, BANDS = 5, 24
#: Positions that a pair's tally counts: those of the keys, and as many again, so that fewer pairs reach its bound by chance.
TALLIED = 2 * WIDTH * BANDS
#: Documents of a block: longer lists are compared by blocks.
TOGETHER = 1024
#: Pairs of two groups that a block emits at first; a group of pairs that was cut short comes back with eight times as many.
PAIRS_AT_ONCE = 64
#: A pair at the threshold falls below the tally's bound by so many standard deviations at most, but for 0.3 %.
SLACK = 2.75
_rng = np.random.default_rng(10)
_TIMES, _XOR = _rng.integers(0, 1 << 63, (2, TALLIED, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int = 5, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one, as is one without a word."""
    import xxhash

    own = text.lower().split()
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(own[i : i + words]), seed) for i in range(max(1, len(own) - words + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def positions(shingles: np.ndarray) -> np.ndarray:
    """A byte a position: from the least hash under the position's order."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[at : at + 1024] ^ _XOR) * _TIMES).min(axis=1), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def spanning(sketch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a maximum spanning forest of the pairs that share ``least`` positions or more (Prim's)."""
    n = len(sketch)
    best, of = np.zeros(n, np.int16), np.zeros(n, np.int64)
    out, rest = [], np.arange(1, n)
    at = 0
    while len(rest):
        shared = (sketch[rest] == sketch[at]).sum(axis=1, dtype=np.int16)
        more = shared > best[rest]
        best[rest[more]], of[rest[more]] = shared[more], at
        k = int(best[rest].argmax())
        at = int(rest[k])
        if best[at] >= least:
            out.append((int(of[at]), at))
        rest = np.delete(rest, k)
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return i, j


def first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key that each pair shares; BANDS if it shares none."""
    same = (a[:, : WIDTH * BANDS] == b[:, : WIDTH * BANDS]).reshape(len(a), BANDS, WIDTH).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), BANDS)


def crossing(sketch: np.ndarray, group: np.ndarray, least: int, most: int, band: int | None = None, skip: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (i, j) of different groups that share ``least`` positions: of each two groups the ``most`` with the highest tally.

    Also whether there were more. Rows of the most common group are compared with others only. A pair counts in the list of the
    first key that it shares (``band``), so that it comes once however many lists hold it; of each two groups, ``skip`` pairs were
    had before.
    """
    names, own, size = np.unique(group, return_inverse=True, return_counts=True)
    rest = np.nonzero(own != size.argmax())[0]
    found = []
    for at in range(0, len(rest), 64):
        rows = rest[at : at + 64]
        shared = (sketch[rows, None] == sketch).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(shared >= least)
        tally, i = shared[i, j], rows[i]
        ok = (own[i] != own[j]) & ((i < j) | (own[j] == size.argmax()))
        if band is not None:
            ok[ok] = first_band(sketch[i[ok]], sketch[j[ok]]) == band
        found.append((i[ok], j[ok], tally[ok]))
    i, j, tally = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    two = np.minimum(own[i], own[j]) * len(names) + np.maximum(own[i], own[j])
    order = np.lexsort((j, i, -tally, two))
    first = np.nonzero(np.concatenate(([True], two[order][1:] != two[order][:-1])))[0] if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    keep = order[(place >= skip) & (place < most)]
    return i[keep], j[keep], bool((place >= most).any())


PART = ["key", "p", "q"]


def _first_parts(shared: DataFrame) -> DataFrame:
    """Lists as (key, p, q, gid): long ones in blocks that are not compared with each other yet."""
    long = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER).select("key", F.ceil(F.col("n") / TOGETHER).alias("blocks"))
    block = F.coalesce(F.pmod(F.xxhash64("key", "gid"), F.col("blocks")), F.lit(0)).cast("int")
    return shared.join(long, "key", "left").select("key", "band", block.alias("p"), F.lit(0).alias("q"), "gid", F.col("gid").alias("group"))


def _later_parts(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists that still hold two groups or more, as (key, p, q, gid, group); in a part of a long list, one block meets another.

    The largest group of a long list has blocks of its own, which meet the blocks of the others but not each other: a cloud of
    copies that is one group by now is not compared with itself again.
    """
    rows = shared.join(groups, "gid", "left").select("key", "band", "gid", F.coalesce("group", "gid").alias("group"))
    sizes = rows.groupBy("key", "group").agg(F.count("*").alias("n"))
    lists_ = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("top")).where("groups > 1")
    lists_ = lists_.select("key", "n", F.col("top.group").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / TOGETHER).alias("others"), F.ceil(F.col("top.n") / TOGETHER).alias("tops"))
    rows = rows.join(lists_, "key")
    hashed = lambda n: F.pmod(F.xxhash64("key", "gid"), F.col(n))
    row = lambda p, q: F.struct(F.least(p, q).cast("int").alias("p"), F.greatest(p, q).cast("int").alias("q"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    of_other = F.transform(upto(F.col("others") + F.col("tops")), lambda k: row(hashed("others"), k))
    of_top = F.transform(upto(F.col("others")), lambda k: row(F.col("others") + hashed("tops"), k))
    parts = F.when(F.col("n") <= TOGETHER, F.array(row(F.lit(0), F.lit(0)))).when(F.col("group") == F.col("top"), of_top).otherwise(of_other)
    return rows.select("key", "band", F.inline(parts), "gid", "group")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, component_id (smallest doc_id reachable by pairs of at least this Jaccard similarity).

    Pairs are candidates if they meet in a list and share enough positions, which a pair at the threshold fails in some 0.3 %
    of cases. In a first round each block of a list emits a spanning forest of its candidates; these are
    verified on whole sets, and what holds makes groups. Only lists that still hold more than one group
    come back, and there every candidate between two groups is verified, best first, until none is left: a pair that fails
    never stands in for one that would hold.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    size = TALLIED
    least = int(np.floor(size * similarity - SLACK * np.sqrt(size * similarity * (1 - similarity))))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})

    def sketches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        worker_cache()
        for batch in batches:
            sets = [shingle_set(t, words, seed) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            columns = [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array([len(x) for x in sets], pa.int64()), pa.array([positions(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "shingles", "sketch"])
        trim()

    rows = scratch.save(keyed.mapInArrow(sketches, "doc_id long, k1 long, k2 long, shingles long, sketch binary"), "sketches")
    texts = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles"))  # equal texts are one
    texts = scratch.save(texts.withColumn("gid", F.monotonically_increasing_id()), "texts")
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", b * WIDTH + 1, WIDTH)) for b in range(BANDS)])

    def met(batches: Iterator) -> Iterator:
        """Rows of lists of two or more, of rows sorted by key: a stream."""
        import pyarrow as pa

        last = before = None  # the row before, if it has not been passed on, and its key
        for table in joined(batches):
            key = table.column("key").to_numpy()
            as_before = np.concatenate(([before is not None and key[0] == before], key[1:] == key[:-1]))
            keep = as_before.copy()
            keep[:-1] |= as_before[1:]
            if as_before[0] and last is not None:
                yield last
            if keep.any():
                yield from table.filter(pa.array(keep)).to_batches()
            before = key[-1]
            last = None if keep[-1] else table.slice(len(key) - 1).to_batches()[0]

    dealt = texts.select(F.posexplode(keys).alias("band", "key"), "gid").select("key", "band", "gid").repartition("key").sortWithinPartitions("key")
    shared = scratch.save(dealt.mapInArrow(met, "key long, band int, gid long"), "met")

    def candidates(parts: DataFrame, most: int, skip: int) -> DataFrame:
        """(a, b) of all parts: a forest each if ``most`` is 0; a row of nulls where there are more."""

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for table, _ in lists(batches, "part", 1 << 20):
                part, band, gid, group = (table.column(c).to_numpy() for c in ("part", "band", "gid", "group"))
                sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(part), size)
                cut = np.concatenate(([0], np.nonzero(part[1:] != part[:-1])[0] + 1, [len(part)]))
                a, b, more = [], [], False
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    if most:
                        i, j, cut_short = crossing(sketch[x:y], group[x:y], least, most, int(band[x]), skip)
                        more |= cut_short
                    else:
                        i, j = spanning(sketch[x:y], least)
                    a.append(gid[x:y][i])
                    b.append(gid[x:y][j])
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                if more:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["a", "b"])

        listed = parts.join(texts.select("gid", "sketch"), "gid").select(F.xxhash64(*PART).alias("part"), "band", "gid", "group", "sketch")
        return listed.repartition("part").sortWithinPartitions("part", "gid").mapInArrow(run, "a long, b long").distinct()

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [shingle_set(t, words, seed).tobytes() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("gid"), pa.array(found, pa.binary())], ["gid", "shingles"])

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                ok.append(both >= similarity * (len(one) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = spark.createDataFrame([], "gid long, shingles binary")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar; sets are made once for each text that takes part."""
        nonlocal held
        ends = pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct().join(held, "gid", "left_anti")
        wanted = texts.join(ends, "gid").select("gid", "k1", "k2", "least")
        # of equal texts the one with the least id gives the shingles; of rows equal in that, too, any
        own = keyed.join(wanted, (keyed.k1 == wanted.k1) & (keyed.k2 == wanted.k2) & keyed.doc_id.eqNullSafe(wanted.least)).select("gid", "text").dropDuplicates(["gid"])
        held = held.unionByName(scratch.save(own.mapInArrow(sets, "gid long, shingles binary"), "sets"))
        both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return scratch.save(both.mapInArrow(verify, "a long, b long"), "links")

    sizes = texts.select("gid", "shingles")
    near = F.least("one", "other") >= similarity * F.greatest("one", "other") - 1e-9  # else no overlap is enough
    tested, groups, most, skip = None, None, 0, 0
    while True:
        parts = _first_parts(shared) if groups is None else _later_parts(shared, groups)
        found = scratch.save(candidates(parts, most, skip), "candidates")
        pairs = found.where("a is not null").join(sizes.toDF("a", "one"), "a").join(sizes.toDF("b", "other"), "b").where(near).select("a", "b")
        pairs = scratch.save(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links_ = verified(pairs)
        linked = bool(links_.limit(1).count())
        if groups is None:
            groups = connected_components(scratch, links_).withColumnsRenamed({"node": "gid", "root": "group"})
        elif linked:
            of = lambda end: groups.select(F.col("gid").alias(end), F.col("group").alias(f"g_{end}"))  # noqa: B023, E731
            joined_ = links_.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b"))
            roots = connected_components(scratch, joined_).withColumnsRenamed({"node": "group", "root": "top"})
            known = groups.select("gid", "group").unionByName(roots.join(groups.select("gid"), F.col("group") == F.col("gid"), "left_anti").select(F.col("group").alias("gid"), "group"))
            groups = scratch.save(known.join(roots, "group", "left").select("gid", F.coalesce("top", "group").alias("group")), "groups")
        if most and not found.where("a is null").limit(1).count():
            break
        skip = 0 if linked else most  # between the same groups, the best ``most`` pairs were these
        most = most * 8 or PAIRS_AT_ONCE
    placed = texts.select("gid", "k1", "k2", "least").join(groups, "gid", "left").withColumn("root", F.coalesce("group", "gid"))
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.save(placed.join(first, "root").select("k1", "k2", "component_id"), "components")
    return rows.select("doc_id", "k1", "k2").join(of, ["k1", "k2"]).select("doc_id", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
