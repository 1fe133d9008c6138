"""Line dedup that can be taken back: sharded cuckoo filters before exact reference-count tables.

An index holds three tables. ``refs`` has a row a line (its key, document and place). ``counts`` has a row a
key: how many lines hold it, and the least and greatest document. ``filters`` has a row a shard of keys: a cuckoo filter
with one copy of a key's fingerprint if one document holds it, two if more do. A shard holds some SHARD_KEYS
keys, each once, so no task gets more however often a line occurs.

A filter never denies a key that is there. Keys of a new batch that it does not know need no look at ``counts``;
lines with less than two copies are in one document and stay. What it lets through is looked up exactly, so false hits cost a
look-up and change nothing. Keys that hold a thousandth of all lines or more (a thousand at most) go to every task
instead; what is left has no hot key. Deleting documents takes their lines out of ``refs``, counts the keys
they held anew and takes copies out of the filters: the state is then that of never having had them.

Changed counts are appended as a generation; a key's newest row counts. A filter that is full is built again, twice as wide,
from ``counts``. Keys are told apart by 128 bits of XXH3: two different ones are taken for equal with a probability of 2^-128 a pair.

Defined results: a null or empty text is one empty line, which has no key and stays; a null doc_id counts as one
document after all others; rows of one doc_id are one document, so their lines never count against each other, and repeated
rows all lose or keep the same lines; keys under ten code points always stay; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, joined, load

LEAST_POINTS = 10
#: Keys of a shard, on average, when filters are built.
SHARD_KEYS = 1 << 16
SLOTS = 4
#: Rounds of evictions before a filter counts as full.
ROUNDS = 500
#: A key with this share of all lines goes to every task.
SHARE = 1000
#: Generations of counts before they are put together.
GENERATIONS = 8
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1
KEY = ["k1", "k2"]
REFS = "doc_id long, text_hash long, pos long, k1 long, k2 long"
FILTERS = "shard long, filter binary"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; keys are arrays (k1, k2) of unsigned 64-bit integers."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = np.int64(buckets - 1)
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray, copies: np.ndarray) -> Cuckoo:
        """A filter with so many copies of each key, as narrow as they fit."""
        total = int(copies.sum())
        buckets = 1 << max(1, int(np.ceil(total / SLOTS / 0.9)) - 1).bit_length()
        while True:
            out = cls(buckets)
            if out.insert(np.repeat(k1, copies), np.repeat(k2, copies)):
                return out
            buckets *= 2

    @classmethod
    def load(cls, blob: bytes) -> Cuckoo:
        table = np.frombuffer(blob, "<u2").reshape(-1, SLOTS)
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A first bucket and a fingerprint, never 0, of each key."""
        # the shard is k1's remainder: its high half says where in the shard
        return (k1 >> np.uint64(32)).astype(np.int64) & self.mask, (k2 % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint, from either."""
        return at ^ (print_.astype(np.int64) * 0x5BD1E995 & self.mask)

    def _place(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of these buckets, side by side; which ones found one."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        first = np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[0]
        rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        free = np.cumsum(self.table[bucket] == 0, axis=1)
        found = free[:, -1] > rank
        slot = np.argmax(free == rank[:, None] + 1, axis=1)
        self.table[bucket[found], slot[found]] = print_[order][found]
        out = np.zeros(len(at), bool)
        out[order[found]] = True
        return out

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Adds one copy of each; False if the filter is full, which then must be built again."""
        if not len(k1):
            return True
        self.table = self.table if self.table.flags.writeable else self.table.copy()
        at, print_ = self._places(k1, k2)
        rest = ~self._place(at, print_)
        at, print_ = self._other(at[rest], print_[rest]), print_[rest]
        for n in range(ROUNDS):
            if not len(at):
                return True
            rest = ~self._place(at, print_)
            at, print_ = at[rest], print_[rest]
            # in each full bucket, the first that waits there takes a slot and its owner goes to its other bucket
            one = np.unique(at, return_index=True)[1]
            slot = (print_[one].astype(np.int64) + n) % SLOTS
            evicted = self.table[at[one], slot]
            self.table[at[one], slot] = print_[one]
            print_[one], at[one] = evicted, self._other(at[one], evicted)
        return not len(at)

    def count(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Copies of each key: never fewer than were added."""
        at, print_ = self._places(k1, k2)
        other = self._other(at, print_)
        here, there = ((self.table[i] == print_[:, None]).sum(axis=1) for i in (at, other))
        return here + np.where(at == other, 0, there)

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes one copy of each key out; only keys that were added."""
        self.table = self.table if self.table.flags.writeable else self.table.copy()
        at, print_ = self._places(k1, k2)
        at = np.minimum(at, self._other(at, print_))  # equal entries of one pair of buckets stand for each other
        while len(at):
            now = np.unique(at << 16 | print_, return_index=True)[1]
            for first in (True, False):
                bucket = at[now] if first else self._other(at[now], print_[now])
                same = self.table[bucket] == print_[now, None]
                hit = same.any(axis=1)
                self.table[bucket[hit], same.argmax(axis=1)[hit]] = 0
                now = now[~hit]
            if len(now):
                raise ValueError("a key to remove was never added")
            rest = np.ones(len(at), bool)
            rest[np.unique(at << 16 | print_, return_index=True)[1]] = False
            at, print_ = at[rest], print_[rest]


def line_keys(text: str) -> list[bytes]:
    """Each line's key: stripped of blanks, A-Z in lower case."""
    return [line.strip() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def long_enough(key: bytes) -> bool:
    """Whether a key has ten code points, of one to four bytes each."""
    n = len(key)
    return n >= 4 * LEAST_POINTS or n >= LEAST_POINTS and sum(byte & 0xC0 != 0x80 for byte in key) >= LEAST_POINTS


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({"own_id": F.coalesce("doc_id", F.lit(NO_ID)), "text_hash": F.xxhash64("text")})


def references(docs: DataFrame) -> DataFrame:
    """A row a line that has a key: REFS. Narrow: no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, places, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                keys = [(n, k) for n, k in enumerate(line_keys(text)) if long_enough(k)]
                hashes += [digest(k) for _, k in keys]
                places += [n for n, _ in keys]
                sizes.append(len(keys))
            own = np.repeat(np.arange(len(sizes)), sizes)
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            columns = [pa.array(batch.column(c).to_numpy()[own]) for c in ("own_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "text_hash", "pos", *KEY])

    return _rows(docs).drop("doc_id").mapInArrow(run, REFS)


def counted(refs: DataFrame) -> DataFrame:
    """The exact table of keys; Spark adds up before it shuffles."""
    return refs.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))


def _copies(prefix: str = "") -> Column:
    n, least, greatest = (F.col(prefix + c) for c in ("n", "least", "greatest"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(least == greatest, 1).otherwise(2)


def _keys(table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().view(np.uint64) for c in KEY)


class LineIndex:
    """The index after some insertions and deletions. Each of these returns a new one; tables that it shares with others stay."""

    def __init__(self, scratch: Scratch, refs: DataFrame | None = None, counts: list[DataFrame] = (), filters: DataFrame | None = None, shards: int = 0):
        self.scratch, self.refs, self.counts, self.filters, self.shards = scratch, refs, list(counts), filters, shards

    def current(self, among: DataFrame | None = None) -> DataFrame:
        """The newest counts of all keys, or of those of ``among`` (distinct keys)."""
        parts = [c.withColumn("age", F.lit(i)) for i, c in enumerate(self.counts)]
        if among is not None:
            parts = [p.join(among, KEY, "left_semi") for p in parts]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        if len(parts) > 1:
            both = both.groupBy(*KEY).agg(F.max_by(F.struct("n", "least", "greatest"), "age").alias("now")).select(*KEY, "now.*")
        return both.where("n > 0").select(*KEY, "n", "least", "greatest")

    def _shard(self, shards: int) -> Column:
        return F.pmod("k1", F.lit(shards)).alias("shard")

    def _built(self, counts: DataFrame, shards: int) -> DataFrame:
        """Filters of these keys, by shard."""

        def build(table):
            import pyarrow as pa

            copies = table.column("copies").to_numpy()
            return pa.table({"shard": table.column("shard")[:1], "filter": pa.array([Cuckoo.of(*_keys(table), copies).dump()], pa.binary())})

        rows = counts.select(self._shard(shards), *KEY, _copies().alias("copies"))
        return rows.groupBy("shard").applyInArrow(build, FILTERS)

    def probe(self, rows: DataFrame, least: int) -> DataFrame:
        """The rows (with k1, k2) whose keys have so many copies in their shard's filter, and a few false hits: a stream by shard."""
        own = rows.select(self._shard(self.shards), "*")
        names = rows.columns

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            shard, found = None, None
            for table in joined(batches):
                table = table.to_batches()[0]
                marks = np.nonzero(table.column("filter").is_valid().to_numpy(zero_copy_only=False))[0].tolist()
                keep = np.zeros(table.num_rows, bool)
                k1, k2 = (table.column(c).fill_null(0).to_numpy().view(np.uint64) for c in KEY)
                shards = table.column("shard").to_numpy()
                for a, b in zip([-1, *marks], [*marks, table.num_rows], strict=True):
                    if a >= 0:  # a filter stands before its shard's keys
                        shard, found = shards[a], Cuckoo.load(table.column("filter")[a].as_py())
                    own = slice(a + 1, b)
                    if found is not None:
                        keep[own] = (found.count(k1[own], k2[own]) >= least) & (shards[own] == shard)
                yield table.select(names).filter(pa.array(keep))

        dealt = self.filters.unionByName(own, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull())
        return dealt.mapInArrow(run, rows.schema)

    def _changed(self, refs: DataFrame, changes: DataFrame) -> LineIndex:
        """After ``changes``: written rows (k1, k2, n, least, greatest, was), was being the copies before."""
        counts = [*self.counts, changes.select(*KEY, "n", "least", "greatest")]
        now = LineIndex(self.scratch, refs, counts, self.filters, self.shards)
        if len(counts) > GENERATIONS:
            now.counts = [self.scratch.save(now.current(), "counts")]
            now.refs = self.scratch.save(refs, "refs")

        def update(key, table, held):
            import pyarrow as pa

            own = Cuckoo.load(held.column("filter")[0].as_py()) if held.num_rows else Cuckoo(2)
            k1, k2 = _keys(table)
            more = table.column("copies").to_numpy() - table.column("was").to_numpy()
            own.remove(np.repeat(k1, np.maximum(-more, 0)), np.repeat(k2, np.maximum(-more, 0)))
            fits = own.insert(np.repeat(k1, np.maximum(more, 0)), np.repeat(k2, np.maximum(more, 0)))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([own.dump() if fits else None], pa.binary())})

        moved = changes.select(self._shard(self.shards), *KEY, _copies().alias("copies"), "was")
        new = self.scratch.save(moved.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(update, FILTERS), "updated")
        full = new.where("filter is null").select("shard")
        again = self._built(now.current().join(full, self._shard(self.shards) == F.col("shard"), "left_semi"), self.shards)
        now.filters = self.scratch.save(new.where("filter is not null").unionByName(again), "filters")
        return now.resharded()

    def resharded(self) -> LineIndex:
        """With more shards, once they hold four times the keys that they were made for."""
        keys = self.current().count()
        if keys > 4 * SHARD_KEYS * self.shards:
            self.shards = -(-keys // SHARD_KEYS)
            self.filters = self.scratch.save(self._built(self.current(), self.shards), "filters")
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        """With these documents too; their doc_ids must not be in the index."""
        refs = self.scratch.save(references(docs), "refs")
        batch = self.scratch.save(counted(refs), "counts")
        if self.refs is None:
            shards = max(1, -(-batch.count() // SHARD_KEYS))
            return LineIndex(self.scratch, refs, [batch], self.scratch.save(self._built(batch, shards), "filters"), shards)
        # only keys that the filters know are looked up
        known = self.scratch.save(self.probe(batch.select(*KEY), 1), "known")
        old = self.current(known).select(*KEY, *[F.col(c).alias(f"old_{c}") for c in ("n", "least", "greatest")])
        both = batch.join(old, KEY, "left").withColumn("was", _copies("old_"))
        both = both.select(*KEY, (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.least("least", "old_least").alias("least"), F.greatest("greatest", "old_greatest").alias("greatest"), "was")
        return self._changed(self.refs.unionByName(refs), self.scratch.save(both, "changes"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of these ids (doc_id; null for rows without one)."""
        if self.refs is None:
            return self
        gone = self.scratch.save(doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct(), "gone")
        keys = self.scratch.save(self.refs.join(gone, "doc_id", "left_semi").select(*KEY).distinct(), "keys")
        refs = self.refs.join(gone, "doc_id", "left_anti")
        left = counted(refs.join(keys, KEY, "left_semi"))
        old = self.current(keys).select(*KEY, _copies().alias("was"))
        changes = old.join(left, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least", "greatest", "was")
        return self._changed(refs, self.scratch.save(changes, "changes"))

    def dropped(self) -> DataFrame:
        """(doc_id, text_hash, pos) of the lines that go."""
        counts = self.current()
        shared = counts.where("least <> greatest")
        total = self.refs.count()
        # a thousand rows at most, by its definition
        hot = self.scratch.save(counts.where(F.col("n") * SHARE >= total).select(*KEY, "least", (F.col("least") != F.col("greatest")).alias("shared")), "hot")
        hot = F.broadcast(hot)
        of_hot = self.refs.join(hot.where("shared").withColumnRenamed("least", "first"), KEY).where("doc_id <> first")
        rest = self.scratch.save(self.probe(self.refs.join(hot, KEY, "left_anti"), 2), "repeated")
        of_rest = rest.join(shared.select(*KEY, F.col("least").alias("first")), KEY).where("doc_id <> first")
        names = ["doc_id", "text_hash", "pos"]
        return of_hot.select(*names).unionByName(of_rest.select(*names))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Per document, all in the index: doc_id, n_lines, n_dropped, kept (text)."""
        rows = _rows(docs)
        if self.refs is None:
            raise ValueError("the index is empty")
        gone = self.dropped().groupBy(F.col("doc_id").alias("own_id"), "text_hash").agg(F.collect_list("pos").alias("gone"))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                texts = batch.column("text").to_pylist()
                lines, lost = [], []
                for n, places in enumerate(batch.column("gone").to_pylist()):
                    own = texts[n].split("\n")
                    out = set(places or ())
                    if out:
                        texts[n] = "\n".join([x for i, x in enumerate(own) if i not in out])
                    lines.append(len(own))
                    lost.append(len(out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

        return rows.join(gone, ["own_id", "text_hash"], "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    index = LineIndex(Scratch(spark, "lines")).insert(docs)
    return index.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(doc_id, 9223372036854775807) as own, md5(coalesce(text, '')) as h, row_number() over () as row, string_split(coalesce(text, ''), chr(10)) as lines
  from documents
), l as (
  select doc_id, own, row, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d
), k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), g as (
  select key, min(own) as least from k where length(key) >= 10 group by key having min(own) <> max(own)
), m as (
  select k.*, g.key is not null and k.own <> g.least as gone from k left join g on k.key = g.key
)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by row
"""
