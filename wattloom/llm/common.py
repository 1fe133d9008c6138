"""Pieces that the training-data operators share: tables, scratch space, components."""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import importable

#: Rows of one Arrow batch handed to Python; bounds a worker's memory with long texts.
ARROW_ROWS = 256


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is missing, a session on one machine gets a folder of its own; on a cluster this raises,
    as executors would each write to their own disk.
    """
    importable(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wattloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return found.rstrip("/")


class Scratch:
    """Tables written into the shared folder, to cut lineage where an executor may be lost.

    A written table survives the loss of any executor, unlike a local checkpoint.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = itertools.count()

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._n)}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes df and returns the written table; ``.path`` of the result tells where."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Deletes all tables of this scratch space, once nothing that reads them is needed any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives memory that this Python worker no longer uses back to the system; workers live on between operators."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays of a MB or more go back when they are freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_kept: dict[str, object] = {}


def worker_cache(name: str = "", make=None):
    """What a Python worker keeps between tasks: one thing at a time.

    Asking for another name, or for none, frees what was kept, as workers serve one operator after another.
    """
    if name not in _kept:
        if _kept:
            _kept.clear()
            trim()
        if make is None:
            return None
        _kept[name] = make()
    return _kept[name]


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is one node of the component.

    Rounds of hooking and contraction. Each node hooks onto the neighbour with the least hashed
    id, which keeps chains short whatever the ids are; pointers are then doubled to their
    roots, both ends of each edge are replaced by roots, and loops and repeats go. All steps are
    equi-joins and minima that Spark aggregates before it shuffles; nothing is gathered on the
    driver but a count per round. Isolated nodes do not occur in ``edges``; callers add them.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = scratch.save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    total = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        parent = scratch.save(hooked.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("root")), "parent")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.save(parent.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jump")
            parent = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        to = lambda end: parent.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        if total is None:
            total = parent
        else:
            moved = total.join(parent.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            total = scratch.save(moved.select("node", F.coalesce("top", "root").alias("root")), "total")
        edges = scratch.save(edges.join(to("a"), "a").join(to("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return total


def batches_of_runs(batches: Iterator, key: str, least: int = 1 << 16) -> Iterator:
    """Arrow tables of rows sorted by ``key``, of ``least`` rows or more, that part no run of equal keys."""
    import numpy as np
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if rows < least or len(keys) > 1 and keys[0] == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        head = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
        if head and (cut or head[-1].column(key)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches(head).combine_chunks()
            held = [batch.slice(cut)]
            rows = batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def joined(batches: Iterator, least: int = 1 << 16) -> Iterator:
    """Arrow batches put together into tables of ``least`` rows."""
    import pyarrow as pa

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def lists(batches: Iterator, key: str, most: int, least: int = 1 << 16) -> Iterator:
    """Arrow tables of rows sorted by ``key`` as (table, long): whole runs of equal keys, or parts of one run of more than ``most`` rows.

    A long run is passed on as it comes: what is held is bounded by ``least``, ``most`` and a batch's rows.
    """
    import numpy as np
    import pyarrow as pa

    table = lambda parts: pa.Table.from_batches(parts).combine_chunks()
    done, size = [], 0  # whole runs
    held, rows, now, long = [], 0, None, False  # the run that the last batch ended in
    for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
        keys, start = batch.column(key).to_numpy(zero_copy_only=False), 0
        if now is not None and keys[0] == now:
            start = int(np.searchsorted(keys, now, side="right"))
            held.append(batch.slice(0, start))
            rows += start
            if long or rows > most:
                yield table(held), True
                held, long = [], True
            if start == len(keys):
                continue
        cut = int(np.searchsorted(keys, keys[-1]))
        done += [*held, batch.slice(start, cut - start)]
        size += sum(map(len, held)) + cut - start
        if size >= least:
            yield table(done), False
            done, size = [], 0
        held, rows, now, long = [batch.slice(cut)], len(keys) - cut, keys[-1], False
    done += held
    if sum(map(len, done)):
        yield table(done), False


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of steps whose results are written, before the next ones need room."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
