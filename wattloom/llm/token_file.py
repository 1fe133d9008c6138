"""Token-id output: canonical length-limited Huffman coding of ids, from global counts.

A file is a folder of two tables. ``blocks`` is in ascending (doc_id, row) order over its parts. A block
holds whole documents and can be decoded alone: its code is the file's one canonical
code, its bit stream has a checkpoint, the bit offset, at
every 128th id, and decoding runs all checkpoints at once through one table of 2**LIMIT entries.
``code`` holds that code as one length per id, so a file is read by its path alone, in any session.
Code lengths come from package-merge over the counts of all ids, so no code exceeds LIMIT bits.

Defined results: null and empty texts give the end id alone; a null doc_id sorts first; repeated
rows follow one another; one document longer than a block makes a block of its own; an empty table
gives an empty file; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, load
from wattloom.llm.tokens import encoded, expand, id_counts

LIMIT = 20
EVERY = 128
BLOCK = 1 << 19
CODE_SCHEMA = "id int, bits int"
BLOCK_SCHEMA = "part int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, origin = weights, []
    for _ in range(limit):
        origin.append(None if level is weights else is_leaf)
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        last, level, is_leaf = level, both[at], at < len(weights)
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for leaf in reversed(origin):
        leaves = take if leaf is None else int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, from code lengths alone: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.nonzero(lengths == n)[0]
        code <<= n - before
        before = n
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For each ``limit`` bits ahead: the id that they begin with, and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    ids, steps = np.repeat(order, spans), np.repeat(lengths[order], spans)
    rest = (1 << limit) - len(ids)
    return np.concatenate([ids, np.zeros(rest, ids.dtype)]).astype(np.uint32), np.concatenate([steps, np.ones(rest, np.uint8)])


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bit stream of ids, and the bit offset of every EVERY-th id as 32-bit integers."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ids) else 0
    if total >> 32:
        raise ValueError("a block of more than 2**32 bits")
    placed = codes[ids] << (64 - (starts & 31) - n).astype(np.uint64)
    size = (total >> 5) + 2
    high = np.bincount(starts >> 5, (placed >> np.uint64(32)).astype(np.float64), size)  # disjoint bits: sums stay exact
    low = np.bincount((starts >> 5) + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    words = (high + low).astype(np.uint64).astype(">u4").tobytes()
    return words[: (total + 7) // 8], starts[::EVERY].astype("<u4").tobytes()


def unpack(bits: bytes, checkpoints: bytes, n_tokens: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT) -> np.ndarray:
    """The ids of a block: every checkpoint's run is decoded side by side."""
    ids, steps = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8)
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.zeros((EVERY, len(at)), np.uint32)
    # 32 bits from any byte on hold the limit of 20 bits from any bit of that byte
    ahead = raw[:-3].astype(np.uint32) << 24 | raw[1:-2].astype(np.uint32) << 16 | raw[2:-1].astype(np.uint32) << 8 | raw[3:]
    most = len(ahead) - 1
    for k in range(EVERY):
        window = ahead[np.minimum(at >> 3, most)] >> (32 - limit - (at & 7)).astype(np.uint32) & np.uint32((1 << limit) - 1)
        out[k] = ids[window]
        at += steps[window]
    return out.T.ravel()[:n_tokens]


class TokenFile:
    """A written file, opened by its path: its blocks and its code lengths."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
        code = spark.read.schema(CODE_SCHEMA).parquet(f"{path}/code").collect()  # a row an id of the vocabulary
        self.lengths = np.zeros(max((r.id for r in code), default=-1) + 1, np.uint8)
        for r in code:
            self.lengths[r.id] = r.bits

    def documents(self) -> DataFrame:
        """Reads back (doc_id, start, n_tokens, ids_crc32), the crc over 32-bit little-endian ids."""
        lengths = self.lengths

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            table = None
            for batch in batches:
                for row in range(batch.num_rows):
                    table = table or decode_table(lengths)
                    get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                    ids = unpack(get("bits"), get("checkpoints"), get("n_tokens"), table).astype("<u4")
                    docs, sizes = get("doc_ids"), get("doc_tokens")
                    ends = np.cumsum(sizes)
                    crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
                    starts = get("start") + ends - np.array(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([get("part")] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                        ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )

        rows = self.blocks.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
        sums = self.blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        parts = sorted((r.part, r.n) for r in sums.collect())  # one row a part of the file
        before = dict(zip([p for p, _ in parts], np.cumsum([0] + [n for _, n in parts]).tolist(), strict=False))
        spark = self.blocks.sparkSession
        offsets = spark.createDataFrame(list(before.items()), "part int, before long")
        return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def write_tokens(docs: DataFrame, path: str, end_id: int, out: str, leading_space: bool = True, control_as_text: bool = False) -> None:
    """Encodes all texts with the tokenizers file at ``path`` and writes them in ascending doc_id to the folder ``out``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    held, counts = encoded(docs, scratch, path, leading_space, end_id, control_as_text)
    counts = id_counts(counts)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, start, open_docs, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = np.concatenate([x for _, x in open_docs])
            bits, checkpoints = pack(ids, codes, lengths)
            values = [part, start, len(ids), [d for d, _ in open_docs], [len(x) for _, x in open_docs], bits, checkpoints]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["part", "start", "n_tokens", "doc_ids", "doc_tokens", "bits", "checkpoints"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = expand(blob)
                if open_docs and size + len(ids) > BLOCK:
                    yield close()
                    start, open_docs, size = start + size, [], 0
                open_docs.append((doc, ids))
                size += len(ids)
        if open_docs:
            yield close()

    ordered = held.repartitionByRange("doc_id", "part", "pos").sortWithinPartitions("doc_id", "part", "pos").select("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    used = [(int(i), int(lengths[i])) for i in np.nonzero(lengths)[0]]
    spark.createDataFrame(used, CODE_SCHEMA).coalesce(1).write.parquet(f"{out}/code")
    scratch.drop(held)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = Scratch(spark, "token-file").path("documents")
    write_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, out)
    return TokenFile(spark, out).documents()
