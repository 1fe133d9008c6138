"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, from id-striped count matrices.

A document's text, with a blank before it, is encoded by both tokenizers (A byte-level, B pieces). Where tokens of both end at
one byte, the text is cut; tokens of A and B between two cuts are linked, each with each. All documents of a batch are
aligned at once by array operations over byte offsets.

Counting and scoring are striped by A's id: stripe ``a % STRIPES`` owns row ``a // STRIPES`` of a dense matrix over all of B's
ids. Tasks count in how many documents each pair occurs and send a stripe its pairs as (cell, documents); ``np.add.at`` puts
them into the stripe's block, and a row's maximum says which B ids are best for an A id. A block has a fixed size
(ids of A / STRIPES x ids of B), whatever the corpus. A document's links travel as blobs, a row a batch of documents and stripe, to
where the stripe's block is; what comes back is one small blob, which is summed by batch. A stripe with many links
is dealt to several tasks by batch, in proportion to its bytes, and each of them gets the block's used cells.

Defined results: a null or empty text, or one whose bytes A or B does not give back (say U+2581, which B reads as a
blank), has no tokens: zeros and ''. Each row is a document of its own, so repeated rows count twice and a null doc_id is
reported as null. Strings of control tokens inside texts are ordinary text. An empty table gives no rows; other columns of the
input are ignored. A text is aligned whole, in some 200 bytes of memory a byte of text beside what the tokenizers need.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, load, worker_cache
from wattloom.llm.tokens import gathered, shared

STRIPES = 128
#: Bytes of text that are aligned together.
TOGETHER = 2 << 20
#: Cells that a task holds before it passes its counts on.
CELLS = 1 << 21
#: A group with more links than this is counted by its distinct ids.
MANY = 4096
#: Bytes of links that one task scores.
SCORED = 32 << 20


class Side:
    """What a tokenizer's ids stand for: bytes, and decimal digits."""

    def __init__(self, tokens: list[bytes]):
        self.n = len(tokens)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        where = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        return self.pool[where]


def byte_level(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizers file: printable bytes stand for themselves, others for U+0100 and on."""
    from tokenizers import Tokenizer

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(of[c] for c in token)
    return out


def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece model: U+2581 is a blank, <0xHH> is a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    name = model.id_to_piece
    return [bytes([int(name(i)[3:5], 16)]) if model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(len(model))]


class Aligner:
    """Two tokenizers and the tables of their ids, held by a worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = Side(byte_level(path_a)), Side(pieces(path_b))
        if self.a.n * self.b.n >> 32:
            raise ValueError("pairs of ids do not fit 32 bits")
        self.encode_a = shared(path_a, True, control_as_text=True, lead=" ").encode
        self.encode_b = sentencepiece.SentencePieceProcessor(model_file=path_b).encode
        names = [str(i).encode() for i in range(max(self.a.n, self.b.n))]
        width = max(map(len, names)) + 1
        self.digits = np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(-1, width)
        self.width = np.array([len(x) for x in names], np.int64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text whether both sides give its bytes; ids of A joined, how many each; the same of B. Other texts have none."""
        import pyarrow as pa

        coded = self.encode_a(pa.array(texts, pa.large_string()))
        a = np.frombuffer(b"".join(coded), "<u2").astype(np.int64)
        n_a = np.array([len(x) // 2 for x in coded], np.int64)
        ids = self.encode_b(texts, num_threads=1)
        n_b = np.array([len(x) for x in ids], np.int64)
        b = np.fromiter((i for x in ids for i in x), np.int64, int(n_b.sum()))
        raw = [b" " + t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(x) for x in raw], np.int64)
        doc = np.arange(len(texts))
        ok = np.array([t != "" for t in texts], bool)
        for side, ids_, n in ((self.a, a, n_a), (self.b, b, n_b)):
            ok &= np.bincount(np.repeat(doc, n), side.size[ids_], len(doc)).astype(np.int64) == size
        want = np.frombuffer(b"".join(x for x, k in zip(raw, ok, strict=True) if k), np.uint8)
        own, ends = np.nonzero(ok)[0], np.cumsum(size[ok])
        for side, ids_, n in ((self.a, a, n_a), (self.b, b, n_b)):
            wrong = np.nonzero(side.bytes_of(ids_[np.repeat(ok, n)]) != want)[0]
            if len(wrong):  # not before both are looked at: ``want`` holds what was right by length
                size[own[np.searchsorted(ends, wrong, side="right")]] = -1
        ok &= size >= 0
        return ok, a[np.repeat(ok, n_a)], np.where(ok, n_a, 0), b[np.repeat(ok, n_b)], np.where(ok, n_b, 0)

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Figures of each text, and its distinct pairs: (text, cell a * n_b + b, how many links), in order."""
        ok, a, n_a, b, n_b = self.tokens(texts)
        n = len(texts)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        last = lambda own, other: other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own if len(other) else np.zeros(len(own), bool)
        last_a, last_b = last(end_a, end_b), last(end_b, end_a)  # both end there: the group's last token
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        of_a, of_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        doc_a = np.repeat(np.arange(n), n_a)
        doc_of = doc_a[last_a]  # of a group
        links = of_a * of_b
        figures = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of, minlength=n), "n_links": np.bincount(doc_of, links, n).astype(np.int64)}
        # pairs of small groups one by one, of large ones by distinct ids
        each = np.where((links > MANY)[group_a], 0, of_b[group_a])
        at_b = np.arange(int(each.sum())) + np.repeat(before_b[group_a] - (np.cumsum(each) - each), each)
        keys = [(np.repeat(doc_a, each) << 32) | (np.repeat(a, each) * self.b.n + b[at_b])]
        times = []
        for g in np.nonzero(links > MANY)[0]:
            ids_a, many_a = np.unique(a[before_a[g] : before_a[g] + of_a[g]], return_counts=True)
            ids_b, many_b = np.unique(b[before_b[g] : before_b[g] + of_b[g]], return_counts=True)
            keys.append((doc_of[g] << 32) | (ids_a[:, None] * self.b.n + ids_b).ravel())
            times.append((many_a[:, None] * many_b).ravel())
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable") if times else None
        key = np.sort(key) if order is None else key[order]
        first = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
        if order is None:
            many = np.diff(np.append(first, len(key)))
        else:
            many = np.add.reduceat(np.concatenate([np.ones(len(keys[0]), np.int64), *times])[order], first)
        figures["sha"] = self.digests(ok, a, b, n_a + n_b, np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (before_a + of_a)[group_b], last_a, last_b)
        return figures, key[first] >> 32, key[first] & 0xFFFFFFFF, many

    def digests(self, ok, a, b, tokens, at_a, at_b, last_a, last_b) -> list[str]:
        """SHA-256 of each text's groups written out; tokens go to places at_a and at_b of one sequence."""
        ids, sign = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        ids[at_a], ids[at_b] = a, b
        sign[at_a], sign[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        chars, width = self.digits[ids], self.width[ids]
        chars[np.arange(len(ids)), width] = sign
        flat = chars[np.arange(chars.shape[1]) <= width[:, None]]
        ends = np.concatenate(([0], np.cumsum(width + 1)))[np.cumsum(tokens)]
        starts = np.concatenate(([0], ends[:-1]))
        return [hashlib.sha256(flat[s : e - 1].tobytes()).hexdigest() if k else "" for k, s, e in zip(ok, starts, ends, strict=True)]


def _squeezed(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def _expanded(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of one length, joined in a blob."""
    import zstandard

    raw = zstandard.decompress(blob)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in map(np.dtype, kinds):
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
ALIGNED = "batch long, stripe int, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _FIGURES) + ", sha array<string>, links binary, cells binary"
SCORES = "batch long, scores binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _by_stripe(ids_b: int, code: np.ndarray, *others: np.ndarray):
    """(stripe, cells of its block, others) of the stripes that occur."""
    a, b = np.divmod(code, ids_b)
    stripe = a % STRIPES
    order = np.argsort(stripe, kind="stable")
    cell = (a // STRIPES * ids_b + b)[order].astype("<u4")
    cuts = np.searchsorted(stripe[order], np.arange(STRIPES + 1))
    for s in np.nonzero(np.diff(cuts))[0].tolist():
        own = slice(cuts[s], cuts[s + 1])
        yield s, cell[own], *(x[order[own]] for x in others)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One pass over the texts: rows of a batch's figures, of its links by stripe, and of a task's counts by stripe."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        batch, held, size = TaskContext.get().partitionId() << 32, [], 0
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in ALIGNED.split(", ")]

        def rows(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

        def merged():
            code, number = (np.concatenate(x) for x in zip(*held, strict=True))
            code, at = np.unique(code, return_inverse=True)
            return code, np.bincount(at, number, len(code)).astype(np.int64)

        def counts():
            found = list(_by_stripe(aligner.b.n, *merged()))
            return rows(stripe=[f[0] for f in found], cells=[_squeezed(f[1], f[2].astype("<i8")) for f in found])

        aligner = None
        for table in gathered(batches, TOGETHER):
            # the aligner's encoder is the worker's; a change of operator drops both
            aligner = aligner or _aligner(path_a, path_b)
            ids = table.column("doc_id")
            figures, doc, code, many = aligner.align(table.column("text").fill_null("").to_pylist())
            yield rows(batch=[batch], doc_id=[ids.to_pylist()], sha=[figures["sha"]], **{c: [figures[c]] for c in _FIGURES})
            found = list(_by_stripe(aligner.b.n, code, doc.astype("<u4"), many.astype("<u4")))
            if found:
                yield rows(batch=[batch] * len(found), stripe=[f[0] for f in found], links=[_squeezed(*f[1:]) for f in found])
                held.append(np.unique(code, return_counts=True))
                size += len(held[-1][0])
            if size > CELLS:
                held, size = [merged()], 0
                if len(held[0][0]) > CELLS // 2:
                    yield counts()
                    held = []
            batch += 1
        if held:
            yield counts()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def _aligner(path_a: str, path_b: str) -> Aligner:
    return worker_cache(f"align {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def matrix(table: DataFrame, ids_a: int, ids_b: int) -> DataFrame:
    """(stripe, matrix): the used cells of each stripe's dense block, with their counts."""
    rows = -(-ids_a // STRIPES)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, block, used = None, None, []

        def close():
            cells = np.unique(np.concatenate(used))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_squeezed(cells, block[cells])], pa.binary())], ["stripe", "matrix"])

        for batch in batches:
            for stripe, blob in zip(batch.column("stripe").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if stripe != now:
                    if used:
                        yield close()
                    now, block, used = stripe, np.zeros(rows * ids_b, np.int64), []
                cells, number = _expanded(blob, "<u4", "<i8")
                np.add.at(block, cells, number)
                used.append(cells)
                if len(used) > 64:
                    used = [np.unique(np.concatenate(used))]
        if used:
            yield close()

    return table.where("cells is not null").select("stripe", "cells").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, matrix binary")


def scored(links: DataFrame, matrices: DataFrame, ids_a: int, ids_b: int) -> DataFrame:
    """(batch, scores): links scored where their stripe's block is."""
    rows = -(-ids_a // STRIPES)
    # a stripe's share of tasks follows its bytes; a row a stripe reaches the driver
    size = {r.stripe: r.n for r in links.groupBy("stripe").agg(F.sum(F.length("links")).alias("n")).collect()}
    parts = F.lit([max(1, -(-size.get(s, 0) // SCORED)) for s in range(STRIPES)])
    parts = F.element_at(parts, F.col("stripe") + 1).cast("long")
    own = links.select("stripe", F.pmod(F.xxhash64("batch"), parts).alias("part"), "batch", "links", F.lit(None).cast("binary").alias("matrix"))
    of = matrices.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("binary").alias("links"), "matrix")
    dealt = of.unionByName(own).repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("batch").asc_nulls_first())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, most = None, None
        for batch in batches:
            out = []
            for number, blob, cells in zip(*(batch.column(c).to_pylist() for c in ("batch", "links", "matrix")), strict=True):
                if cells is not None:  # the next stripe's block comes before its links
                    block, most = None, np.zeros(rows, np.int64)
                    cell, count = _expanded(cells, "<u4", "<i8")
                    block = np.zeros(rows * ids_b, np.int64)
                    block[cell] = count
                    np.maximum.at(most, cell // ids_b, count)
                    continue
                cell, doc, many = _expanded(blob, "<u4", "<u4", "<u4")
                count = block[cell]
                first = np.nonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[0]  # links come by document
                best = np.add.reduceat(np.where(count == most[cell // ids_b], many, 0).astype(np.int64), first)
                out.append((number, _squeezed(doc[first], best, np.add.reduceat(count * many, first))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["batch", "scores"])

    return dealt.mapInArrow(run, SCORES)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece
    from tokenizers import Tokenizer

    scratch = Scratch(docs.sparkSession, "align")
    ids_a, ids_b = max(Tokenizer.from_file(path_a).get_vocab().values()) + 1, len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    table = scratch.save(aligned(docs, path_a, path_b), "aligned", codec="uncompressed")
    matrices = scratch.save(matrix(table, ids_a, ids_b), "matrix", codec="uncompressed")
    scores = scored(table.where("links is not null").select("batch", "stripe", "links"), matrices, ids_a, ids_b)
    names = ["doc_id", *_FIGURES, "sha"]
    figures = table.where("doc_id is not null").select("batch", *names, F.lit(None).cast("binary").alias("scores"))
    both = figures.unionByName(scores, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", F.col("scores").isNotNull())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now = None  # figures of a batch, and its sums so far

        def close():
            columns = [pa.array(x, k) for x, k in zip([*now[:5], *now[6:], now[5]], [*[pa.int64()] * 7, pa.string()], strict=True)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

        for batch in batches:
            columns = [batch.column(c) for c in (*names, "scores")]
            for row in range(batch.num_rows):
                blob = columns[-1][row].as_py()
                if blob is None:
                    if now is not None:
                        yield close()
                    own = [c[row].as_py() for c in columns[:-1]]
                    now = [*own, np.zeros(len(own[0]), np.int64), np.zeros(len(own[0]), np.int64)]
                else:
                    doc, best, count = _expanded(blob, "<u4", "<i8", "<i8")
                    now[6][doc] += best
                    now[7][doc] += count
        if now is not None:
            yield close()

    return both.mapInArrow(run, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
