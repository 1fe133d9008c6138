"""Token ids of whole documents, shared by the operators that store or pack them.

Encoding a text costs the tokenizer library the same for a word seen a million times. Texts are
therefore cut where a tokenizer's own splitting cuts in any case; each distinct piece goes through
the library once while a worker remembers it, and the ids of a text are gathered from its
pieces' by array operations. A text where a cut is not certain is encoded whole, and so is one that
holds an added token of the file (a control string such as an end of text): by default such strings
become the added token's id, as the library does it; ``control_as_text`` spells them as ordinary text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, worker_cache

#: Distinct pieces, and their characters, in a generation that a worker remembers; the last two bound its memory.
REMEMBERED = 400_000
REMEMBERED_CHARS = 16 << 20
#: Bytes of text that are encoded together, whole texts at a time: more texts share more pieces.
TOGETHER = 4 << 20
#: Whole vocabularies fit 16 bits in both files; ids are held so between steps.
HELD = np.dtype("<u2")
#: Stands before a piece that has no blank before it.
FIRST = "\x02"
#: White space at an end or not alone, kinds other than blank and line end, and FIRST itself.
UNSURE = r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x02]"
#: A letter or digit, then an ASCII sign: no piece of either splitting reaches from one into the other.
SIGN = r"([\p{L}\p{N}])([!-/:-@\[-`{-~])"


class Encoder:
    """Encodes texts with a tokenizers file, remembering pieces.

    leading_space: byte-level BPE whose pattern takes one blank into the piece behind it. A text in
    which all white space stands alone, as one blank or line end, is then cut before each blank
    and around each line end; no piece of such a pattern reaches over those places, from either
    side. Else the tokenizer drops white space, and texts are cut at it. ``lead``, a blank or nothing,
    stands before each text.
    """

    def __init__(self, path: str, leading_space: bool, control_as_text: bool = False, lead: str = ""):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = control_as_text
        self.control = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        if self.tokenizer.get_vocab_size() > np.iinfo(HELD).max:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        if lead not in ("", " ") or lead and not leading_space:
            raise ValueError("only a blank can stand before a text, and only where blanks count")
        self.leading_space, self.lead = leading_space, lead
        # what parts new pieces in one text, taken as exactly one id of its own, and what they must not hold
        self.mark, self.apart = ("\n", "\n") if leading_space else (" 0 ", "0")
        [self.mark_id] = self._ids([self.mark])[0]
        self.forget()

    def forget(self) -> None:
        self.chars = 0
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, HELD)
        if self.leading_space:
            self._add(["\n"], np.array([self.mark_id], HELD), np.zeros(1, np.int64), np.ones(1, np.int64))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[str], ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """pieces have ids[start : start + size]."""
        self.known.update(zip(pieces, range(len(self.start), len(self.start) + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))
        self.start, self.size = np.concatenate([self.start, start + len(self.pool)]), np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, ids])

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered pieces, joined, and where each piece's end."""
        size = self.size[codes]
        ends = np.cumsum(size)
        where = np.repeat(self.start[codes] - (ends - size), size)
        where += np.arange(len(where))
        return self.pool[where], ends

    def codes(self, pieces: list[str]) -> np.ndarray:
        """Numbers of distinct pieces, after learning the new ones."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            kept = list(self.known)
            if sum(map(len, kept)) > REMEMBERED_CHARS:  # few but long pieces, as of scripts without blanks
                kept = []
            ids, ends = self.gather(np.fromiter(self.known.values(), np.int64, len(kept)))
            size = np.diff(ends, prepend=0)
            self.forget()
            self._add(kept, ids, ends - size, size)
            self.older, self.known, self.chars = self.known, {}, 0
        known, older = self.known, self.older
        missing = [p for p in pieces if p not in known]
        if missing:
            known.update({p: older[p] for p in missing if p in older})
            missing = [p for p in missing if p not in known]
            self._encode([p for p in missing if p[:1] != FIRST], " " if self.leading_space else "", 0)
            self._encode([p for p in missing if p[:1] == FIRST], "", 1)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _encode(self, pieces: list[str], before: str, cut: int) -> None:
        alone = []
        together = [p for p in pieces if len(p) > cut and self.apart not in p or alone.append(p)]
        for at in range(0, len(together), 4096):
            some = together[at : at + 4096]
            ids = np.array(self._ids([before + (self.mark + before).join([p[cut:] for p in some])])[0], HELD)
            marks = np.nonzero(ids == self.mark_id)[0]
            if len(marks) != len(some) - 1:
                alone += some
                continue
            start = np.concatenate(([0], marks + 1))
            self._add(some, ids, start, np.append(marks, len(ids)) - start)
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            ids = self._ids([before + p[cut:] for p in some])
            size = np.array([len(x) for x in ids], np.int64)
            self._add(some, np.array([i for x in ids for i in x], HELD), np.cumsum(size) - size, size)

    def encode(self, texts) -> list[bytes]:
        """Little-endian 16-bit ids of each text of an Arrow string array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pa.large_string()
        texts = texts.cast(text)
        out: list[bytes | None] = [None] * len(texts)
        odd = np.zeros(len(texts), bool)
        if self.control:
            odd |= pc.match_substring_regex(texts, self.control, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.leading_space:
            odd |= pc.match_substring_regex(texts, UNSURE).to_numpy(zero_copy_only=False)
        some, sure = np.nonzero(odd)[0], np.nonzero(~odd)[0]
        for i, ids in zip(some, self._ids([self.lead + t for t in texts.take(pa.array(some)).to_pylist()]), strict=True):
            out[i] = np.array(ids, HELD).tobytes()
        if len(some):
            texts = texts.take(pa.array(sure))
        if self.leading_space:
            texts = pc.replace_substring_regex(texts, SIGN, rf"\1 {FIRST}\2")
            texts = pc.binary_join_element_wise(pa.scalar("" if self.lead else FIRST, text), pc.replace_substring(texts, "\n", f" \n {FIRST}"), pa.scalar("", text))
        else:
            texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), SIGN, r"\1 \2")
        if not len(sure):
            return out
        words = pc.split_pattern(texts, " ")
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        codes = self.codes(coded.dictionary.to_pylist())
        ids, stops = self.gather(codes[coded.indices.to_numpy()])
        stop = np.where(ends > 0, stops[ends - 1], 0).tolist()
        raw, width, start = ids.tobytes(), HELD.itemsize, 0
        for i, end in zip(sure.tolist(), stop, strict=True):
            out[i] = raw[start * width : end * width]
            start = end
        return out


def shared(path: str, leading_space: bool, control_as_text: bool = False, lead: str = "") -> Encoder:
    """This worker's encoder for a file, so that its tasks share what it remembers."""
    return worker_cache(f"tokens {path} {leading_space} {control_as_text} {lead}", lambda: Encoder(path, leading_space, control_as_text, lead))


ENCODED = "part int, pos long, doc_id long, n_tokens long, ids binary, counts binary"


def gathered(batches: Iterator, least: int = TOGETHER) -> Iterator:
    """Arrow batches joined until their texts hold ``least`` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def encoded(docs: DataFrame, scratch: Scratch, path: str, leading_space: bool, end_id: int, control_as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Writes each text's ids and ``end_id``: rows (part, pos, doc_id, n_tokens, ids), and (counts).

    ids is a zstd frame of 16-bit ids. (part, pos) numbers the rows of the written table; it
    tells rows apart even if doc_id is null or repeated. Null text counts as empty. Each task's
    last row only holds how often each id occurred (64-bit integers in a zstd frame).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        encoder, squeeze = shared(path, leading_space, control_as_text), zstandard.ZstdCompressor(level=1)
        part, pos, end = TaskContext.get().partitionId(), 0, np.array([end_id], HELD).tobytes()
        total = np.zeros(1 << 16, np.int64)
        schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
        for batch in gathered(batches):
            ids = [x + end for x in encoder.encode(batch.column("text").fill_null(""))]
            total += np.bincount(np.frombuffer(b"".join(ids), HELD), minlength=1 << 16)
            n = len(ids)
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), batch.column("doc_id"), pa.array([len(x) // HELD.itemsize for x in ids], pa.int64()), pa.array([squeeze.compress(x) for x in ids], pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            pos += n
        if pos:
            yield pa.RecordBatch.from_pydict({"part": [part], "pos": [None], "doc_id": [None], "n_tokens": [None], "ids": [None], "counts": [squeeze.compress(total.tobytes())]}, schema=schema)
        pa.default_memory_pool().release_unused()  # this worker's next task may be another operator's

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)
    held = scratch.save(rows, "ids", codec="uncompressed")
    texts = held.where("pos is not null").drop("counts")
    texts.path = held.path
    return texts, held.where("counts is not null").select("counts")


def id_counts(counts: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: tasks add up their part, a row an id reaches the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                total += np.frombuffer(zstandard.decompress(blob), np.int64)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def expand(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), HELD)
