"""SentencePiece encoding and decoding by a streaming Viterbi search over a model's pieces.

The search reads a text once. Scores are kept for as many positions as the longest piece is
long; backpointers wait until all surviving paths run through one boundary, and then the ids before
it are committed. So memory is bounded by the longest piece and the longest ambiguity, not by
the text. Where no piece reaches over a place (before a blank that follows a character, around
a line end), all paths meet there by themselves; a worker remembers the ids between two such
places, and only new ones are searched.

The search maximises the sum of the pieces' scores, as a unigram model's does, with its rules:
shorter starts win ties, a character that no piece holds costs the least score less 10 and is
written as its bytes. The given vocabulary was trained for merges (BPE), of which scores are
ranks; there is no unigram model among the given files. Read as unigram the ids differ from those
merges would give, and decode to the same text.

Defined results: null and empty texts have no ids; blanks and U+2581 are one character to a model,
so texts with the latter do not come back exactly; repeated rows get equal results; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import load, shared_dir, worker_cache
from wattloom.llm.tokens import FIRST, HELD, Encoder

BLANK = "▁"
#: How much less than the least score a character costs that no piece holds.
UNKNOWN_PENALTY = 10.0
#: What lies between places where all paths meet.
SEGMENT = re.compile(r" *[^ \n]+| +|\n")


class Vocabulary:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {i: model.get_score(i) for i in plain}
        self.unknown, self.least = model.unk_id(), min(self.score.values())
        #: every prefix of a piece, with its id if it is a piece itself
        self.prefixes: dict[str, int] = {}
        for i in plain:
            piece = model.id_to_piece(i)
            for n in range(1, len(piece)):
                self.prefixes.setdefault(piece[:n], -1)
            self.prefixes[piece] = i
        self.longest = max(len(p) for p in self.prefixes)
        table = [b""] * size
        for i in plain:
            table[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
        for value, i in self.bytes.items():
            table[i] = bytes([value])
        self.table = table
        #: blanks only begin pieces, so all paths meet before a blank that follows another character
        self.blanks_part = all(BLANK not in p.lstrip(BLANK) and "\n" not in p[1:] for p, i in self.prefixes.items() if i >= 0)

    def characters(self, character: str) -> list[int]:
        """Ids of a character that no piece holds."""
        raw = character.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]


def stream(vocabulary: Vocabulary, characters: Iterable[str]) -> Iterator[int]:
    """Ids of the best segmentation, committed while reading."""
    prefixes, score, longest = vocabulary.prefixes, vocabulary.score, vocabulary.longest
    unknown = vocabulary.least - UNKNOWN_PENALTY
    source = iter(characters)
    ahead = ""  # characters from ``at`` on, at most ``longest``
    at, done = 0, 0
    best: dict[int, float] = {0: 0.0}  # live: boundaries at .. at + longest
    back: dict[int, tuple[int, int, str]] = {}  # boundary -> (boundary before, id or -1, character)

    def commit(upto: int) -> list[int]:
        nonlocal done
        path, node = [], upto
        while node > done:
            before, i, character = back[node]
            path.append([i] if i >= 0 else vocabulary.characters(character))
            node = before
        for node in [n for n in back if n <= upto]:
            del back[node]
        done = upto
        return [i for ids in reversed(path) for i in ids]

    while True:
        while len(ahead) < longest:
            new = next(source, None)
            if new is None:
                break
            ahead += new
        if not ahead:
            yield from commit(at)
            return
        here = best.pop(at)
        single = False
        for n in range(1, len(ahead) + 1):
            i = prefixes.get(ahead[:n])
            if i is None:
                break
            if i < 0:
                continue
            single = single or n == 1
            total = here + score[i]
            if at + n not in best or total > best[at + n]:
                best[at + n], back[at + n] = total, (at, i, "")
        if not single:
            total = here + unknown
            if at + 1 not in best or total > best[at + 1]:
                best[at + 1], back[at + 1] = total, (at, -1, ahead[0])
        at, ahead = at + 1, ahead[1:]
        if len(best) == 1:
            yield from commit(at)
        elif at - done >= 2 * longest:
            ends = set(best)  # walk the latest end back until all paths are one
            while len(ends) > 1:
                last = max(ends)
                ends.remove(last)
                ends.add(back[last][0])
            [meeting] = ends
            if done < meeting <= at:
                yield from commit(meeting)


class Segmenter(Encoder):
    """Encodes Arrow arrays of texts, remembering the ids between places where all paths meet."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.leading_space = True
        [self.mark_id] = self.vocabulary.characters("\n")[:1]
        self.forget()

    def forget(self) -> None:
        super().forget()
        newline = self.vocabulary.characters("\n")
        self.size[0] = len(newline)
        self.pool = np.array(newline, HELD)

    def whole(self, text: str) -> list[int]:
        return list(stream(self.vocabulary, BLANK + text.replace(" ", BLANK))) if text else []

    def _encode(self, pieces: list[str], before: str, cut: int) -> None:
        lead = BLANK if before else ""
        ids = [list(stream(self.vocabulary, lead + p[cut:].replace(" ", BLANK))) for p in pieces]
        size = np.array([len(x) for x in ids], np.int64)
        self._add(pieces, np.array([i for x in ids for i in x], HELD), np.cumsum(size) - size, size)

    def encode(self, texts) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.large_string()
        texts = texts.cast(kind)
        odd = pc.match_substring_regex(texts, rf"{FIRST}|{BLANK}|^ |^$| $|  | \n|\n ").to_numpy(zero_copy_only=False)
        if not self.vocabulary.blanks_part:
            odd[:] = True
        out: list[bytes | None] = [None] * len(texts)
        for i in np.nonzero(odd)[0]:
            text = texts[int(i)].as_py()
            if FIRST in text or BLANK in text or not text or not self.vocabulary.blanks_part:
                out[i] = np.array(self.whole(text), HELD).tobytes()
                continue
            segments = [x if x == "\n" else FIRST + x for x in SEGMENT.findall(" " + text)]
            distinct = list(dict.fromkeys(segments))
            codes = dict(zip(distinct, self.codes(distinct).tolist(), strict=True))
            out[i] = self.gather(np.array([codes[x] for x in segments]))[0].tobytes()
        sure = np.nonzero(~odd)[0]
        if not len(sure):
            return out
        words = pc.split_pattern(pc.replace_substring(texts.take(pa.array(sure)), "\n", f" \n {FIRST}"), " ")
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        ids, stops = self.gather(self.codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
        raw, width, start = ids.tobytes(), HELD.itemsize, 0
        for i, end in zip(sure.tolist(), stops[ends - 1].tolist(), strict=True):
            out[i] = raw[start * width : end * width]
            start = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding sets before a text goes."""
        raw = b"".join(map(self.vocabulary.table.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def segmenter(path: str) -> Segmenter:
    return worker_cache(f"pieces {path}", lambda: Segmenter(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) with ids (binary, little-endian 16-bit); narrow."""
    shared_dir(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            text = batch.column("text")
            ids = segmenter(path).encode(text.fill_null(""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of rows (doc_id, ids); narrow."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [segmenter(path).decode(np.frombuffer(b or b"", HELD)) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (of 32-bit little-endian ids), decoded_sha256, round_trip."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, blob in zip(batch.column("text").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(blob, HELD)
                back = segmenter(path).decode(ids)
                out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (text or "")))
            n, crc, sha, same = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return encode(docs, path).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return report(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
