"""Language identification by string kernels, Nyström landmarks and ridge regression.

The kernel of two texts is the blended-spectrum presence kernel: how many of the landmarks' n-grams
occur in both, over the root of the product of how many of them each has. An n-gram is 1 to
ORDER characters of the text in lower case, every run of non-letters being one space, with a space at either end.
Landmarks are sample texts; every n-gram of theirs counts, without a cut by frequency. The Nyström
map of the kernel feeds one-versus-rest kernel ridge regression, and a batch of texts is scored by
matrix products: presence x landmarks x coefficients.

N-grams are compared by 64-bit hashes: two different ones among n are taken for one with a probability
of n * n / 2**65, some 1e-10 for the 30,000 of 192 landmarks, and a text's n-gram for one of theirs with n / 2**64.

Fitting uses a bounded sample: PER_LANGUAGE rows of each language by the order of their texts'
hashes, of which LANDMARKS are landmarks. Scoring reads every text whole.

Defined results: a null text, an empty one and one without a letter get ``und`` with score 0, as
does every text if nothing is labelled; with a single language learned, that one is the answer;
ties go to the language first in name order; repeated rows get equal answers; very long texts are
read in pieces of a million characters, whose n-grams are those of the whole text; other columns pass through,
but one named ``language``, which the answer replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import load, shared_dir, trim, worker_cache

ORDER = 4
PER_LANGUAGE = 300
LANDMARKS = 48
RIDGE = 1e-2
LEAST_EIGENVALUE = 1e-6
UNKNOWN = "und"
PIECE = 1_000_000
#: Texts whose presence is held in one matrix: bounds its entries.
CELLS = 1 << 22
BUCKETS = 20
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def characters(text: str) -> Iterator[np.ndarray]:
    """The text in lower case, runs of non-letters as one space, with one at either end; in pieces."""
    letter, lower, space = _is_letter(), text.lower(), True
    yield np.full(1, 32, np.uint32)
    for at in range(0, len(lower), PIECE):
        codes = np.frombuffer(lower[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[codes]
        kept = known.copy()
        kept[1:] |= known[:-1]
        kept[0] |= not space  # the first of a run of non-letters is kept as its space
        out = np.where(known, codes, 32)[kept]
        if len(out):
            space = bool(out[-1] == 32)
            yield out.astype(np.uint32)
    if not space:
        yield np.full(1, 32, np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text, repeats included, in pieces."""
    tail = np.zeros(0, np.uint32)
    for new in characters(text):
        codes = np.concatenate([tail, new])
        one = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        one ^= one >> np.uint64(31)
        fresh, gram = len(tail), one
        for n in range(1, min(ORDER, len(codes)) + 1):
            if n > 1:
                gram = gram[:-1] * _STEP + one[n - 1 :]
            yield gram[max(0, fresh - n + 1) :]  # those that end in what is new
        tail = codes[-(ORDER - 1) :]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def distinct_grams(text: str) -> np.ndarray:
    found = np.zeros(0, np.uint64)
    for g in grams(text):
        found = np.union1d(found, g)
    return found


@dataclass
class Model:
    """known: sorted hashes of the landmarks' n-grams; landmarks: presence of them, as packed bits; weights: landmarks x languages."""

    languages: list[str]
    known: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def ready(self) -> tuple:
        """(first n-gram of each bucket, the most in a bucket, presence of landmarks, roots of their sizes)."""
        if self._ready is None:
            first = np.searchsorted(self.known >> np.uint64(64 - BUCKETS), np.arange((1 << BUCKETS) + 1, dtype=np.uint64)).astype(np.int32)
            marks = np.unpackbits(self.landmarks, axis=1, count=len(self.known)).astype(np.float32)
            self._ready = first[:-1], int(np.diff(first).max(initial=0)), marks, np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.float64), 1))
        return self._ready

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the known ones among hashes stand in ``known``: by bucket, then by the whole hash."""
        first, most, *_ = self.ready()
        at, n, found = first[hashes >> np.uint64(64 - BUCKETS)], len(self.known), []
        for k in range(most):
            here = np.minimum(at + k, n - 1)
            found.append(here[self.known[here] == hashes])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def kernel(self, texts: list[str | None]) -> np.ndarray:
        """Kernel of texts with landmarks; rows of texts without an n-gram of theirs are zero."""
        *_, marks, root = self.ready()
        out, each = np.zeros((len(texts), len(marks))), max(1, CELLS // max(1, len(self.known)))
        for at in range(0, len(texts), each):
            some = texts[at : at + each]
            present = np.zeros((len(some), len(self.known)), np.float32)
            for i, text in enumerate(some):
                for h in grams(text) if text else ():
                    present[i, self.places(h)] = 1
            size = np.sqrt(np.maximum(present.sum(axis=1, dtype=np.float64), 1))
            out[at : at + each] = (present @ marks.T) / (size[:, None] * root)  # counts below 2**24 are exact
        return out

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [bool(self.languages) and has_letter(t) for t in texts]
        got = self.kernel([t if k else None for t, k in zip(texts, known, strict=True)]) @ self.weights
        best = got.argmax(axis=1) if self.languages else np.zeros(len(texts), int)
        lang = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = [float(min(1, max(0, (g[b] + 1) / 2))) if k else 0.0 for g, b, k in zip(got, best, known, strict=True)]
        return lang, score


def with_landmarks(sets: list[np.ndarray]) -> Model:
    """A model without weights whose landmarks have these distinct n-grams."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]))
    marks = np.zeros((len(sets), len(known)), bool)
    for i, s in enumerate(sets):
        marks[i, np.searchsorted(known, s)] = True
    return Model([], known, np.packbits(marks, axis=1), np.zeros((len(sets), 0)))


def fit_weights(kernel: np.ndarray, marks: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, weights) by ridge regression on the Nyström map; kernel: sample x landmarks, marks: landmarks x landmarks."""
    languages = sorted(set(labels))
    if not len(marks):
        return languages if labels else [], np.zeros((0, len(languages)))
    values, vectors = np.linalg.eigh(marks)
    root = vectors / np.sqrt(np.maximum(values, LEAST_EIGENVALUE))
    mapped = kernel @ root
    wanted = np.array([[1.0 if a == b else -1.0 for b in languages] for a in labels]).reshape(len(labels), len(languages))
    inner = np.linalg.solve(mapped.T @ mapped + RIDGE * np.eye(mapped.shape[1]), mapped.T @ wanted)
    return languages, root @ inner


def _sampled(rows: DataFrame, per_language: int) -> list[tuple[str, int, int]]:
    """(lang, hash, rank) of the least ``per_language`` text hashes of each language.

    Rows are counted first; then only hashes under a threshold that leaves some twice as many as wanted are
    gathered, each once. A language whose repeats leave too few is asked again with four times the threshold.
    """
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    share = {lang: min(1.0, 2 * (per_language + 50) / n) for lang, n in counts.items()}
    out: list[tuple[str, int, int]] = []
    while share:
        limits = [(lang, (1 << 63) - 1 if s >= 1 else int(s * (1 << 64)) - (1 << 63)) for lang, s in share.items()]
        limit = rows.sparkSession.createDataFrame(limits, "lang string, limit long")
        found: dict[str, list[int]] = {lang: [] for lang in share}
        for r in rows.join(F.broadcast(limit), "lang").where("h <= limit").select("lang", "h").distinct().collect():
            found[r.lang].append(r.h)
        for lang, hashes in found.items():
            if len(hashes) >= per_language or share[lang] >= 1:
                out += [(lang, h, n) for n, h in enumerate(sorted(hashes)[:per_language])]
                del share[lang]
            else:
                share[lang] = min(1.0, 4 * share[lang])
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fits on rows (text, lang) of docs with a letter and a language, at most per_language of each language.

    The driver sees the landmarks' n-grams and, of the other sample texts, only their kernel with the landmarks.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    chosen = spark.createDataFrame(_sampled(rows, per_language), "lang string, h long, n int")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "n").agg(F.min("text").alias("text"))

    def marks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = [distinct_grams(t).tobytes() if has_letter(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(sets, pa.binary())], ["lang", "n", "grams"])

    got = sample.where(F.col("n") < landmarks).mapInArrow(marks, "lang string, n int, grams binary").where("grams is not null").collect()
    got.sort(key=lambda r: (r.lang, r.n))
    model = with_landmarks([np.frombuffer(r.grams, np.uint64) for r in got])

    def against(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            good = [has_letter(t) for t in texts]
            kernel = [k.tobytes() if g else None for k, g in zip(model.kernel([t if g else None for t, g in zip(texts, good, strict=True)]), good, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(kernel, pa.binary())], ["lang", "n", "kernel"])

    found = sample.mapInArrow(against, "lang string, n int, kernel binary").where("kernel is not null").collect()
    found.sort(key=lambda r: (r.lang, r.n))
    kernel = np.array([np.frombuffer(r.kernel) for r in found]).reshape(len(found), len(got))
    at = {(r.lang, r.n): i for i, r in enumerate(found)}
    languages, weights = fit_weights(kernel, kernel[[at[r.lang, r.n] for r in got]].reshape(len(got), len(got)), [r.lang for r in found])
    return Model(languages, model.known, model.landmarks, weights)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column ``language`` struct<lang_pred, score>; a name that clashes is replaced."""
    from pyspark.sql.functions import pandas_udf

    shared_dir(docs.sparkSession)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_cache()
        for texts in batches:
            lang, score = model.scores([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        model._ready = None
        trim()

    of = pandas_udf(of, "lang_pred string, score double")
    return docs.withColumn("language", of(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_learnable(docs: DataFrame) -> Model:
    """The model of the rows that are not held out (crc32 of doc_id mod 3 is not 1)."""
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.drop("lang"), fit_on_learnable(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
