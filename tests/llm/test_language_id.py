import random
import zlib

import numpy as np
from wattloom.llm import language_id
from wattloom.llm.common import load
from wattloom.llm.language_id import ORDER, distinct_grams, fit, fit_weights, grams, has_letter, held_out, op3_language_id, predict, with_landmarks

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_predicted(spark):
    rows = op3_language_id(spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == load(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_edges(spark):
    docs = load(spark, SF, "documents")
    model = fit(docs.where(~held_out()))
    odd = [(1, None, "x"), (2, "", "x"), (3, "123 $%", "x"), (4, "the and of thing the " * 90_000, "y"), (5, "the and of thing", "y"), (5, "the and of thing", "y")]
    got = predict(spark.createDataFrame(odd, "doc_id long, text string, language string"), model).select("doc_id", "language.*").collect()
    assert [(r.lang_pred, r.score) for r in got if r.doc_id < 4] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in got if r.doc_id >= 4] == ["en"] * 3 and got[-1] == got[-2]
    assert predict(docs.limit(0), model).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    none = fit(docs)
    assert [r.language.lang_pred for r in predict(docs, none).collect()] == ["und", "und"]
    one = fit(docs.fillna({"lang": "en"}))
    assert [r.language.lang_pred for r in predict(docs, one).orderBy("doc_id").collect()] == ["en", "und"]


def plain_grams(text):
    """The n-grams as strings: every run of non-letters is one space, with one at either end."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    whole = "".join(f" {w}" for w in words) + " "
    return {whole[i : i + n] for n in range(1, ORDER + 1) for i in range(len(whole) - n + 1)}


def plain_model(rows, landmarks):
    """(languages, scoring function): the whole method over Python sets and dense algebra."""
    sets = [plain_grams(t) for t, _ in rows]
    marks = [sets[i] for i in landmarks]
    known = set().union(*marks)

    def kernel(s):
        s = s & known
        return [len(s & m) / (max(1, len(s)) * max(1, len(m))) ** 0.5 for m in marks]

    k = np.array([kernel(s) for s in sets])
    values, vectors = np.linalg.eigh(k[landmarks])
    root = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5)
    languages = sorted({lang for _, lang in rows})
    y = np.array([[1.0 if lang == b else -1.0 for b in languages] for _, lang in rows])
    x = k @ root
    w = root @ np.linalg.solve(x.T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ y)
    return languages, lambda text: np.array(kernel(plain_grams(text))) @ w


def same(texts):
    return [np.unique(np.concatenate([np.zeros(0, np.uint64), *grams(t)])).tolist() for t in texts]


def test_grams_are_those_of_the_plain_version(monkeypatch):
    texts = ["Ab, c!", "ab ** C", "a" + " " * 9 + "b" * 70, "ΑΣ ΑΣΑ", "x" * 34 + "  9 " + "é中 q", "İstanbul\n\n I", " lead", "trail ", "\U00020000 z"]
    whole = same(texts)
    assert whole[0] == whole[1]
    for text, found in zip(texts, whole, strict=True):
        assert len(found) == len(plain_grams(text))
    for piece in (1, 2, 5, 35, 36):  # borders inside words and inside runs of non-letters
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert same(texts) == whole
    assert not has_letter("1 2") and not has_letter(None) and has_letter("1 ż")


def test_scores_equal_the_plain_method(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents").where("lang is not null and text rlike '\\\\p{L}'")
    rows = sorted({(r.text, r.lang) for r in docs.select("text", "lang").collect()})
    model = fit(spark.createDataFrame(rows, "text string, lang string"), per_language=40, landmarks=8)
    hashed = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "xxhash64(text) as h").collect()
    sample, marks = [], []
    for lang in sorted({r.lang for r in hashed}):
        own = sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:40]
        marks += range(len(sample), len(sample) + min(8, len(own)))
        sample += [(r.text, r.lang) for r in own]
    languages, score = plain_model(sample, marks)
    assert model.languages == languages
    for text, _ in rows:
        want = score(text)
        got = model.kernel([text])[0] @ model.weights
        assert np.allclose(got, want, atol=1e-9)
        assert model.scores([text])[0] == [languages[int(want.argmax())]]


def test_a_language_with_few_texts_keeps_its_ngrams():
    rng = random.Random(8)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(n))
    large = {"aa": "abcdefghijklm", "bb": "nopqrstuvwxyz", "cc": "бвгджзклмнпр"}
    small = "αβγδε ζηθικ λμνξο πρστυ"
    rows = [(text(letters, 400), lang) for lang, letters in large.items() for _ in range(30)] + [(small, "zz")]
    model = with_landmarks([distinct_grams(t) for t, _ in rows])
    assert len(model.known) == len(set().union(*(plain_grams(t) for t, _ in rows)))
    kernel = model.kernel([t for t, _ in rows])
    model.languages, model.weights = fit_weights(kernel, kernel, [lang for _, lang in rows])
    assert model.scores(["λμνξο πρστυ αβγδε", text(large["aa"], 20)])[0] == ["zz", "aa"]


def test_many_or_few_landmarks_fit_one_matrix(monkeypatch):
    texts = [f"text number {'abcdef'[i % 6] * (i % 5 + 1)}" for i in range(50)] + [None, ""]
    model = with_landmarks([distinct_grams(t) for t in texts[:20]])
    whole = model.kernel(texts)
    monkeypatch.setattr(language_id, "CELLS", 1)
    assert (model.kernel(texts) == whole).all() and not whole[-2:].any()


def test_ties_repeats_and_clashing_names(spark):
    rows = [("same words here", "b"), ("same words here", "a")] * 400 + [("other letters zzz", "c")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = fit(docs.unionByName(docs))
    assert model.languages == ["a", "b", "c"]
    odd = spark.createDataFrame([("same words here", 1, 2, 3), ("zzz", 1, 2, 3)], "text string, language int, lang int, h int")
    got = predict(odd, model)
    assert got.columns == ["text", "language", "lang", "h"]
    assert [r.language.lang_pred for r in got.collect()] == ["a", "c"]
