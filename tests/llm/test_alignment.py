import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from wattloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """The contract, a document and a pair at a time, by the libraries' plain calls."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a, of_b = alignment.byte_level(A), alignment.pieces(B)
    docs, held = [], Counter()
    for doc_id, text in rows:
        a, b = (tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(of_a[i] for i in a) != raw or b"".join(of_b[i] for i in b) != raw:
            a, b = [], []
        ends = [np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((of_a, a), (of_b, b))]
        groups, last = [], (0, 0)
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[last[0] : to[0]], b[last[1] : to[1]]))
            last = to
        links = Counter((x, y) for own, other in groups for x in own for y in other)
        held.update(links.keys())
        docs.append((doc_id, a, b, groups, links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for doc_id, a, b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if held[p] == most[p[0]])
        total = sum(n * held[p] for p, n in links.items())
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), best, total, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def texts():
    rng = random.Random(11)
    odd = [None, "", " ", "▁", "a ▁ b", "<|endoftext|>", "x <|endoftext|> y</s><s><unk>", "\n", "\n\n a\tb", " lead", "trail ", "two  blanks", "é漢字🙂", "<0x0A>", "\x00\x01 \x02c", "don't stop", "A.B,C", "word " * 3000, "a" * 9000, "漢" * 900, " x y", "é fi"]
    words = ["the", "thing", "Über", "of", "nn1", "x=y;", "it's", "\n", "1234567", "naïve", "<s>"]
    return odd + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def result(spark, rows, schema="doc_id long, text string, batch int, stripe string, links long"):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], schema).repartition(5)
    return sorted((tuple(r) for r in alignment.align(df, A, B).select(*COLUMNS).collect()), key=str)


def test_like_plain_calls(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "the thing"), (3, "the thing"), (None, "of the thing")]
    assert result(spark, rows) == plain(rows)


@pytest.mark.parametrize("name, value", [("MANY", 3), ("SCORED", 50), ("CELLS", 40), ("TOGETHER", 64)])
def test_small_limits_change_nothing(spark, monkeypatch, name, value):
    monkeypatch.setattr(alignment, name, value)
    rows = [(i, t) for i, t in enumerate(texts())]
    aligner = alignment.Aligner(A, B)
    _, doc, code, many = aligner.align([t or "" for _, t in rows])
    if name == "MANY":  # workers import the module's own value: this one is looked at here
        monkeypatch.undo()
        whole = aligner.align([t or "" for _, t in rows])[1:]
        assert all((x == y).all() for x, y in zip((doc, code, many), whole, strict=True))
    else:
        assert result(spark, rows) == plain(rows)


def test_sha_of_a_known_text(spark):
    [row] = result(spark, [(5, "the thing")])
    assert row[1:5] == (2, 2, 2, 2) and row[-1] == hashlib.sha256(b"262|272;1517|1970").hexdigest()


def test_empty_table(spark):
    assert result(spark, []) == []
