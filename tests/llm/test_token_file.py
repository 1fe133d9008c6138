import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from wattloom.llm import tokens
from wattloom.llm.token_file import TokenFile, canonical_codes, code_lengths, decode_table, pack, unpack, write_tokens
from wattloom.llm.tokens import Encoder

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
CONTROL = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|endoftext|>y", "<|ENDOFTEXT|> q", " <|startoftext|> two  <|endoftext|>", "<|endoftext |>", "one\n<|endoftext|>\ntwo"]
ODD = [*CONTROL, "", " ", "a  b", "a \n b", "foo.\nBar baz", "it's  don't 'll x", " a  b", "e ́x", "<|endoftext|> a <|startoftext|>", "ΑΣ ΑΣΑ", "a\u001cb c", "x" * 3000, "  lead", "trail  ", "\u0085 q", "日本 語", "A\u0000 b", " 0 00 a0 b", "tab\t", "x \ty", "end ", "a\u00a0 b"]


def plain(name, texts, control_as_text=False):
    """The library's own call, with nothing set but what is asked for."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if control_as_text:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_pieces_encode_as_the_whole_text(name):
    got = [np.frombuffer(x, "<u2").tolist() for x in Encoder(public_tokenizers.path(name), FILES[name]).encode(pa.array(ODD))]
    assert got == plain(name, ODD)


@pytest.mark.parametrize("name", FILES)
def test_control_strings_are_the_librarys_ids_or_text(name):
    for as_text in (False, True):
        got = [np.frombuffer(x, "<u2").tolist() for x in Encoder(public_tokenizers.path(name), FILES[name], as_text).encode(pa.array(ODD))]
        assert got == plain(name, ODD, as_text)
    assert plain(name, CONTROL, False) != plain(name, CONTROL, True)


def test_long_pieces_are_not_remembered_without_bound(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_CHARS", 1000)
    for name, kind in FILES.items():
        encoder = Encoder(public_tokenizers.path(name), kind)
        for i in range(6):
            texts = [f"x{i}" * 400, "word", f"y{i}" * 300]
            got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(pa.array(texts))]
            assert got == plain(name, texts)
            assert sum(map(len, encoder.known)) <= 4000


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    for name, kind in FILES.items():
        encoder = Encoder(public_tokenizers.path(name), kind)
        for _ in range(3):
            got = [np.frombuffer(encoder.encode(pa.array([t]))[0], "<u2").tolist() for t in [*ODD, "one, two! three\nfour, one\nfive", "four one, six"]]
            assert got == plain(name, [*ODD, "one, two! three\nfour, one\nfive", "four one, six"])


ENCODERS = {n: Encoder(public_tokenizers.path(n), p) for n, p in FILES.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'sdtlAbé́ ​1$.Σ中 ")), max_size=30))
def test_any_text_encodes_alike(text):
    for name, encoder in ENCODERS.items():
        assert np.frombuffer(encoder.encode(pa.array([text]))[0], "<u2").tolist() == plain(name, [text])[0]


def huffman_cost(counts):
    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 1000, 300)
    lengths = code_lengths(counts)
    assert (counts * lengths).sum() == huffman_cost([int(c) for c in counts if c])
    steep = np.array([2**min(i, 50) for i in range(60)])
    lengths = code_lengths(steep, 8)
    assert lengths.max() <= 8 and (0.5 ** lengths.astype(float)).sum() <= 1
    assert code_lengths(np.array([0, 4])).tolist() == [0, 1]


def test_pack_and_unpack():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.02, 5000), 400).astype(np.uint16)
    lengths = code_lengths(np.bincount(ids, minlength=500))
    bits, marks = pack(ids, canonical_codes(lengths), lengths)
    assert unpack(bits, marks, len(ids), decode_table(lengths)).tolist() == ids.tolist()


def test_file_round_trip(spark, tmp_path):
    texts = [*ODD, None, "word " * 200_000, "same", "same"]
    rows = [(90 - i, t, 1, b"x") for i, t in enumerate(texts)] + [(90 - len(texts), "same", 1, b"x"), (None, "no id", 1, b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, ids binary")
    out = str(tmp_path / "file")
    write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, out)
    got = sorted(map(tuple, TokenFile(spark.newSession(), out).documents().collect()), key=lambda r: r[1])
    want, start = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, *_), ids in zip(order, plain("byte_bpe_50k.json", [t or "" for _, t, *_ in order]), strict=True):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    write_tokens(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2, out + "-empty")
    assert TokenFile(spark, out + "-empty").documents().collect() == []
