import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from wattloom.llm.common import load
from wattloom.llm.sentencepiece_viterbi import BLANK, Segmenter, decode, encode, op1_sentencepiece, report, stream

PATH = public_tokenizers.path("piece_bpe_32k.model")
S = Segmenter(PATH)
ODD = ["", " ", "a", " a  b ", "Hello   world é 中\n\tx", "\n\n", "x" * 3000, "日本語🙂", "ab\x02c d", "tail \n", "don't,stop."]


def plain(text):
    """Viterbi over the whole text at once."""
    if not text:
        return []
    t, v = BLANK + text.replace(" ", BLANK), S.vocabulary
    best, back = [0.0] + [None] * len(t), [None] * (len(t) + 1)
    for i in range(len(t)):
        single = False
        for n in range(1, v.longest + 1):
            k = v.prefixes.get(t[i : i + n], -1) if i + n <= len(t) else -1
            if k >= 0:
                single |= n == 1
                if best[i + n] is None or best[i] + v.score[k] > best[i + n]:
                    best[i + n], back[i + n] = best[i] + v.score[k], (i, [k])
        if not single and (best[i + 1] is None or best[i] + v.least - 10 > best[i + 1]):
            best[i + 1], back[i + 1] = best[i] + v.least - 10, (i, v.characters(t[i]))
    out, i = [], len(t)
    while i:
        i, ids = back[i]
        out[:0] = ids
    return out


def test_streaming_equals_the_whole_search():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aeionstr hl\n,") for _ in range(rng.randrange(200))) for _ in range(150)]
    for t in texts:
        assert S.whole(t) == plain(t)
    got = [np.frombuffer(x, "<u2").tolist() for x in S.encode(pa.array(texts))]
    assert got == [plain(t) for t in texts]


def test_words_equal_the_librarys_unigram_search():
    raw = sentencepiece.SentencePieceProcessor(model_file=PATH).serialized_model_proto()
    try:
        from sentencepiece import sentencepiece_model_pb2 as pb
    except Exception:
        pytest.skip("the model's message type is not installed")
    proto = pb.ModelProto.FromString(raw)
    proto.trainer_spec.model_type = 1
    unigram = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = lambda ids: sum(S.vocabulary.score[i] for i in ids)
    for t in ["the and of thing", "Thtionoues erreoror whed", "segmentation", "été où naïve", "a b c"]:
        best = max(unigram.nbest_encode_as_ids(t, 20), key=score)  # of the lattice
        assert score(plain(t)) == score(best) >= score(unigram.encode(t))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_comes_back(text):
    [ids] = S.encode(pa.array([text]))
    if BLANK not in text:
        assert S.decode(np.frombuffer(ids, "<u2")) == text


def test_ids_are_committed_while_reading():
    read = 0

    def characters():
        nonlocal read
        for c in BLANK + BLANK.join(["the", "thing"] * 5000):
            read += 1
            yield c

    ids = stream(S.vocabulary, characters())
    next(ids)
    assert read < 200


def test_query_and_edges(spark):
    rows = op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in load(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    for r in rows[:40]:
        ids = plain(texts[r.doc_id])
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    docs = spark.createDataFrame([(1, None, "q"), (None, "a b", "q"), (2, "a b", "q"), (2, "a b", "q")], "doc_id long, text string, ids string")
    assert sorted(r.n_ids for r in report(docs, PATH).collect()) == [0, 2, 2, 2]
    assert sorted(r.text for r in decode(encode(docs, PATH), PATH).collect()) == ["", "a b", "a b", "a b"]
    assert report(docs.limit(0), PATH).collect() == []
