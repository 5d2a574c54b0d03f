import random
import struct

import pytest

from kinetable.llm import subword as U


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores as a unigram model of the library."""
    import sentencepiece

    pieces = U.read_pieces(U.MODEL)
    proto = b"".join(
        field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(t)) for (p, _, t), s in zip(pieces, U.zipf_scores(pieces))
    )
    with open(U.MODEL, "rb") as f:
        for number, value in U._fields(f.read()):
            if number == 2:
                own = b""
                for n, v in U._fields(value):
                    v = 1 if n == 3 else v
                    own += (varint(n << 3 | 5) + v if n in (10, 15, 51) else field(n, v)) if isinstance(v, bytes) else varint(n << 3) + varint(v)
                proto += field(2, own)
            elif number != 1:
                proto += field(number, value) if isinstance(value, bytes) else varint(number << 3) + varint(value)
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def test_same_paths_as_the_library(library):
    model, rng = U.load(), random.Random(3)
    alphabet = ["a", "the", "  ", " ", "\n", "é", "🙂", "漢", "xyz", "ing", "​", "T", "0", "▁", "\t", "qq"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    score = lambda ids: sum(model.scores[k] for k in ids)
    same = 0
    for text, ids in zip(texts, model.encode([t.encode() for t in texts], {})):
        told = library.encode(text)
        same += told == ids.tolist()
        assert score(told) == pytest.approx(score(ids.tolist()))  # equal but for ties
    assert same >= 290


def test_long_and_short_ways_agree():
    model, rng = U.load(), random.Random(4)
    words = [" " + "".join(rng.choice("abcdeé🙂 ") for _ in range(rng.randint(0, 15))).strip() for _ in range(300)]
    assert [model._one(w.encode()[:64]) for w in words] == [model.encode_parts([w.encode()[:64]])[w.encode()[:64]] for w in words]


def test_round_trip(spark, docs, empty, texts):
    got = U.encode_and_check(docs).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    assert U.encode_and_check(empty).count() == 0
    again = U.decode_ids(U.encode_texts(docs))
    assert sorted(str((r.doc_id, r.text)) for r in again.collect()) == sorted(str((i, t or "")) for i, t in texts)
    odd = spark.createDataFrame([(1, "a▁b"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.round_trip, r.n_ids > 0) for r in U.encode_and_check(odd).orderBy("doc_id").collect()] == [(1, False, True), (2, True, False)]
    strange = spark.createDataFrame([(1, [-5, 10**6, None]), (2, None)], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.text) for r in U.decode_ids(strange).orderBy("doc_id").collect()] == [(1, ""), (2, None)]
