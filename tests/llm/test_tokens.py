import random
import zlib

import numpy as np
import pytest
import sentencepiece

from prosa.llm import sentence_pieces as sp, token_counts as tc
from prosa.llm.packing import public_vocabulary


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        size = max((k for k in range(1, len(word) - at + 1) if word[at : at + k] in vocabulary), default=0)
        if not size:
            return 0
        n, at = n + 1, at + size
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(1)
    for _ in range(300):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12))}
        automaton = tc.Automaton(vocabulary)
        for _ in range(40):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_token_counts(spark):
    path = public_vocabulary("byte_bpe_50k.json")
    vocabulary = set(tc.byte_level_vocabulary(path))
    rows = [(1, "The cat, the Élan\nzzqqxx"), (2, None), (3, " \t"), (3, "日本語 " * 20), (None, "a" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words")
    got = sorted(map(tuple, tc.count_tokens(docs, path, cached_words=2).collect()), key=str)
    assert got == sorted(((i, len((t or "").split()), sum(greedy(b" " + w.encode(), vocabulary) for w in (t or "").split()), 0) for i, t in rows), key=str)
    assert tc.count_tokens(docs.limit(0), path).count() == 0


@pytest.fixture(scope="module")
def model():
    return public_vocabulary("piece_bpe_32k.model")


TEXTS = ["", " ", "a", " a", "a ", "a  b", "\n a\n\nb c", "x \n y", "<s> </s> <unk>", "日本 x", "a\tb c", "Hello, world! it's 3.14", "éàü ñ", "\U0001f600 ok", "aaaaaa bbbb", "x" * 3000]


def test_parity_with_the_other_library(model):
    peer = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcde  \n.é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    codec = sp.Codec(model, 100, 1)
    got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert got == peer.encode(texts) and not codec.unlike
    assert [codec.decode(np.array(x, "<u4").tobytes()) for x in got] == texts
    own = [x.ids for x in codec.backend.encode_batch(texts, add_special_tokens=False)]
    assert own == peer.encode(texts)  # the rebuilt backend alone


def field(number, value):
    """A protobuf field."""
    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        import struct

        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_models(tmp_path):
    """A hand-written unigram model with byte fallback, against the sentencepiece library."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("▁a", -2.5, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -4.2, 1), ("▁ab", -4.9, 1), ("ba", -5.0, 1), ("bab", -5.5, 1), ("c", -6.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    model = sp.read_model(str(path))
    assert model.kind == sp.UNIGRAM and model.byte_fallback and len(model.pieces) == len(pieces)
    peer = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 12))) for _ in range(200)] + ["ab é"]
    codec = sp.Codec(str(path), 100, 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == peer.encode(texts)


def test_tables(spark, model):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (1, "repeated"), (1, "repeated"), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    peer = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted((tuple(r) for r in sp.round_trip(docs, model).collect()), key=str)
    crc = lambda t: zlib.crc32(np.array(peer.encode(t), "<u4").tobytes())
    assert got == sorted(((i, len(peer.encode(t or "")), crc(t or ""), 0, True) for i, t in rows), key=str)
    encoded = sp.encode(docs, model)
    assert sorted((tuple(r) for r in sp.decode(encoded, model).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert sp.round_trip(docs.limit(0), model).count() == 0 and sp.encode(docs.limit(0), model).count() == 0


def test_the_ids_are_the_backend_s_and_parity_does_not_depend_on_the_cache(spark, model):
    """Words on which both libraries are made to differ: the backend's ids come back, and each text counts its own ones."""
    one, many = sp.Codec(model, 1_000, 1), sp.Codec(model, 1_000, 4)
    for codec in (one, many):
        right = codec.peer

        class Wrong:
            def encode(self, texts, num_threads):
                return [[*x, 7] if "odd" in t else x for t, x in zip(texts, right.encode(texts, num_threads=num_threads))]

        codec.peer = Wrong()
    texts = ["odd words are odd", "plain words", "odd", "", "two  spaces", "odd  spaces", "odd oddly even " * 200] + [f"word{i} word{i * 7 % 50}" for i in range(500)]
    want = [2, 0, 1, 0, 0, 1, 1 + 199, *[0] * 500]
    for codec in (one, many):
        for _ in range(2):
            found = codec.checked(texts)
            assert [np.frombuffer(x, "<u4").tolist() for x, _ in found] == [x.ids for x in codec.backend.encode_batch(texts, add_special_tokens=False)]
            counts = [n for _, n in found]
            assert counts[:6] == want[:6] and counts[7:] == want[7:]
    assert one.checked(texts) == many.checked(texts)[::1] == [many.checked([t])[0] for t in texts]


def test_a_very_long_text(spark, model):
    text = " ".join(f"w{i % 20011}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = sp.round_trip(docs, model).first()
    ids = sentencepiece.SentencePieceProcessor(model_file=model).encode(text)
    assert (row.n_ids, row.n_unlike, row.round_trip) == (len(ids), 0, True)
