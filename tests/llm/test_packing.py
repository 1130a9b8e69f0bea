import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from prosa.llm import packing


@pytest.fixture(scope="module")
def vocabulary():
    return packing.public_vocabulary("byte_bpe_50k.json")


ODD = ["", " ", "a", " a", "a ", "a  b", "\n a\n\nb c ", "x \n y", "it's  we'll 12 a1 b!?  \t\n z", "a\x00 b", "  lead", "trail  ", "a \x1c b", "\x85 a b", "a b  c", "日本 語", "<|endoftext|> x", "x<|endoftext|>"]


def test_ids_equal_the_tokenizer_over_whole_texts(vocabulary):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cé.\n 1'!\t") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    tokenizer = Tokenizer.from_file(vocabulary)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.encode_texts(texts, vocabulary, 50) == want and packing.encode_texts(texts, vocabulary, 50) == want


def bins_of(plan):
    bins = {}
    for length, stretches in plan.items():
        rank = 0
        for a, b, base, offset in stretches:
            assert a == rank and b > a
            rank = b
            for k in range(b - a):
                bins.setdefault(base + k, []).append((offset, length))
    return bins


def test_plans_are_gapless_and_close_to_the_bound():
    rng = random.Random(4)
    for case in range(60):
        capacity = rng.choice((12, 100, 2048))
        counts = dict(Counter(min(capacity, 1 + int(rng.expovariate(rng.choice((3, 10)) / capacity))) for _ in range(rng.randint(0, 3000))))
        bins = bins_of(packing.plan(counts, capacity))
        assert Counter(n for items in bins.values() for _, n in items) == Counter(counts)
        for items in bins.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= capacity and sum(3 * n > capacity for _, n in items) <= 2 or capacity == 12
        sizes = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        gaps = []  # best-fit decreasing, one piece at a time
        for n in sizes:
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(capacity - n)
        assert len(bins) <= len(gaps) * 1.02 + 1


def test_pack(spark, vocabulary):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "delta's", "12")) for _ in range(rng.choice((1, 40, 700, 2047, 2048, 5000))))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same text"), (102, "same text"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as piece")
    got = packing.pack(docs, packing.PackingOptions(vocabulary)).collect()
    tokenizer = Tokenizer.from_file(vocabulary)
    want = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) * 1.1 + 1
    assert packing.pack(docs.limit(0), packing.PackingOptions(vocabulary)).count() == 0


def test_equal_rows_are_dealt_to_many_buckets(spark):
    """Rows that are equal in all columns get the ranks 0, 1, 2, ... and no bucket holds most of them."""
    from pyspark.sql import functions as F

    pieces = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(7).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"), F.col("id").alias("salt"))
    assert sorted(r["rank"] for r in packing.ranked(pieces, 64).collect()) == list(range(4000))
    dealt = pieces.groupBy(F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt"), F.lit(64))).count().collect()
    assert len(dealt) == 64 and max(r["count"] for r in dealt) < 200


def test_texts_encoded_together_have_the_ids_of_each_alone():
    """Whatever the groups and however often the caches are emptied, ids are those of the tokenizer over the whole text."""
    path = packing.public_vocabulary("byte_bpe_50k.json")
    cache = packing.worker_cache(f"chunks {path}")
    cache.clear()
    texts = ["the cat and the dog " * 3] + [f"the zq{i}x and wv{i}k  end" for i in range(60)] + ["", " ", "a", " a", "a ", "\u3000b c\u00a0 d", "x\ny  z"]
    want = [b"".join(i.to_bytes(4, "little") for i in packing.tokenizer_of(path).encode(t, add_special_tokens=False).ids) for t in texts]
    got = [x for i in range(0, len(texts), 9) for x in packing.encode_texts(texts[i : i + 9], path, 20)]
    assert got == want and len(cache) <= 20 + 2 * 9 * 5
    assert packing.encode_texts([], path, 20) == [] and [*packing.groups(["x" * 600_000] * 4 + ["y"] * 5000)] == [(0, 2), (2, 4), (4, 2052), (2052, 4100), (4100, 5004)]


def test_chunks_are_words_without_the_marks_and_lines_around_them(vocabulary):
    """Only what is new is encoded, so a word must be the same chunk whatever follows it."""
    cache = packing.worker_cache(f"chunks {vocabulary}")
    cache.clear()
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(30)]
    texts = ["".join(rng.choice(words) + rng.choice((" ", ". ", ",\n", " (", "!\n\n", ") ")) for _ in range(40)) for _ in range(100)]
    tokenizer = Tokenizer.from_file(vocabulary)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.encode_texts(texts, vocabulary, 800_000) == want and len(cache) < 100


def test_cuts_hold_for_any_characters(vocabulary, monkeypatch):
    rng = random.Random(6)
    some = ["a", "Q", "é", "ß", "1", "²", "Ⅷ", "٣", ".", "'", "'s", "'ll", "€", "\u0301", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "\u200b", "\ufeff", "日", "😀", "\x00", "ª", "<|endoftext|>", "endoftext", "|>", "_"]
    texts = ["".join(rng.choices(rng.sample(some, rng.randint(2, len(some))), k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["ab cd. " * 350_000 + "\u3000 x" + "y" * 100]
    tokenizer = Tokenizer.from_file(vocabulary)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(packing, "LONGEST_TEXT", 2_000_000)
    assert len(packing.stretches(texts[-1])) == 3 and "".join(packing.stretches(texts[-1])) == texts[-1]
    assert packing.encode_texts(texts[:1500], vocabulary, 800_000) + packing.encode_texts(texts[1500:], vocabulary, 800_000) == want
    assert max(map(len, packing.worker_cache(f"chunks {vocabulary}"))) <= 4 * packing.LONGEST_CHUNK
