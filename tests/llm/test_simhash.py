import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from prosa.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (id, fingerprint). The smallest id reachable over at most 3 differing bits."""
    label = dict(enumerate(range(len(prints))))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = {k: new if v == old else v for k, v in label.items()}
    groups = {}
    for k, v in label.items():
        groups.setdefault(v, []).append(prints[k][0])
    return [min((x for x in groups[label[k]] if x is not None), default=None) for k in range(len(prints))]


def test_fingerprint_is_the_bit_majority_of_shingle_hashes():
    for text in ("", "one", "one two", "A b  c\nd e F", "x " * 700, "Ünï ÀB c"):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def variants_of(f):
    out = []
    for j, (_, size) in enumerate(simhash.BLOCKS):
        rest = int(simhash.rest_of(np.array([f], np.uint64), j)[0])
        out += [v | j << 60 for v in (rest, *(rest ^ 1 << i for i in range(64 - size)))]
    return out


def test_variants_in_the_plan_are_those_of_the_definition(spark):
    prints = [0, 1, (1 << 64) - 1, 0x8000000000000001, *(random.Random(2).getrandbits(64) for _ in range(50))]
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long").select(simhash.variants(F.col("fp")).alias("v"))
    assert [sorted(r.v) for r in df.collect()] == [sorted(variants_of(f)) for f in prints]


def test_table_of_clusters(spark):
    """The whole operator's links on fingerprints around random centres."""
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice((1, 3, 30))):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 1, 2, 3, 4, 5)))))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct, len(signed))).collect()}
    label = {}
    for s, c in zip(signed, brute_components(list(zip(prints, prints)))):
        label.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in label.values()) and len(set().union(*label.values())) == len(label)


def test_every_pair_within_the_radius_is_linked():
    """Clusters around centres, differing by 0 to 4 bits anywhere, in one block or over blocks, and random walks."""
    rng = random.Random(5)
    for _ in range(15):
        prints = []
        for _ in range(6):
            now = rng.getrandbits(64)
            for _ in range(rng.choice((2, 5, 40))):
                at = rng.choice((range(64), range(21), range(42, 64)))
                now ^= sum(1 << b for b in rng.sample(list(at), rng.choice((0, 1, 2, 3, 3, 4))))
                prints.append(now)
        prints = np.unique(np.array(prints, np.uint64))
        sent = {}
        for f in prints.tolist():
            for v in variants_of(f):
                sent.setdefault(v, []).append(f)
        keys = sorted(sent)
        v = np.array([k for k in keys for _ in sent[k]], np.int64)
        f = np.array([x for k in keys for x in sent[k]], np.uint64)
        forest = {}
        simhash.unite(forest, simhash.links_of_groups(v, f, np.flatnonzero(np.r_[True, v[1:] != v[:-1]])))
        want = brute_components([(x, x) for x in prints.tolist()])
        assert [simhash.root_of(forest, x) if x in forest else x for x in prints.tolist()] == want


def test_long_blocks_use_lookups():
    size, n = 21, 1600
    block = np.unique(np.random.default_rng(3).integers(0, 1 << size, n))
    want = {(int(a), int(b)) for i, a in enumerate(block) for b in block[i + 1 :][np.bitwise_count(block[i + 1 :] ^ a) <= 3]}
    found = {tuple(sorted(x)) for x in simhash.near_blocks(block, block.astype(np.uint64), size)}
    assert len(block) > 1500 and found == want


def test_table_with_nulls_ties_and_copies(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base + " more"), (9, base), (9, base), (1, "something else entirely here"), (7, None), (8, " \n"), (None, base), (2, "Something ELSE entirely here"), (None, "alone in its own group of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as fp", "1 as component_id")
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f, c) for (i, f), c in zip(prints, brute_components(prints))), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted({c for *_, c in want}, key=str)
    assert simhash.keep_one(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    base = " ".join(f"word{i}" for i in range(400))
    other = " ".join(f"other{i}" for i in range(300))
    rows = [(5, base, 1), (5, other, 2), (6, base + " more", 3), (5, other, 4), (None, base + " more", 5), (None, "near nothing else here", 6), (None, "near nothing ELSE here", 7), (None, "far away", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").selectExpr("*", "0 as kept_id", "0 as n", "'x' as again_hash")
    kept = simhash.keep_one(docs).collect()
    found = sorted((str(r.doc_id), (r.text or "").lower()) for r in kept)
    assert found == sorted([("5", base), ("5", other), ("None", "near nothing else here"), ("None", "far away")])
    assert simhash.keep_one(docs).columns == docs.columns


def test_a_very_long_text_and_many_equal_rows(spark):
    long = " ".join(f"w{i % 9973}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), *[(10 + i, "the same few words") for i in range(500)]]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][1] == got[2][1] == 1 and got[1][0] == simhash.fingerprint(long.encode()) and all(got[10 + i][1] == 10 for i in range(500))


def test_hubs_and_full_forests(spark, monkeypatch):
    """A hub with most links, chains, and forests that are sent on early."""
    monkeypatch.setattr(simhash, "MOST_LINKED", 20)
    rng = random.Random(4)
    hub = rng.getrandbits(64)
    prints = {hub, *(hub ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4, 5)))) for _ in range(400)), *(rng.getrandbits(64) for _ in range(50))}
    now = rng.getrandbits(64)
    for _ in range(60):
        now ^= sum(1 << b for b in rng.sample(range(64), 2))
        prints.add(now)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    roots = {r.node: r.root for r in simhash.roots_of(spark.createDataFrame([(s,) for s in signed], "fp long"), len(signed)).collect()}
    label = {}
    for s, c in zip(signed, brute_components(list(zip(prints, prints)))):
        label.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(x) == 1 for x in label.values()) and len(set().union(*label.values())) == len(label)
