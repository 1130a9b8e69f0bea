import random
import re
import zlib

import numpy as np
import pytest

from prosa.llm import quality_classifier as qc, quality_rules as qr
from prosa.llm.text_stats import COUNTS, counts_of

SPACE = " \t\n\x0b\x0c\r"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(1)
    cases = [None, "", " \n\t", "a", "é ü x #|<", "a b c a b c", "x\nx\n x\n\nx\n", "a a a a"]
    cases += ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for text in cases:
        assert counts_of((text or "").encode())[0] == brute_counts(text), repr(text)


def corpus(spark, n=400, every=5):
    """Documents of which each `every`-th one is bad."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        bad = i % every == 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(60, 200)))
        if bad:
            text = " ".join(w + rng.choice(("***", "&&&", "###")) for w in text.split()) if i % 2 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "x", f"s{i % 3}", len(text)))
        if i % 4:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[0] % every != 0 for r in rows}


def test_forest_path_lengths_equal_a_walk_of_each_tree():
    rng = np.random.default_rng(0)
    options = qr.RulesOptions(trees=5, sample=64)
    forest = qr.grow_forest(rng.normal(size=(300, 14)), options)
    rows = rng.normal(size=(20, 14)) * 2
    want = []
    for row in rows:
        total = 0.0
        for tree in forest:
            at = 0
            while tree[at, 0] >= 0:
                at = int(tree[at, 2] if row[int(tree[at, 0])] < tree[at, 1] else tree[at, 3])
            total += tree[at, 4]
        want.append(2 ** (-total / 5 / qr.mean_path(64)))
    assert qr.anomaly(forest, rows, options) == pytest.approx(np.array(want))


def test_rules_reject_anomalies_and_keep_clean_documents(spark):
    docs, labels, good = corpus(spark, every=15)  # anomalies are rare
    got = {r.doc_id: r for r in qr.score_documents(docs, labels).collect()}
    assert len(got) == 400 and not any(r.base_failed for r in got.values())
    assert np.mean([got[i].kept for i in good if good[i]]) > 0.98
    assert np.mean([got[i].kept for i in good if not good[i]]) < 0.1
    kept = qr.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_classifier_on_held_out_rows(spark):
    docs, labels, good = corpus(spark)
    got = {r.doc_id: r for r in qc.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([bool(got[i].predicted) == good[i] for i in good if got[i].held_out]) > 0.95
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert {r.doc_id: r.score for r in qc.score_documents(docs, flipped).collect()} == {i: r.score for i, r in got.items()}  # held-out labels are never read
    assert {r.doc_id for r in qc.filter_documents(docs, labels).collect()} == {i for i, r in got.items() if r.predicted}


def test_isotonic_means():
    x, v = qc.pool_adjacent(np.arange(6.0), np.array([0.0, 2.0, 1.0, 3.0, 1.0, 4.0]), np.full(6, 4.0))
    assert (np.diff(v) > 0).all() and v == pytest.approx([0, 0.375, 0.5, 1.0])


@pytest.mark.parametrize("score", [qr.score_documents, qc.score_documents])
def test_edge_rows(spark, score):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w " * 30000), (3, "w " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as score", "2 as n_words")
    assert score(docs, labels).count() == 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score(empty, labels).count() == 0 and score(docs, labels.limit(0)).count() == 5


def test_rules_columns(spark):
    docs, labels, _ = corpus(spark, 30)
    assert qr.score_documents(docs, labels).columns[:8] == ["doc_id", *COUNTS, "base_failed", "kept"]


def test_the_threshold_is_the_best_of_all_cuts():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.randrange(qr.BINS), rng.randrange(2), rng.randint(1, 5)) for _ in range(rng.randint(1, 40))]
        weight = rng.choice((0.5, 1.0, 20.0))
        sums = [sum(n for _, q, n in rows if q == k) for k in (0, 1)]
        got = qr.choose_threshold(rows, weight)
        if not all(sums):
            assert got == float("inf")
            continue
        gain = lambda cut: sum(n * ((1 - q) / sums[0] - weight * q / sums[1]) for at, q, n in rows if at / qr.BINS >= cut)  # noqa: E731  scores of a bin lie at or above its lower end
        best = max(gain(k / qr.BINS) for k in range(1, qr.BINS + 2))
        assert gain(got) == pytest.approx(best) if best > 1e-12 else got == float("inf") or gain(got) == pytest.approx(best)


def test_the_pool_is_bounded_and_counts_equal_rows_once(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(qr, "grow_forest", lambda pool, options: sizes.append(len(np.unique(pool, axis=0))) or sizes.append(len(pool)) or [])
    rows = [(1, "the same text " * 20)] * 3000 + [(i, f"own text {i} " * (1 + i % 9)) for i in range(2, 302)]
    stats = qr.document_stats(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    qr.fit(stats, labels, qr.RulesOptions(pool=100))
    qr.fit(stats, labels)
    assert sizes[1] == 100 and sizes[3] == 301


def brute_isotonic(y, n):
    """Level of each place: the largest of all left ends' least mean up to a right end."""
    return [max(min(sum(y[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]


def test_isotonic_levels_equal_the_minmax_formula():
    rng = random.Random(2)
    for _ in range(100):
        n = [float(rng.randint(1, 5)) for _ in range(rng.randint(1, 12))]
        y = [float(rng.randint(0, int(k))) for k in n]
        _, values = qc.pool_adjacent(np.arange(len(n), dtype=float), np.array(y), np.array(n))
        assert sorted(set(np.round(values, 9))) == sorted(set(np.round(brute_isotonic(y, n), 9)))


def test_scores_equal_a_plain_ridge_solution_and_isotonic_levels(spark):
    """The whole fit from rows in one array: features, ridge by least squares on stacked rows, levels by the min-max formula."""
    docs, labels, _ = corpus(spark, 240)
    options = qc.ClassifierOptions(dimensions=40)
    stats = qc.document_stats(docs)
    model = qc.fit(stats, labels, options)
    marked = labels.selectExpr("doc_id", "cast(quality as double) as y", "pmod(xxhash64(doc_id, 'calibrate'), 1000) < 200 as calibrate")
    rows = [r for r in stats.join(marked, "doc_id").select("doc_id", "y", "calibrate", *qc.FEATURES).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    x, y, later = np.array([tuple(r)[3:] for r in rows]), np.array([r.y for r in rows]), np.array([r.calibrate for r in rows])
    mean, deviation = x[~later].mean(0), x[~later].std(0)
    z = np.clip((x - mean) / np.where(deviation > 1e-9, deviation, 1.0), -8, 8)
    rng = np.random.default_rng(options.seed)
    d = len(qc.FEATURES)
    weights, phases = rng.normal(size=(d, 40)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, 40)
    f = np.column_stack([np.sqrt(2 / 40) * np.cos(z @ weights + phases), np.ones(len(z))])
    penalty = np.sqrt(options.ridge * (~later).sum()) * np.diag(np.r_[np.ones(40), np.sqrt(1e-9)])
    beta = np.linalg.lstsq(np.vstack([f[~later], penalty]), np.r_[y[~later], np.zeros(41)], rcond=None)[0]
    assert model.raw(x) == pytest.approx(f @ beta, abs=1e-6)
    bins = np.clip(np.floor((f[later] @ beta + 0.5) / 2 * qc.BINS), 0, qc.BINS - 1)
    own = np.unique(bins)
    levels = brute_isotonic([y[later][bins == b].sum() for b in own], [float((bins == b).sum()) for b in own])
    assert sorted(set(np.round(model.values, 9))) == sorted(set(np.round(levels, 9)))
    scores = model.score(x)
    order = np.argsort(model.raw(x))
    assert (np.diff(scores[order]) >= 0).all() and scores.min() >= 0 and scores.max() <= 1


def test_a_fit_on_labelled_documents_alone_equals_one_on_all(spark):
    docs, labels, _ = corpus(spark, 150)
    docs = docs.unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").limit(3))
    few = qc.labelled_stats(docs, labels)
    assert 0 < few.count() == qc.training_labels(labels).count() < docs.count()
    own, want = qc.fit(few, labels), qc.fit(qc.document_stats(docs), labels)
    assert own.beta == pytest.approx(want.beta, abs=1e-9) and own.knots == pytest.approx(want.knots) and own.values == pytest.approx(want.values)
