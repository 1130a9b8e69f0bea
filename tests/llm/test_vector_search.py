import numpy as np

from prosa.llm import vector_search as vs


def brute(rows, k=5):
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for q in x:
        if q % 50 == 0:
            best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q and len(x[i]) == len(x[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=8) * 0.3]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # one common vector, ties by id
    rows += [(2000, None), (2001, []), (2050, [float("nan")] * 8), (2051, [None] * 8), (None, rows[0][1]), (2100, [1.0, 2.0]), (2101, [0.5, -1.0]), (3000, [float("inf")] * 8), (3050, [1e-9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score").repartition(5)
    exact = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    for options in (vs.SearchOptions(), vs.SearchOptions(block=64, group=3, at_once=2, first_read=6, cells=2)):
        got = sorted(map(tuple, vs.top_k(df, options).collect()))
        assert got == brute(exact)
    repeated = vs.top_k(df.unionByName(df)).collect()
    assert sorted(map(tuple, repeated)) == brute(exact)
    assert vs.top_k(df.limit(0)).count() == 0
    assert sorted(map(tuple, vs.top_k(df.where("vec_id in (50, 51)")).collect())) == brute([r for r in exact if r[0] in (50, 51)])


def test_rows_that_share_an_id_all_count(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [3.0, 0.0]), (7, [0.0, 2.0])]
    got = sorted((r.score, r.rank, r.vec_id) for r in vs.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    one = 256 * 256
    assert got == sorted([(3 * one, 1, 7), (0, 2, 7), (0, 3, 50), (2 * one, 1, 7), (0, 2, 7), (0, 3, 50)])


def test_large_components_are_scored_with_whole_numbers(spark):
    """Up to the largest doubles: ranks are those of whole numbers of any size, scores end at the range of a long."""
    rng = np.random.default_rng(3)
    for size in (3e7, 1e19, 1e150, 1e300):
        rows = [(i, [float(c) for c in rng.normal(size=4) * size]) for i in range(120)] + [(200 + i, [float(c) for c in rng.normal(size=4)]) for i in range(30)]
        x = {i: [int(np.floor(256.0 * c)) if abs(c) < 1e15 else int(c) * 256 for c in v] for i, v in rows}
        want = []
        for q in x:
            if q % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:5]
                want += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(best)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        assert sorted(map(tuple, vs.top_k(df, vs.SearchOptions(block=32, first_read=4)).collect())) == sorted(want), size
    over = spark.createDataFrame([(0, [1e308, 1.0]), (50, [1.0, 1.0]), (51, [2.0, 0.5])], "vec_id long, embedding array<double>")  # the 256-fold of 1e308 is no double
    assert [tuple(r) for r in vs.top_k(over).collect()] == [(50, 1, 51, 65536 * 2 + 32768)]


def test_keys_of_scores_beyond_a_long_keep_their_order():
    scores = [0, 5, -5, 2**63 - 1, 2**63, 2**64, 10**40, -(2**63), -(2**63) - 1, -(10**40), -(10**39)]
    order = sorted(scores, key=lambda s: (min(max(s, vs.LEAST_LONG), vs.MOST_LONG), vs.far(s)))
    assert order == sorted(scores)


def test_many_lengths_and_a_long_vector(spark):
    rows = [(i, [1.0] * (1 + i % 37)) for i in range(200)] + [(1000, [0.5] * 20_000), (1001, [0.25] * 20_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vs.top_k(df, vs.SearchOptions(block=7)).collect())) == brute(rows)
