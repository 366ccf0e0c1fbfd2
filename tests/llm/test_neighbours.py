import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import neighbours as N


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def answers(df, **how):
    got = {}
    for r in N.nearest(df, F.col("id") % 50 == 0, **how).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows), answers(df)
    assert set(got) == set(want)
    hits = 0
    for q, near in got.items():
        assert [r for r, _, _ in near] == [1, 2, 3, 4, 5]
        exact = dict(brute([*[x for x in rows if x[0] == q], *[x for x in rows if x[0] in {i for _, i, _ in near}]], 5)[q])
        assert all(abs(exact[i] - s) < 1e-12 for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def test_small_table_is_searched_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # copies of a query's vector, some of them queries
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), answers(df)
    assert {q: [i for _, i, _ in v] for q, v in got.items() if q in (50, 100)} == {q: [i for i, _ in v] for q, v in want.items() if q in (50, 100)}
    assert [i for _, i, _ in got[0]] == [200, 201, 202, 203, 204] and [i for _, i, _ in got[200]] == [0, 201, 202, 203, 204]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 1.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [None, 1.0], "x"), (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [], "x"), (None, [1.0, 0.0], "x"), (50, [0.0, 2.0], "x"), (50, [0.0, 2.0], "y"), (8, [1.0, 2.0, 3.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = answers(df)
    assert [i for _, i, _ in got[0]] == [1, 50] and [i for _, i, _ in got[50]] == [1, 0]


def test_empty(spark):
    assert answers(spark.createDataFrame([], "vec_id long, embedding array<float>")) == {}


def test_an_ascent_goes_over_partitions(spark, monkeypatch):
    """One tree of many partitions and an ascent over all rows: the answer is exact."""
    monkeypatch.setattr(N, "PART_ROWS", 700)
    x = np.random.default_rng(5).normal(size=(6000, 4))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in N.nearest(df, F.col("id") % 500 == 0, trees=1, candidates=6000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(0, 6000, 500))
    for q, near in got.items():
        score = unit @ unit[q]
        score[q] = -2
        assert [i for _, i in sorted(near)] == np.argsort(-score)[:5].tolist()


def test_trees_ascend_together(spark, monkeypatch):
    """The rows found are the best of those that share, in some tree, as many first bits as the deepest level with enough."""
    monkeypatch.setattr(N, "PART_ROWS", 500)
    trees, least = 4, 200
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 6)) + (rng.random((1500, 1)) < 0.3) * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    moved = (unit - unit.mean(axis=0)).astype(np.float32)
    bits = [moved @ N._planes(t, 6) > 0 for t in range(trees)]
    got = {}
    for r in N.nearest(df, F.col("id") % 100 == 0, trees=trees, candidates=least).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    same = 0
    for q in range(0, 1500, 100):
        shared = np.array([np.where((b == b[q]).all(axis=1), 64, (b != b[q]).argmax(axis=1)) for b in bits])
        shared[:, q] = -1
        for t in range(trees):  # no tree goes beyond so many places on either side
            key = [tuple(r) for r in bits[t].tolist()]
            order = sorted(range(1500), key=lambda i: (key[i], i))  # noqa: B023
            at = order.index(q)
            shared[t, [i for k, i in enumerate(order) if abs(k - at) > least]] = -1
        level = next(v for v in range(64, -1, -1) if (shared >= v).sum() >= least)
        score = np.where((shared >= level).any(axis=0), unit @ unit[q], -2)
        same += [i for _, i in sorted(got[q])] == np.argsort(-score)[:5].tolist()
    assert same >= 14  # a sign at zero may fall otherwise in another order of sums


def test_recall_with_contrast_at_fixed_work(spark):
    """Vectors in groups: candidates for a tenth of all rows, repeats counted, find nearly all."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.35 * rng.normal(size=(20_000, 32))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want, got = brute([r for r in rows], 5), answers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), candidates=2_000)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
