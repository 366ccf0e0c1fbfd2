import re
from collections import defaultdict

from pyspark.sql import functions as F

from keyloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes):
    """Targets by the rule itself: shares by weight, capped, the excess reshared until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: 3.0 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def check(df):
    got = mixing.mix(df).collect()
    text_of = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
    assert sorted(map(str, ((i, len(WORD.findall(t or "")), s) for i, t, s in text_of))) == sorted(map(str, ((r["doc_id"], r["size"], r["source"]) for r in got)))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = expected_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, r["target"])
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9) or abs(taken[s] - want[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    return got


def test_targets_and_exact_budgets(docs):
    check(docs)


def test_odd_rows(odd):
    check(odd)


def test_a_small_source_stops_at_three_passes(spark):
    rows = [(i, "w " * 1000, "b") for i in range(20)] + [(100, "one two", "a")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert [r["taken"] for r in got if r["source"] == "a"] == [6]


def test_empty(none):
    assert mixing.mix(none).collect() == []
    assert mixing.mixed(none).collect() == []


def test_mixed_corpus_follows_taken(odd, docs):
    for df in (docs, odd):
        taken = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()
        out = mixing.mixed(df)
        assert out.columns == df.columns
        words = defaultdict(int)
        for r in out.collect():
            words[r["source"]] += len(WORD.findall(r["text"]))
        assert {r["source"]: r["n"] for r in taken if r["n"]} == dict(words)


def test_no_python_on_the_path(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
