import random
import re

from keyloom.llm import licenses as L


def shingles(text, length=5):
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
    return {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}


def check(df, templates=L.TEMPLATES):
    want = []
    for r in df.select("doc_id", "text").collect():
        for name, text in templates.items():
            length = min(5, len([w for w in re.split("[^a-z0-9]+", text.lower()) if w]))
            need, have = shingles(text, length), shingles(r["text"], length)
            if length and len(need & have) >= 0.8 * len(need):
                want.append(str((r["doc_id"], name, round(len(need & have) / len(need), 9))))
    got = L.scan(df, templates).collect()
    assert sorted(str((r["doc_id"], r["template"], round(r["containment"], 9))) for r in got) == sorted(want)
    return got


def test_equals_exact_containment(docs, odd):
    assert check(docs)
    assert check(odd)


def test_long_templates_in_altered_copies(spark):
    rows = []
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        words = text.split()
        if len(words) > 20:
            words[len(words) // 2] = "CHANGED"
        rows.append((i, "Some words ahead of it, seven. " * (i % 4) + " ".join(words).upper() + " and after"))
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r["doc_id"] for r in got}) >= len(rows) - 2
    one = next(r for r in got if r["template"] == "mit-notice" and r["doc_id"] == list(L.TEMPLATES).index("mit-notice"))
    assert (one["first_word"], one["last_word"]) == (13, 17)


def test_altered_copies_that_keep_four_fifths_are_always_found(spark):
    """Words changed, added and left out at random while 0.8 of the shingles stay."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = rng.choice([t for t in L.TEMPLATES.values() if len(t.split()) > 14]).split()
        for _ in range(rng.randrange(1, 2 + len(words) // 28)):
            at, how = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (how != 1)] = [] if how == 2 else [f"new{rng.randrange(99)}"]
        rows.append((i, "before it " + " ".join(words) + " after it"))
    assert len(check(spark.createDataFrame(rows, "doc_id long, text string"))) > 120


def test_templates_of_few_words(spark):
    templates = {"one": "Copyleft", "three": "All rights reserved.", "none": "...", "six": "all of these words are here"}
    rows = [(1, "ALL RIGHTS  reserved"), (2, "all rights are reserved"), (3, "copyleft, all rights reserved; copyleft"), (4, None), (5, "all of these words are here")]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), templates)
    assert {(r["doc_id"], r["template"], r["first_word"], r["last_word"]) for r in got} == {(1, "three", 1, 3), (3, "one", 1, 1), (3, "three", 2, 4), (5, "six", 1, 6)}


def test_empty(none):
    assert L.scan(none).collect() == []


def test_no_python_on_the_path(docs):
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
