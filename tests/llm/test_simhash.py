import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import simhash as S

WS = " \t\n\x0b\x0c\r"


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in WS[1:]:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def component_of(fps, distance=2):
    f = np.array(fps, dtype=np.uint64)
    label = list(range(len(f)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= distance).tolist() for x in f]
    while changed:
        new = [min(label[j] for j in n) for n in near]
        changed, label = new != label, new
    return label


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprints(docs, odd):
    for df in (docs, odd):
        text = {str((r["doc_id"], r["text"])): r["text"] for r in df.select("doc_id", "text").collect()}
        got = S.fingerprints(df).collect()
        assert sorted(unsigned(r["fp"]) for r in got) == sorted(plain(r["text"] or "") for r in df.select("text").collect())
        assert text


def check(df):
    rows = S.near_duplicates(df).collect()
    label = component_of([unsigned(r["fp"]) for r in rows])
    least = {}
    for r, x in zip(rows, label, strict=True):
        if r["doc_id"] is not None:
            least[x] = min(r["doc_id"], least.get(x, r["doc_id"]))
    assert [r["component"] for r in rows] == [least.get(x) for x in label]
    return rows


def test_components(docs, odd):
    assert len(check(docs)) == docs.count()
    assert len(check(odd)) == odd.count()


@pytest.fixture(scope="module")
def crowd(spark):
    """Fingerprints in dense clouds, chains and at random."""
    rng = np.random.default_rng(5)
    bits = lambda n: sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {int(x) for x in rng.integers(0, 1 << 63, 400)}
    for centre in rng.integers(0, 1 << 63, 3):
        fps |= {int(centre) ^ bits(k % 3) for k in range(150)}
    x = int(rng.integers(0, 1 << 63))
    for _ in range(40):
        fps.add(x)
        x ^= bits(2)
    return sorted(fps)


@pytest.mark.parametrize("most", [2, 8, 64])
def test_links_have_the_components_of_all_pairs(spark, crowd, most):
    signed = [x - (1 << 64) if x >> 63 else x for x in crowd]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = S.links(distinct, most=most)
    for r in edges.collect():
        assert bin(unsigned(r["a"]) ^ unsigned(r["b"])).count("1") <= 2
    labels = {r["node"]: r["label"] for r in S.components(edges).collect()}
    want = component_of(crowd)
    mine = {}
    for x, w in zip(signed, want, strict=True):
        assert mine.setdefault(w, labels.get(x, x)) == labels.get(x, x)
    assert len(set(mine.values())) == len(mine)


def test_allocation():
    costs = [[0, 5, 50, 500], [0, 7, 9, 10], [0, 100, 200, 300]]
    best, ts = S.allocate(costs, 2)
    assert sum(t + 1 for t in ts) == 3 and best == min(costs[0][a] + costs[1][b] + costs[2][c] for a in range(4) for b in range(4) for c in range(4) if a + b + c == 3)


def test_first_of_each(odd, docs, none):
    for df in (odd, docs):
        out = S.first_of_each(df)
        assert out.columns == df.columns
        rows = S.near_duplicates(df).collect()
        groups = {}
        for r, label in zip(rows, component_of([unsigned(r["fp"]) for r in rows]), strict=True):
            groups.setdefault(label, []).append(r["doc_id"])
        want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
        assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in out.select("doc_id").collect())
    assert S.first_of_each(none).collect() == []


def test_empty(none):
    assert S.near_duplicates(none).select(F.col("fp")).collect() == []
