import pytest
from model import apply, between, operations
from pyspark.sql import functions as F

from keyloom.sources.registry import KeySpace
from keyloom.sources.store import Store
from keyloom.sources.tiers import Tiers


def key(n):
    return (n % 4 << 62 | n).to_bytes(8, "big")


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, str(tmp_path / "db"), [KeySpace("main", key_length=8, cells=4), KeySpace("other", key_length=8)])


def commit(store, batch, ks="main"):
    b = store.batch()
    for kind, k, value in batch:
        b.write(ks, k, value) if kind == "record" else b.delete(ks, k)
    return b.commit()


def held(tiers, ks="main"):
    return sorted((bytes.fromhex(r["k"]), bytes(r["v"])) for r in tiers.state(ks).collect())


def places(tiers, name):
    return {(int(r["k"], 16) >> 62, r["kind"]) for r in tiers.level(name).collect()}


def test_flushes_against_a_sorted_map(store, tmp_path):
    tiers, model = Tiers(store, str(tmp_path / "tiers")), {}
    assert held(tiers) == [] and tiers.flushed() == (0, 0)
    for n, batch in enumerate(operations(seed=7, n=6)):
        commit(store, batch)
        model = apply(model, batch)
        if n % 2:
            assert tiers.flush(limit=3) == tiers.flushed()[0] == n // 2 + 1
        assert held(tiers) == between(model)
    assert tiers.flushed()[1] == store.frontier()


def test_cells_with_many_entries_go_down_and_lose_their_removals(store, tmp_path):
    tiers = Tiers(store, str(tmp_path / "tiers"))
    commit(store, [("record", key(n), b"a") for n in (0, 4, 8, 12, 1, 5)])  # four keys in cell 0, two in cell 1
    tiers.flush(limit=3)
    assert places(tiers, "L1") == {(0, "record")} and places(tiers, "L0") == {(1, "record")}
    commit(store, [("remove", key(0), None), ("record", key(4), b"b")])
    tiers.flush(limit=3)
    assert places(tiers, "L0") == {(0, "remove"), (0, "record"), (1, "record")}  # hides what lies below
    assert held(tiers) == [(key(4), b"b"), (key(8), b"a"), (key(12), b"a"), (key(1), b"a"), (key(5), b"a")]
    commit(store, [("remove", key(n), None) for n in (4, 8, 12)])
    tiers.flush(limit=3)  # the cell goes down and is empty there: its earlier rows do not come back
    assert places(tiers, "L0") == {(1, "record")} and places(tiers, "L1") == set()
    assert held(tiers) == [(key(1), b"a"), (key(5), b"a")]


def test_a_flush_that_failed_is_written_over(store, tmp_path):
    tiers = Tiers(store, str(tmp_path / "tiers"))
    commit(store, [("record", key(n), b"a") for n in range(8)])
    tiers.flush(limit=1)
    left = tiers.level("L1").limit(1)
    left.withColumn("v", F.lit(b"x")).write.parquet(f"{tiers.folder}/L1/gen=2")  # without its last mark
    assert tiers.flushed()[0] == 1 and len(held(tiers)) == 8
    commit(store, [("record", key(1), b"b"), ("record", key(5), b"b")])
    assert tiers.flush(limit=1) == 2
    assert dict(held(tiers)) == {key(n): b"b" if n in (1, 5) else b"a" for n in range(8)}


def test_drops_and_undeclared_key_spaces(spark, store, tmp_path):
    tiers = Tiers(store, str(tmp_path / "tiers"))
    commit(store, [("record", key(n), b"a") for n in range(8)])
    commit(store, [("record", key(n), b"a") for n in range(8)], "other")
    tiers.flush(limit=1)
    store.drop_cells("main", bytes(8), b"\x3f" + b"\xff" * 7)
    assert [k for k, _ in held(tiers)] == sorted(key(n) for n in range(8) if n % 4)
    commit(store, [("record", key(4), b"b")])
    hidden = Tiers(Store.open(spark, store.root, [KeySpace("main", key_length=8, cells=4)]), tiers.folder)
    hidden.flush(limit=1)
    assert dict(held(hidden)) == {key(4): b"b"} | {key(n): b"a" for n in range(8) if n % 4}
    with pytest.raises(KeyError):
        hidden.state("other")
    assert {r["k"] for r in hidden.level("L0").unionByName(hidden.level("L1")).filter("ks = 'main' AND cell = 0").collect()} == {key(4).hex()}
    both = Tiers(Store.open(spark, store.root, store.spaces), tiers.folder)
    assert len(held(both, "other")) == 8
