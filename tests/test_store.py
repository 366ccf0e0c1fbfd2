import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from model import apply, between, operations

from keyloom.functions import keys
from keyloom.sources.registry import KeySpace, reconcile
from keyloom.sources.store import Store


def u32(n):
    return n.to_bytes(4, "big")


@pytest.fixture
def store(spark, tmp_path):
    return Store.create(spark, str(tmp_path / "db"), [KeySpace("main", key_length=8, cells=64), KeySpace("other", key_length=8)])


def items(df):
    return [(bytes.fromhex(r["k"]), bytes(r["v"])) for r in df.collect()]


def commit(store, batch, ks="main"):
    b = store.batch()
    for kind, key, value in batch:
        b.write(ks, key, value) if kind == "record" else b.delete(ks, key)
    return b.commit()


def test_random_batches_against_a_sorted_map(store):
    model, seen = {}, {}
    for batch in operations(seed=42, n=8):
        seen[commit(store, batch)] = model = apply(model, batch)
    k = lambda n: n.to_bytes(8, "big")
    assert items(store.scan("main")) == between(model)
    assert items(store.scan("main", k(7), k(30), reverse=True)) == between(model, k(7), k(30), True)
    assert items(store.get_lt("main", k(20), 3)) == between(model, None, k(20), True)[:3]
    for n in (0, 5, 39):
        assert store.get("main", k(n)) == model.get(k(n)) and store.exists("main", k(n)) == (k(n) in model)
    old = min(seen) + 3
    assert items(store.scan("main", version=old)) == between(seen[old])  # a version does not change
    assert items(store.scan("other")) == []
    assert items(store.compacted(f"{store.root}-compacted").scan("main")) == between(model)
    offsets = sorted(r["off"] for r in store.log().collect())
    assert offsets == list(range(len(offsets)))  # dense


def test_batches_are_whole_across_key_spaces(store):
    assert store.is_empty()
    store.batch().write("main", b"a" * 8, b"1").write("other", b"b" * 8, b"2").write("main", b"a" * 8, b"3").commit()
    assert store.get("main", b"a" * 8) == b"3" and store.get("other", b"b" * 8) == b"2" and not store.is_empty()
    with pytest.raises(ValueError):
        store.batch().write("main", b"a" * 8, b"9").write("other", b"short", b"9").commit()
    assert store.get("main", b"a" * 8) == b"3"
    with pytest.raises(KeyError):
        store.insert("nowhere", b"a" * 8, b"")


def test_a_commit_that_is_not_complete_is_invisible(store, spark):
    store.insert("main", b"a" * 8, b"1")
    torn = f"{store.root}/log/00000001"
    spark.createDataFrame([("main", 99, "record", (b"z" * 8).hex(), bytearray(b"x"))], "ks string, off long, kind string, k string, v binary").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(torn)
    assert items(store.scan("main")) == [(b"a" * 8, b"1")]
    store.insert("main", b"b" * 8, b"2")  # takes its place
    assert items(store.scan("main")) == [(b"a" * 8, b"1"), (b"b" * 8, b"2")]


def test_a_repeated_batch_is_committed_once(store, spark):
    rows = lambda v: spark.createDataFrame([("main", (b"a" * 8).hex(), bytearray(v), "record", 0)], "ks string, k string, v binary, kind string, nth long")
    assert store.commit(rows(b"1"), "s", 0) == 1 and store.commit(rows(b"9"), "s", 0) == 1
    assert store.commit(rows(b"2"), "t", 0) == 2 and store.commit(rows(b"3"), "s", 1) == 3
    assert store.get("main", b"a" * 8) == b"3" and store.log().count() == 3


def test_empty_value_is_not_absence(store):
    store.insert("main", b"k" * 8, b"")
    assert store.get("main", b"k" * 8) == b"" and store.exists("main", b"k" * 8)
    store.remove("main", b"k" * 8)
    assert store.get("main", b"k" * 8) is None


def test_drop_cells(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("ks", key_length=10, cells=4)])
    key = lambda first: bytes([first]) + bytes(9)
    for first in (0x00, 0x40, 0x80):
        store.insert("ks", key(first), b"v")
    low, high = keys.uniform_cell_range(0, 4, 10)[0], keys.uniform_cell_range(1, 4, 10)[1]
    with pytest.raises(ValueError):
        store.drop_cells("ks", low, key(0x50))
    store.drop_cells("ks", low, high)
    assert [k for k, _ in items(store.scan("ks"))] == [key(0x80)]
    store.insert("ks", key(0x40), b"later")  # only earlier writes go
    assert [k for k, _ in items(store.scan("ks"))] == [key(0x40), key(0x80)]
    for other in (store.compacted(f"{store.root}-c"), store.copied(f"{store.root}-d")):
        assert [k for k, _ in items(other.scan("ks"))] == [key(0x40), key(0x80)]
    assert store.log(version=3).count() == 3  # an older version does not know of the drop


def test_reduced_keys_overwrite_each_other(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("ks", key_length=4, indexing="reduction", reduce_to=(0, 2))])
    for k, v in ((u32(0), b"1"), (u32(0xFFFFFFFD), b"2"), (u32(0xFFFFFFFE), b"2")):
        store.insert("ks", k, v)
    assert items(store.scan("ks", u32(0xFFFFFFFE), u32(0xFFFFFFFF))) == [(u32(0xFFFFFFFE), b"2")]
    assert store.get("ks", u32(0xFFFFFFFD)) is None
    # what was overwritten does not come back, whatever is done to the newer one
    gone = store.relocated("ks", F.when(F.col("k") == "fffffffe", "remove").otherwise("keep"), f"{store.root}-r")
    store.remove("ks", u32(0xFFFFFFFE))
    for other in (gone, store.compacted(f"{store.root}-c")):
        assert items(other.scan("ks")) == [(u32(0), b"1")]


def test_variable_and_hashed_keys(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("var", indexing="variable"), KeySpace("hash", indexing="hash")])
    store.batch().write("var", b"", b"1").write("var", b"\x01", b"2").write("var", b"\x02\x03", b"3").write("hash", b"x", b"4").commit()
    assert [k for k, _ in items(store.scan("var"))] == [b"", b"\x01", b"\x02\x03"]
    assert store.get("hash", b"x") == b"4" and items(store.scan("hash")) == [(b"x", b"4")]
    with pytest.raises(ValueError):
        store.scan("hash", reverse=True)


def test_key_spaces_come_and_go(spark, tmp_path):
    root = str(tmp_path / "db")
    store = Store.create(spark, root, [KeySpace("a", key_length=8), KeySpace("b", key_length=8)])
    store.insert("a", b"a" * 8, b"1")
    store = Store.open(spark, root, [KeySpace("c", key_length=8), KeySpace("b", key_length=8)])
    assert {s.name: (s.id, s.state) for s in store.spaces} == {"a": (0, "retained"), "b": (1, "declared"), "c": (2, "declared")}
    with pytest.raises(KeyError):
        store.get("a", b"a" * 8)
    # hidden rows survive every job
    for n, other in enumerate((store.compacted(f"{root}1"), store.relocated("b", F.lit("remove"), f"{root}2"), store.relocated("b", F.lit("remove"), f"{root}3", "log"), store.copied(f"{root}4"))):
        assert Store.open(spark, other.root, [KeySpace("a", key_length=8)]).get("a", b"a" * 8) == b"1", n
    store = Store.open(spark, root, [KeySpace("a", key_length=8)])
    assert store.get("a", b"a" * 8) == b"1"
    store.destroy("a")
    store = Store.open(spark, root, [KeySpace("a", key_length=8, cells=8)])
    assert store.space("a").id == 3 and store.get("a", b"a" * 8) is None
    with pytest.raises(ValueError):
        reconcile(store.spaces, [KeySpace("a", cells=16)])
    store.drop()
    with pytest.raises(AnalysisException):
        Store(spark, root)


def test_snapshot_and_tail(store):
    store.batch().write("main", b"a" * 8, b"1").write("main", b"b" * 8, b"1").write("other", b"c" * 8, b"1").commit()
    store.remove("main", b"b" * 8)
    at = store.snapshot(f"{store.root}-snapshot")
    assert at == store.frontier() == 4
    store.batch().write("main", b"a" * 8, b"2").delete("other", b"c" * 8).write("main", b"d" * 8, b"2").commit()
    got = {(r["ks"], bytes.fromhex(r["k"])): bytes(r["v"]) for r in store.recovered(f"{store.root}-snapshot", at).collect()}
    assert got == {("main", b"a" * 8): b"2", ("main", b"d" * 8): b"2"}
    old = store.copied(f"{store.root}-old", version=2)
    assert items(old.scan("main")) == [(b"a" * 8, b"1")] and old.frontier() == 4
    old.insert("main", b"e" * 8, b"3")
    assert items(old.scan("main"))[-1] == (b"e" * 8, b"3") and store.get("main", b"e" * 8) is None


def test_wrong_declarations(store):
    with pytest.raises(ValueError):
        KeySpace("x", bloom_filter=True, compactor=True)
    with pytest.raises(AnalysisException):
        Store.create(store.spark, store.root, [])


def test_settings_stay_with_the_store(spark, tmp_path):
    root = str(tmp_path / "db")
    Store.create(spark, root, [KeySpace("main", key_length=8)], {"codec": "lz4_raw", "note": 1}).insert("main", b"a" * 8, b"1")
    again = Store(spark, root)
    assert again.settings == {"codec": "lz4_raw", "note": 1} and again.get("main", b"a" * 8) == b"1"
    listed = again.files().collect()
    assert len(listed) >= 1 and all(r["name"].endswith("lz4raw.parquet") or "lz4" in r["name"] for r in listed)
