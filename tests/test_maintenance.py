import threading
import time

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keys
from keyloom.operators import maintenance as M
from keyloom.sources.registry import KeySpace
from keyloom.sources.store import Store
from keyloom.streaming import live


def test_walk_from_an_offset(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(100).select(F.col("id").alias("off")).write.parquet(path)
    assert M.walk(spark, path, 40).count() == M.walk(spark, path, 40, verify=False).count() == 60
    with pytest.raises(ValueError):
        M.walk(spark, path, -1)


def test_state_files_prune_by_cell_and_hold_a_bloom_filter(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = spark.range(10_000).select(F.md5(F.col("id").cast("string")).alias("k"), "id")
    M.write_state(rows, path, keys.uniform_cell(F.col("k"), 16))
    back = spark.read.parquet(path)
    assert back.count() == 10_000 and back.select("cell").distinct().count() == 16
    probe = rows.first()["k"]
    assert back.filter((F.col("k") == probe) & (F.col("cell") == keys.uniform_cell_of(bytes.fromhex(probe), 16))).count() == 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(back.inputFiles()[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    columns = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in reader.getFooter().getBlocks().get(0).getColumns()}
    reader.close()
    assert columns["k"] > 0 > columns["id"]


def test_sparse_files_are_rewritten(spark):
    files = spark.createDataFrame([(0, 10, 100), (1, 90, 100), (2, 5, 100)], "file long, live_bytes long, file_bytes long")
    chosen = M.sparse(files, 50)
    assert [r["file"] for r in chosen.collect()] == [0]
    entries = spark.createDataFrame([(f"{i:04x}", i % 3) for i in range(30)], "k string, file long")
    got = M.rewrite(entries, chosen, 100, 4)
    assert got.count() == 30 and sorted({r["file"] for r in got.collect()}) == [1, 2, 100, 101, 102]


def test_metrics_of_a_run(spark):
    rows = spark.createDataFrame([("a", "record", 3), ("b", "remove", 0), ("c", "record", 4)], "k string, kind string, n long")
    df, seen = M.observed(rows, "walk", F.col("n"))
    df.collect()
    assert seen.get == {"entries": 3, "records": 2, "removes": 1, "bytes": 7}


def test_a_job_can_be_cancelled(spark):
    slow = spark.range(8).repartition(8).select(F.pandas_udf(lambda s: (time.sleep(20), s)[1], "long")("id").alias("x"))
    failed = []

    def run():
        try:
            M.in_group(spark, "relocation", lambda: slow.agg(F.sum("x")).collect())
        except Exception as e:
            failed.append(e)

    from pyspark import InheritableThread

    t = InheritableThread(target=run) if hasattr(threading, "Thread") else None
    t.start()
    time.sleep(4)
    M.cancel(spark, "relocation")
    t.join(15)
    assert failed and not t.is_alive()


def test_store_relocation_modes_and_verify(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("k", key_length=4), KeySpace("k2", key_length=4)])
    b = store.batch()
    for n in range(40):
        b.write("k", n.to_bytes(4, "big"), b"v").write("k2", n.to_bytes(4, "big"), b"v")
    b.commit()
    number = F.conv("k", 16, 10).cast("long")
    assert store.verify("k") == {"total": 40, "lacking": 0, "surplus": 0, "ok": True}
    assert store.target_position(0.0) == 0 and store.target_position(0.5) == 39 and store.target_position(2.0) == 79
    one = store.relocated("k", F.when(number % 2 == 1, "remove").otherwise("keep"), f"{store.root}-1")
    assert one.state("k").count() == 20 and one.state("k2").count() == 40
    two = store.relocated("k", F.lit("remove"), f"{store.root}-2", mode="log")
    assert two.state("k").count() == 0 and two.state("k2").count() == 40
    assert one.verify("k2")["ok"] and store.state("k").count() == 40


def test_a_relocation_is_resumed(spark, tmp_path, monkeypatch):
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("k", key_length=4)])
    b = store.batch()
    for n in range(16):
        b.write("k", (n << 28).to_bytes(4, "big"), bytes([n]))
    b.commit()
    odd, to = F.when(F.conv(F.hex("v"), 16, 10).cast("long") % 2 == 1, "remove").otherwise("keep"), f"{store.root}-1"
    append, made = Store._append, []

    def fails_at_the_third(self, rows, mark=""):
        if len(made) == 2:
            raise OSError("lost")
        made.append(mark)
        return append(self, rows, mark)

    monkeypatch.setattr(Store, "_append", fails_at_the_third)
    with pytest.raises(OSError):
        store.relocated("k", odd, to, parts=4)
    assert Store(spark, to).version() == 2
    monkeypatch.setattr(Store, "_append", append)
    store.insert("k", (1).to_bytes(4, "big"), b"\x02")  # after the relocation began: not its business
    with pytest.raises(ValueError):
        store.relocated("k", odd, to, parts=8)
    done = store.relocated("k", odd, to, parts=4)
    assert made == [".part.0", ".part.1"] and done.version() == 4
    assert sorted(r["v"][0] for r in done.state("k").collect()) == list(range(0, 16, 2))
    assert done.frontier() == 16 and "relocation" not in done.settings
    with pytest.raises(ValueError):
        store.relocated("k", odd, to, parts=4)


def test_no_offset_is_used_twice(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("k", key_length=1)])
    store.insert("k", b"a", b"1")
    store.insert("k", b"b", b"1")
    store.commit(store.log().select("ks", "k", "v", "kind", F.col("off").alias("nth")).limit(0))
    assert store.frontier() == 2 and store.version() == 3
    store.remove("k", b"b")
    other = store.compacted(f"{store.root}-1")
    assert other.frontier() == store.frontier() == 3 and other.insert("k", b"b", b"2") == 2
    assert other.get("k", b"b") == b"2" and other.frontier() == 4


def test_retention_by_age_when_a_log_is_relocated(spark, tmp_path):
    """Values older than a time to live go when the log is rewritten, unless they were written again."""
    store = Store.create(spark, str(tmp_path / "db"), [KeySpace("k", key_length=4)])
    write = lambda n, at: store.insert("k", n.to_bytes(4, "big"), str(at).encode())
    for n, at in ((1, 100), (2, 100), (3, 500), (1, 900)):
        write(n, at)
    age = F.lit(1000) - F.col("v").cast("string").cast("long")
    kept = store.relocated("k", F.when(age > 600, "remove").otherwise("keep"), f"{store.root}-kept")
    assert sorted(int(r["k"], 16) for r in kept.state("k").collect()) == [1, 3]


def test_paced_writes_and_periodic_jobs(spark, tmp_path):
    seen = []
    query = live.periodically(live.paced(spark, 50), lambda df, i: seen.append(df.count()), "1 second", str(tmp_path / "check"))
    for _ in range(60):
        time.sleep(0.5)
        if sum(seen) > 0:
            break
    query.stop()
    assert sum(seen) > 0
