import hashlib
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keys, scalars
from keyloom.operators import levels, retention, scan, state, stats
from keyloom.sources.registry import KeySpace
from keyloom.sources.store import Store
from keyloom.streaming import live


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, off long, kind string, v long")


def test_dense_keys_and_bounds(spark):
    rows = frame(spark, [(f"{n:08x}", n, "record", n) for n in range(0, 3072, 3)])
    at = lambda lo, hi, reverse=False: [r["v"] for r in scan.ordered(scan.bounded(rows, lo and f"{lo:08x}", hi and f"{hi:08x}"), reverse).collect()]
    assert at(6, None)[0] == 6 and at(7, None)[0] == 9 and at(3072, None) == []
    assert at(12, 16) == [12, 15] and at(12, 15) == [12] and at(12, 16, True) == [15, 12]


def test_checkpoint_sees_old_values(spark):
    log = frame(spark, [("1", 0, "record", 10), ("2", 1, "record", 20), ("3", 2, "record", 30), ("1", 3, "record", 11), ("2", 4, "remove", None), ("4", 5, "record", 40)])
    got = lambda df: sorted((r["k"], r["v"]) for r in df.collect())
    assert got(state.live(log, limit=3)) == [("1", 10), ("2", 20), ("3", 30)]
    assert got(state.live(log)) == [("1", 11), ("3", 30), ("4", 40)]
    assert {(r["k"], r["change"]) for r in state.difference(state.live(log, limit=3), state.live(log), "k", "v").collect()} == {("1", "changed"), ("2", "removed"), ("4", "added")}


def test_log_rebuilt_from_state_and_tail(spark):
    log = frame(spark, [(f"{i * 7 % 50:04x}", i, "remove" if i % 6 == 0 else "record", i) for i in range(600)])
    whole = sorted(map(str, state.newest(log, ["k"]).collect()))
    tail = state.merge_levels([state.newest(state.not_yet(log, 400), ["k"]), state.newest(state.as_of(log, 400), ["k"])], ["k"], keep_tombstones=True)
    assert sorted(map(str, tail.drop("lvl").select("k", "off", "kind", "v").collect())) == sorted(map(str, state.newest(log, ["k"]).select("k", "off", "kind", "v").collect()))
    assert len(whole) == 50


def test_the_two_relocation_modes(spark):
    log = frame(spark, [(f"{n:08x}", n, "record", n) for n in range(2000)])
    decide = F.when(F.col("v") >= 1000, "stop").otherwise("remove")
    by_log = retention.relocate_by_log(log, ["k"], decide, F.lit(True))
    assert by_log.count() == 1000 and by_log.agg(F.min("v")).first()[0] == 1000
    assert retention.relocate_by_log(log, ["k"], decide, F.lit(False)).count() == 2000
    odd = F.when(F.col("v") % 2 == 1, "remove").otherwise("keep")
    assert retention.relocate_by_index(log, ["k"], odd, 2000).count() == 1000


def test_key_functions(spark):
    df = spark.createDataFrame([("00",), ("80000000ff",), ("ffffffff",), ("1234abcd",)], "h string")
    assert [r[0] for r in df.select(keys.uniform_cell(F.col("h"), 256)).collect()] == [0, 128, 255, 0x12]
    assert [r[0] for r in df.select(keys.prefix_cell(F.col("h"), 1, 4)).collect()] == ["00", "80", "f0", "10"]
    assert df.select(keys.hashed_blake2b(F.col("h"))).collect()[3][0] == hashlib.blake2b(bytes.fromhex("1234abcd"), digest_size=32).hexdigest()[:32]
    for cell in range(7):
        first, last = keys.uniform_cell_range(cell, 7, 6)
        assert keys.uniform_cell_of(first, 7) == keys.uniform_cell_of(last, 7) == cell
        assert cell == 0 or keys.uniform_cell_of((int.from_bytes(first, "big") - 1).to_bytes(6, "big"), 7) == cell - 1
    assert keys.prefix_bits(12) == (2, 4) and keys.prefix_bits(16) == (2, 0)
    assert scalars.bloom_bits(2000, 0.01) == 19171


def test_percentile_rule(spark):
    n = spark.createDataFrame([(4,)], "n long")
    assert n.select(scalars.percentile_rank(F.col("n"), 50)).first()[0] == 3


def test_zipf_ranks(spark):
    u = spark.range(1000).select((F.col("id") / 1000.0).alias("u"))
    for exponent in (0, 1, 2.0):
        ranks = [r[0] for r in u.select(keys.zipf_rank(F.col("u"), 50, exponent)).collect()]
        assert min(ranks) == 1 and max(ranks) <= 50
        assert exponent == 0 or ranks.count(1) > 3 * ranks.count(20)


def test_console_and_generator_functions(spark):
    df = spark.createDataFrame([("0aFF", 3), ("", 0)], "h string, n int")
    got = df.select(keys.must_be_hex(F.col("h")).alias("b"), keys.text_hex(F.lit("aé")).alias("t"), keys.bytes_hex(F.col("n"), 7).alias("r"), scalars.human_count(F.col("n") * 1_500_000).alias("c")).collect()
    assert [bytes(r["b"]) for r in got] == [b"\x0a\xff", b""] and got[0]["t"] == "61c3a9" and [r["r"] for r in got] == ["070707", ""] and [r["c"] for r in got] == ["4.50 M", "0"]
    with pytest.raises(Exception, match="not a hex string"):
        spark.createDataFrame([("xyz",)], "h string").select(keys.must_be_hex(F.col("h"))).collect()
    made = spark.range(500).select(keys.seeded_key(F.col("id"), 1).alias("k"), keys.seeded_key(F.col("id"), 2).alias("other"), keys.seeded_value(F.col("id"), 1, 70).alias("v")).collect()
    assert len({r["k"] for r in made} | {r["other"] for r in made}) == 1000 and {len(r["k"]) for r in made} == {32} and {len(r["v"]) for r in made} == {70}


def test_shards(spark):
    n = spark.createDataFrame([("a", 10_000), ("b", 5)], "ks string, n long")
    got = levels.split_ranges(n, F.col("n"), 900).collect()
    assert max(r["hi"] - r["lo"] for r in got) <= 900 and sum(r["hi"] - r["lo"] for r in got) == 10_005
    shards = spark.createDataFrame([(0, 10, 19), (1, 20, 99)], "shard long, lo long, hi long")
    p = spark.createDataFrame([(5,), (10,), (25,), (500,)], "x long")
    assert sorted((r["x"], r["shard"]) for r in levels.owning_shard(p, "x", shards).collect()) == [(5, 0), (10, 0), (25, 1), (500, 1)]
    assert sorted((r["x"], r["shard"]) for r in levels.covering_shard(p, "x", shards).collect()) == [(10, 0), (25, 1)]


def test_ranked_is_global(spark):
    df = spark.range(5000).select(F.format_string("%08x", (F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    got = sorted((r["k"], r["pos"]) for r in scan.ranked(df).collect())
    assert [p for _, p in got] == list(range(1, 5001))


def test_range_reads_only_its_cells(spark, tmp_path):
    rows = spark.range(4096).select(F.format_string("%08x", F.col("id") * 1048576).alias("k"), "id")
    path = str(tmp_path / "state")
    rows.withColumn("cell", keys.uniform_cell(F.col("k"), 64)).repartition("cell").write.partitionBy("cell").parquet(path)
    got = scan.cell_range(spark.read.parquet(path), bytes.fromhex("20000000"), bytes.fromhex("30000000"), 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 256 and "PartitionFilters: [isnotnull(cell" in plan and "PushedFilters: [IsNotNull(k)" in plan


def test_newest_combines_before_the_shuffle(spark):
    plan = state.live(frame(spark, [("a", 0, "record", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") == 1


@pytest.fixture
def arriving(spark, tmp_path):
    def put(name, rows):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    return tmp_path, put


def test_stream_restarts_and_ignores_late_writes(spark, arriving):
    path, put = arriving
    put("1", [("a", 5, "record", 1), ("b", 6, "record", 2)])
    schema = frame(spark, []).schema
    store = Store.create(spark, str(path / "db"), [KeySpace("s", indexing="variable")])

    def run():
        read = lambda: live.read_files(spark, str(path / "in" / "*"), schema, 1)
        writes = read().select(F.lit("s").alias("ks"), F.hex("k").alias("k"), F.col("v").cast("string").cast("binary").alias("v"), "kind", F.col("off").alias("nth"))
        live.commit_batches(writes, store, "in", str(path / "commit"))
        return live.keep_newest(read(), str(path / "state"), str(path / "check"))

    assert live.frontier(run()) == 6 and store.version() == 1
    put("2", [("a", 3, "record", 0), ("b", 9, "remove", None)])
    got = {r["k"]: (r["off"], r["kind"]) for r in run().collect()}
    assert got == {"a": (5, "record"), "b": (9, "remove")} and store.version() == 2
    assert {r["k"]: r["off"] for r in run().collect()} == {"a": 5, "b": 9} and store.version() == 2  # nothing new


def test_neighbours_go_over_ranges(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice("xyz"), f"{rng.randrange(10**6):06d}") for _ in range(600)})
    got = {(r["ks"], r["k"]): (r["prev_key"], r["next_key"]) for r in scan.neighbours(spark.createDataFrame(rows, "ks string, k string"), ["ks"]).collect()}
    for i, (ks, k) in enumerate(rows):
        before = rows[i - 1][1] if i and rows[i - 1][0] == ks else None
        after = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == ks else None
        assert got[ks, k] == (before, after)
    plan = scan.neighbours(spark.createDataFrame(rows, "ks string, k string"), ["ks"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ks" not in plan


def test_versions_and_stale_writes_of_a_hot_key(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot", "hot", None, f"{n % 40:02x}"]), n, "record", draw.randrange(3000)) for n in range(3000)]
    log = frame(spark, rows)
    newest_first = sorted(rows, key=lambda r: -r[1])
    seen, expected = {}, set()
    for k, off, *_ in newest_first:
        seen[k] = seen.get(k, 0) + 1
        expected.add((k, off, seen[k]))
    assert {(r["k"], r["off"], r["version"]) for r in state.versions(log, ["k"]).collect()} == expected
    top, late = {}, set()
    for k, off, _, v in sorted(rows, key=lambda r: (r[3], r[1])):
        if off < top.get(k, -1):
            late.add((k, off, top[k]))
        top[k] = max(off, top.get(k, -1))
    got = state.stale(log, ["k"], ["v", "off"])
    assert {(r["k"], r["off"], r["highest"]) for r in got.collect()} == late and got.columns == [*log.columns, "highest"]
    assert state.versions(log.limit(0), ["k"]).count() == 0


def test_percentiles_and_medians_of_large_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), rng.randrange(5000)) for _ in range(4000)] + [("r", 7)]
    df = spark.createDataFrame(rows, "g string, x long")
    percents = (50, 99, 99.9, 99.999)
    got = {r["g"]: r for r in stats.distribution(df, ["g"], "x", percents).collect()}
    middle = {r["g"]: r["median"] for r in stats.medians(df, ["g"], "x").collect()}
    for g in "pqr":
        xs = sorted(x for h, x in rows if h == g)
        n = len(xs)
        assert [got[g][stats.percentile_name(p)] for p in percents] == [xs[min(n * round(p * 1000) // 100_000, n - 1)] for p in percents]
        assert middle[g] == (xs[(n - 1) // 2] + xs[n // 2]) / 2 and got[g]["n"] == n


def test_a_compactor_sees_places(spark):
    rows = [(c, f"{k:03d}", "remove" if k % 7 == 0 else "record") for c in (1, 2) for k in range(40)]
    got = retention.compact(spark.createDataFrame(rows, "cell int, k string, kind string"), "cell", lambda place, n: (place == 1) | (place > n - 2)).collect()
    shown = [f"{k:03d}" for k in range(40) if k % 7]
    want = [(c, k) for c in (1, 2) for k in [shown[0], *shown[-2:]]] + [(c, f"{k:03d}") for c in (1, 2) for k in range(0, 40, 7)]
    assert sorted((r["cell"], r["k"]) for r in got) == sorted(want)
