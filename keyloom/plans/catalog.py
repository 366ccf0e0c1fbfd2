"""The registered queries of the change-log engine, each with the SQL that must give the same rows.

The log of all of them is `events`: the offset is event_id (unique), the key the user in hex, the kind `remove` for
errors and `record` otherwise, the key space the event type.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions import keys, scalars
from keyloom.operators import batches, levels, retention, scan, state, stats
from keyloom.operators.lineage import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LOG = """log AS (SELECT event_id AS off, lpad(lower(hex(user_id)), 16, '0') AS k, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'record' END AS kind,
  event_type AS ks, value AS v, ts, props FROM events)"""
LIVE = f"""{LOG}, live AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1), st AS (SELECT * FROM live WHERE kind = 'record')"""
PROBES = "probes AS (SELECT lpad(lower(hex(c_custkey)), 16, '0') AS k FROM customer)"


#: offsets in the middle of the log, and where its last hundredth begins
MIDDLE = "(SELECT (min(off) + max(off) + 1) // 2 FROM log)"
MIDDLE_ID = "(SELECT (min(event_id) + max(event_id) + 1) // 2 FROM events)"
LATE = "(SELECT max(off) + 1 - (max(off) - min(off) + 1) // 100 FROM log)"


def key(n: int) -> str:
    return f"{n:016x}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("record")
    return e.select(F.col("event_id").alias("off"), keys.hex_key(F.col("user_id")).alias("k"), kind.alias("kind"), F.col("event_type").alias("ks"), F.col("value").alias("v"), "ts", "props")


def thin(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("off", "k", "kind", "ks", "v")


def _ends(spark: SparkSession, sf: str) -> tuple[int, int]:
    return tuple(table(spark, sf, "events").agg(F.min("event_id"), F.max("event_id")).first())


def middle(spark: SparkSession, sf: str) -> int:
    low, high = _ends(spark, sf)
    return (low + high + 1) // 2


def late(spark: SparkSession, sf: str) -> int:
    low, high = _ends(spark, sf)
    return high + 1 - (high - low + 1) // 100


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(keys.hex_key(F.col("c_custkey")).alias("k"))


def long(c: str | Column, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# state and scans


@query(f"WITH {LIVE} SELECT k, off, v, ks FROM st")
def live_state(spark, sf):
    return state.live(thin(spark, sf)).select("k", "off", "v", "ks")


@query(f"WITH {LIVE} SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM st")
def scan_all(spark, sf):
    return scan.ranked(state.live(thin(spark, sf)).select("k", "v")).select("pos", "k", "v")


@query(f"WITH {LIVE} SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM st WHERE k >= '{key(64)}'")
def scan_lower(spark, sf):
    return scan.ranked(scan.bounded(state.live(thin(spark, sf)).select("k", "v"), key(64))).select("pos", "k", "v")


@query(f"WITH {LIVE} SELECT row_number() OVER (ORDER BY k) AS pos, k, v FROM st WHERE k >= '{key(32)}' AND k < '{key(96)}'")
def scan_range(spark, sf):
    return scan.ranked(scan.bounded(state.live(thin(spark, sf)).select("k", "v"), key(32), key(96))).select("pos", "k", "v")


@query(f"WITH {LIVE} SELECT row_number() OVER (ORDER BY k DESC) AS pos, k, v FROM st WHERE k >= '{key(32)}' AND k < '{key(96)}'")
def scan_reverse(spark, sf):
    return scan.ranked(scan.bounded(state.live(thin(spark, sf)).select("k", "v"), key(32), key(96)), reverse=True).select("pos", "k", "v")


@query(f"WITH {LIVE} SELECT k, v FROM st WHERE k < '{key(100)}' ORDER BY k DESC LIMIT 5")
def get_lt(spark, sf):
    return scan.less_than(state.live(thin(spark, sf)).select("k", "v"), key(100), 5)


@query(f"WITH {LIVE} SELECT k, v, off FROM st WHERE k = '{key(7)}'")
def get_point(spark, sf):
    return state.live(scan.get(thin(spark, sf), key(7))).select("k", "v", "off")


@query(f"WITH {LIVE}, {PROBES} SELECT st.k, v, off FROM st JOIN probes USING (k)")
def multi_get(spark, sf):
    return scan.multi_get(state.live(thin(spark, sf)), probes(spark, sf)).select("k", "v", "off")


@query(f"WITH {LIVE}, {PROBES} SELECT k FROM probes WHERE k IN (SELECT k FROM st)")
def exists(spark, sf):
    return scan.exists(state.live(log(spark, sf).select("off", "k", "kind")), probes(spark, sf))


@query(f"WITH {LIVE}, {PROBES} SELECT k, k IN (SELECT k FROM st) AS found FROM probes")
def multi_exists(spark, sf):
    live = state.live(log(spark, sf).select("off", "k", "kind")).select("k", F.lit(True).alias("found"))
    return probes(spark, sf).join(live, "k", "left").select("k", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {LIVE}, {PROBES} SELECT k FROM probes WHERE k NOT IN (SELECT k FROM st)")
def bloom_negatives(spark, sf):
    return scan.missing(state.live(log(spark, sf).select("off", "k", "kind")), probes(spark, sf))


@query(f"WITH {LIVE} SELECT min(k) AS first_key, max(k) AS last_key FROM st")
def first_last(spark, sf):
    return state.live(thin(spark, sf)).agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query(f"WITH {LIVE} SELECT ks, k, lag(k) OVER (PARTITION BY ks ORDER BY k) AS prev_key, lead(k) OVER (PARTITION BY ks ORDER BY k) AS next_key FROM st")
def next_entry(spark, sf):
    return scan.neighbours(state.live(thin(spark, sf)), ["ks"])


CELL = "('0x' || substr(md5(k), 1, 8))::BIGINT * 64 >> 32"


@query(f"WITH {LIVE}, c AS (SELECT DISTINCT {CELL} AS cell FROM st) SELECT cell, lag(cell) OVER (ORDER BY cell) AS prev_cell, lead(cell) OVER (ORDER BY cell) AS next_cell FROM c")
def next_cell(spark, sf):
    cells = state.live(thin(spark, sf)).select(keys.uniform_cell(F.md5("k"), 64).alias("cell")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("cell")  # 64 cells
    return cells.select("cell", F.lag("cell").over(w).alias("prev_cell"), F.lead("cell").over(w).alias("next_cell"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations WHERE conv_id >= 10 AND conv_id < 50")
def prefix_scan(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role").filter("conv_id >= 10 and conv_id < 50")
    return scan.ranked(c, ["conv_id"], key="turn").select("conv_id", "turn", "role", "pos")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_in_prefix(spark, sf):
    return retention.newest_of_prefix(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role")


# as-of reads and versions


@query(f"WITH {LOG} SELECT k, off, v FROM (SELECT * FROM log WHERE off < {MIDDLE} QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1) WHERE kind = 'record'")
def as_of_state(spark, sf):
    return state.live(thin(spark, sf), limit=middle(spark, sf)).select("k", "off", "v")


@query(f"WITH {LOG} SELECT k, off, v FROM (SELECT * FROM log WHERE off < {MIDDLE} AND k = '{key(5)}' QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1) WHERE kind = 'record'")
def get_as_of(spark, sf):
    return state.live(scan.get(thin(spark, sf), key(5)), limit=middle(spark, sf)).select("k", "off", "v")


@query(f"WITH {LOG} SELECT k, count(*) AS pending, min(off) AS first_off, max(off) AS last_off FROM log WHERE off >= 9000 GROUP BY k")
def unprocessed(spark, sf):
    return state.not_yet(thin(spark, sf), 9000).groupBy("k").agg(F.count(F.lit(1)).alias("pending"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


@query(f"""WITH {LIVE}, old AS (SELECT k, off FROM (SELECT * FROM log WHERE off < {LATE} QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1) WHERE kind = 'record')
SELECT coalesce(o.k, n.k) AS k, o.off AS old, n.off AS new, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old o FULL JOIN st n ON o.k = n.k WHERE o.off IS DISTINCT FROM n.off""")
def checkpoint_diff(spark, sf):
    rows = thin(spark, sf)
    return state.difference(state.live(rows, limit=late(spark, sf)), state.live(rows), "k", "off")


@query(f"WITH {LOG} SELECT k, off, kind, row_number() OVER (PARTITION BY k ORDER BY off DESC) AS version FROM log")
def version_history(spark, sf):
    return state.versions(thin(spark, sf), ["k"]).select("k", "off", "kind", "version")


@query(f"WITH {LOG}, w AS (SELECT k, off, max(off) OVER (PARTITION BY k ORDER BY v, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM log) SELECT * FROM w WHERE off < highest")
def stale_updates(spark, sf):
    return state.stale(thin(spark, sf), ["k"], ["v", "off"]).select("k", "off", "highest")


# batches


@query(f"WITH {LOG} SELECT off // 100 AS batch, k, off, kind FROM log QUALIFY row_number() OVER (PARTITION BY off // 100, k ORDER BY off DESC) = 1")
def batch_last_wins(spark, sf):
    return state.last_wins(log(spark, sf).select("off", "k", "kind"), F.expr("off div 100"), ["k"]).select("batch", "k", "off", "kind")


@query(f"WITH {LOG} SELECT off // 64 AS batch, min(off) AS first_off, count(*) AS frames, count(*) = 64 AS complete FROM log GROUP BY 1")
def batch_complete(spark, sf):
    return batches.frame_counts(log(spark, sf).select("off"), F.expr("off div 64"), 64)


@query(f"""WITH {LOG}, b AS (SELECT off // 64 AS batch, min(off) AS first_off, count(*) AS n FROM log GROUP BY 1), last AS (SELECT * FROM b ORDER BY batch DESC LIMIT 1)
SELECT off, k FROM log WHERE off < (SELECT CASE WHEN n <> 64 THEN first_off ELSE 9223372036854775807 END FROM last)""")
def torn_batch(spark, sf):
    return batches.cut_torn(log(spark, sf).select("off", "k"), F.expr("off div 64"), 64)


@query(f"WITH {LOG} SELECT off // 64 AS batch, min(off) OVER (PARTITION BY off // 64) AS batch_off, row_number() OVER (PARTITION BY off // 64 ORDER BY off) - 1 AS place, k, kind FROM log")
def explode_batch(spark, sf):
    return batches.explode_batches(batches.as_arrays(log(spark, sf).select("off", "k", "kind"), F.expr("off div 64"), ["k", "kind"]), ["k", "kind"])


@query(f"WITH {LOG} SELECT off // 64 AS batch, count(*) AS hits FROM log WHERE k = '{key(7)}' GROUP BY 1")
def find_in_batch(spark, sf):
    return batches.find_in_batches(batches.as_arrays(log(spark, sf).select("off", "k"), F.expr("off div 64"), ["k"]), key(7))


@query(f"WITH {LOG}, done AS (SELECT off FROM log WHERE kind = 'record') SELECT CASE WHEN (SELECT min(off) FROM done) = 0 THEN (SELECT min(off) FROM done WHERE off + 1 NOT IN (SELECT off FROM done)) ELSE -1 END AS frontier")
def contiguous_frontier(spark, sf):
    return batches.frontier(log(spark, sf).filter("kind = 'record'").select("off"))


# keys and cells


@query(f"WITH {LIVE} SELECT {CELL} AS cell, count(*) AS n, min(off) AS first_off, max(off) AS last_off FROM st GROUP BY 1")
def cell_uniform(spark, sf):
    return state.live(thin(spark, sf)).groupBy(keys.uniform_cell(F.md5("k"), 64).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


@query(f"WITH {LIVE} SELECT {CELL} AS cell, count(*) FILTER (kind = 'record') AS records, count(*) FILTER (kind = 'remove') AS removes FROM live GROUP BY 1")
def entry_state(spark, sf):
    rows = state.newest(thin(spark, sf), ["k"]).groupBy(keys.uniform_cell(F.md5("k"), 64).alias("cell"))
    return rows.agg(F.count_if(F.col("kind") == "record").alias("records"), F.count_if(F.col("kind") == "remove").alias("removes"))


@query(f"""WITH {LOG}, m AS (SELECT DISTINCT md5(k) AS h FROM log) SELECT substr(h, 1, 2) || lpad(lower(hex(('0x' || substr(h, 3, 2))::BIGINT & 240)), 2, '0') AS cell, count(*) AS n, min(h) AS first_key, max(h) AS last_key FROM m GROUP BY 1""")
def cell_prefix_cluster(spark, sf):
    hashed = log(spark, sf).select(F.md5("k").alias("h")).distinct()
    return hashed.groupBy(keys.prefix_cell(F.col("h"), 2, 4).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first_key"), F.max("h").alias("last_key"))


@query(f"WITH {LIVE} SELECT md5(k) AS h, {CELL} AS cell, v FROM st WHERE md5(k) >= '20' AND md5(k) < '60'")
def cell_pruned_scan(spark, sf):
    rows = state.live(thin(spark, sf)).select(F.md5("k").alias("h"), keys.uniform_cell(F.md5("k"), 64).alias("cell"), "v")
    return scan.cell_range(rows, bytes([0x20]), bytes([0x60]), 64, "h")


REDUCED = "substr(k, 15, 2)"


@query(f"WITH {LOG} SELECT {REDUCED} AS index_key, k, off FROM log QUALIFY row_number() OVER (PARTITION BY {REDUCED} ORDER BY off DESC) = 1")
def index_key(spark, sf):
    rows = log(spark, sf).select("k", "off", keys.reduced(F.col("k"), 7, 8).alias("index_key"))
    return state.newest(rows, ["index_key"]).select("index_key", "k", "off")


@query(f"""WITH {LOG}, {PROBES}, i AS (SELECT {REDUCED} AS index_key, k, off, kind FROM log QUALIFY row_number() OVER (PARTITION BY {REDUCED} ORDER BY off DESC) = 1)
SELECT p.k, i.off, i.off IS NOT NULL AS found FROM probes p LEFT JOIN i ON substr(p.k, 15, 2) = i.index_key AND p.k = i.k AND i.kind = 'record'""")
def reduce_get(spark, sf):
    index = state.live(log(spark, sf).select("k", "off", "kind", keys.reduced(F.col("k"), 7, 8).alias("index_key")), ["index_key"])
    p = probes(spark, sf).withColumn("index_key", keys.reduced(F.col("k"), 7, 8))
    return p.join(index, ["index_key", "k"], "left").select("k", "off", F.col("off").isNotNull().alias("found"))


@query(f"""WITH {LOG}, i AS (SELECT {REDUCED} AS index_key, k, off, kind FROM log QUALIFY row_number() OVER (PARTITION BY {REDUCED} ORDER BY off DESC) = 1)
SELECT index_key, k, off FROM i WHERE kind = 'record' AND k >= '{key(20)}' AND k < '{key(120)}'""")
def reduce_range(spark, sf):
    index = state.live(log(spark, sf).select("k", "off", "kind", keys.reduced(F.col("k"), 7, 8).alias("index_key")), ["index_key"])
    return scan.bounded(index, key(20), key(120)).select("index_key", "k", "off")


@query(f"WITH {LIVE} SELECT substr(sha256(k), 1, 32) AS index_key, k, off FROM st")
def hash_index(spark, sf):
    return state.live(thin(spark, sf)).select(keys.hashed_sha(F.col("k")).alias("index_key"), "k", "off")


@query()
def hash_index_blake2b(spark, sf):
    return state.live(thin(spark, sf)).select(keys.hashed_blake2b(F.col("k")).alias("index_key"), "k", "off")


@query("SELECT event_id AS position, lpad(lower(hex(event_id // 256)), 16, '0') || lpad(lower(hex(event_id % 256)), 2, '0') AS sequence_choice, lpad(lower(hex(event_id % 256)), 2, '0') || lpad(lower(hex(event_id // 256)), 16, '0') AS choice_sequence FROM events")
def key_layouts(spark, sf):
    p = F.col("event_id")
    return table(spark, sf, "events").select(p.alias("position"), keys.sequence_then_choice(p).alias("sequence_choice"), keys.choice_then_sequence(p).alias("choice_sequence"))


@query("SELECT c_custkey, least(1500, floor(exp(c_custkey / (SELECT max(c_custkey) + 1.0 FROM customer) * ln(1501.0))))::BIGINT AS zipf_rank FROM customer")
def zipf_choice(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    top = c.agg((F.max("c_custkey") + F.lit(1.0)).alias("top"))
    return c.join(F.broadcast(top)).select("c_custkey", keys.zipf_rank(F.col("c_custkey") / F.col("top"), 1500, 1.0).alias("zipf_rank"))  # one row


@query("SELECT event_id AS off, md5(props) AS digest, octet_length(props::BLOB) AS len FROM events")
def record_digest(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("off"), F.md5("props").alias("digest"), long(F.octet_length("props"), "len"))


@query()
def record_crc(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("off"), F.crc32("props").alias("crc"))


# levels, retention


def tiers(spark, sf):
    rows = thin(spark, sf)
    return [state.newest(state.not_yet(rows, late(spark, sf)), ["k"]), state.newest(state.as_of(rows, late(spark, sf)), ["k"])]


LEVELS = f"""{LOG}, l0 AS (SELECT * FROM log WHERE off >= {LATE} QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1), l1 AS (SELECT * FROM log WHERE off < {LATE} QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1),
m AS (SELECT * FROM (SELECT *, 0 AS lvl FROM l0 UNION ALL SELECT *, 1 AS lvl FROM l1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY lvl) = 1)"""


@query(f"WITH {LEVELS} SELECT k, off, v, lvl::BIGINT AS lvl FROM m WHERE kind = 'record'")
def level_merge(spark, sf):
    return state.merge_levels(tiers(spark, sf), ["k"]).select("k", "off", "v", long("lvl", "lvl"))


@query(f"WITH {LEVELS} SELECT k, off, kind, lvl::BIGINT AS lvl FROM m")
def level_merge_keep_tombs(spark, sf):
    return state.merge_levels(tiers(spark, sf), ["k"], keep_tombstones=True).select("k", "off", "kind", long("lvl", "lvl"))


@query(f"WITH {LIVE}, flushed AS (SELECT k, off FROM log WHERE off < {LATE} QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1) SELECT k, off FROM live WHERE (k, off) NOT IN (SELECT (k, off) FROM flushed)")
def unmerge_flushed(spark, sf):
    rows = thin(spark, sf)
    return state.newest(rows, ["k"]).join(state.newest(state.as_of(rows, late(spark, sf)), ["k"]), ["k", "off"], "left_anti").select("k", "off")


@query(f"WITH {LOG} SELECT k, off FROM (SELECT * FROM log WHERE NOT (k <= '{key(63)}' AND off < {LATE}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1) WHERE kind = 'record'")
def drop_cells(spark, sf):
    return state.live(retention.drop_range(thin(spark, sf), key(0), key(63), late(spark, sf))).select("k", "off")


@query("SELECT user_id % 4 AS ks, count(DISTINCT user_id) AS n FROM events WHERE user_id % 4 NOT IN (2) GROUP BY 1")
def destroy_ks(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 4).alias("ks"), "user_id")
    return retention.destroy(rows, [2]).groupBy("ks").agg(F.countDistinct("user_id").alias("n"))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def compactor(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return retention.newest_of_prefix(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderdate", "o_orderkey")


@query(f"WITH {LIVE}, c AS (SELECT *, {CELL} AS cell, row_number() OVER (PARTITION BY {CELL}, kind ORDER BY k DESC) AS nth FROM live) SELECT cell, k, off, kind FROM c WHERE kind = 'remove' OR nth <= 2")
def compactor_callback(spark, sf):
    rows = state.newest(log(spark, sf).select("off", "k", "kind"), ["k"]).select(keys.uniform_cell(F.md5("k"), 64).alias("cell"), "k", "off", "kind")
    return retention.compact(rows, "cell", lambda place, n: place > n - 2)


@query(f"WITH {LIVE} SELECT k, off, v FROM st WHERE NOT v < 10")
def relocation_filter(spark, sf):
    decide = F.when(F.col("v") < 10, "remove").otherwise("keep")
    return retention.relocate_by_index(thin(spark, sf), ["k"], decide, 1 << 62).select("k", "off", "v")


@query(f"WITH {LIVE}, cut AS (SELECT min(off) AS c FROM log WHERE kind = 'record' AND off >= {LATE} AND v > 100) SELECT k, off FROM st, cut WHERE c IS NOT NULL AND off >= c")
def relocation_wal(spark, sf):
    decide = F.when((F.col("off") >= late(spark, sf)) & (F.col("v") > 100), "stop").otherwise("remove")
    return retention.relocate_by_log(thin(spark, sf), ["k"], decide, F.lit(True)).select("k", "off")


@query(f"WITH {LIVE} SELECT k, off FROM st WHERE NOT (off < {LATE} AND v < 60)")
def relocation_index(spark, sf):
    decide = F.when(F.col("v") < 60, "remove").otherwise("keep")
    return retention.relocate_by_index(thin(spark, sf), ["k"], decide, late(spark, sf)).select("k", "off")


@query(f"WITH {LIVE} SELECT k, CASE WHEN off < 9950 AND v < 60 THEN off + 1000000 ELSE off END AS off, off < 9950 AND v < 60 AS moved FROM st")
def relocation_cas(spark, sf):
    index = state.live(thin(spark, sf))
    copies = index.filter("v < 60").select("k", (F.col("off") + 1_000_000).alias("off"))
    return retention.repoint(index, copies, 9950, ["k"])


@query("SELECT min(event_id) + floor((max(event_id) - min(event_id)) * 0.3)::BIGINT AS target FROM events")
def target_ratio(spark, sf):
    return retention.target_position(thin(spark, sf), 0.3)


@query(f"WITH {LIVE} SELECT k, off FROM st WHERE off >= {LATE}")
def reclaimed_floor(spark, sf):
    return state.live(thin(spark, sf)).filter(F.col("off") >= late(spark, sf)).select("k", "off")


@query("SELECT min(event_id) AS lowest, max(event_id) AS highest FROM events")
def log_bounds(spark, sf):
    return thin(spark, sf).agg(F.min("off").alias("lowest"), F.max("off").alias("highest"))


@query(f"WITH {LOG}, c AS (SELECT {CELL} AS cell, max(off) AS last_processed FROM log GROUP BY 1) SELECT least((SELECT max(off) FROM log), min(last_processed)) AS replay_from FROM c")
def replay_from(spark, sf):
    cells = thin(spark, sf).groupBy(keys.uniform_cell(F.md5("k"), 64).alias("cell")).agg(F.max("off").alias("last_processed"))
    return cells.agg(F.least(F.max("last_processed"), F.min("last_processed")).alias("replay_from"))


@query(f"WITH {LOG} SELECT ks, {CELL} AS cell, min(off) AS anchor FROM log GROUP BY 1, 2")
def cell_anchor(spark, sf):
    return thin(spark, sf).groupBy("ks", keys.uniform_cell(F.md5("k"), 64).alias("cell")).agg(F.min("off").alias("anchor"))


@query("""WITH RECURSIVE r AS (SELECT event_type AS ks, 0::BIGINT AS lo, count(*)::BIGINT AS hi FROM events GROUP BY 1),
s AS (SELECT * FROM r UNION ALL SELECT s.ks, CASE WHEN h = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN h = 0 THEN (lo + hi) // 2 ELSE hi END FROM s, (VALUES (0), (1)) t(h) WHERE hi - lo > 900)
SELECT ks, lo, hi FROM s WHERE hi - lo <= 900""")
def shard_split(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("ks")).agg(F.count(F.lit(1)).alias("n"))
    return levels.split_ranges(counts, F.col("n"), 900).select("ks", "lo", "hi")


BOUNDS = """rn AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders),
b AS (SELECT shard, o_orderkey AS lo FROM rn JOIN range(8) s(shard) ON r = shard * n // 8 + 1),
e AS (SELECT shard, lo, coalesce(lead(lo) OVER (ORDER BY shard) - 1, (SELECT max(o_orderkey) FROM orders)) AS hi FROM b)"""


@query(f"WITH {BOUNDS} SELECT c_custkey, shard FROM customer JOIN e ON c_custkey BETWEEN lo AND hi")
def shard_lookup(spark, sf):
    bounds = levels.shard_bounds(table(spark, sf, "orders"), "o_orderkey", 8)
    return levels.covering_shard(table(spark, sf, "customer").select("c_custkey"), "c_custkey", bounds).select("c_custkey", "shard")


@query(f"WITH {BOUNDS} SELECT c_custkey, coalesce((SELECT max(shard) FROM e WHERE lo <= c_custkey), 0) AS shard FROM customer")
def shard_route(spark, sf):
    bounds = levels.shard_bounds(table(spark, sf, "orders"), "o_orderkey", 8)
    return levels.owning_shard(table(spark, sf, "customer").select("c_custkey"), "c_custkey", bounds)


@query(f"WITH {LIVE} SELECT {CELL} AS cell, count(*) AS n, CASE WHEN count(*) > 2 THEN 'L1' ELSE 'L0' END AS to_level FROM st GROUP BY 1")
def promote_decision(spark, sf):
    counts = state.live(thin(spark, sf)).groupBy(keys.uniform_cell(F.md5("k"), 64).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return levels.promotion(counts, "n", 2)


# files


def records(spark, sf):
    """Documents as records of a file log: 50 to a file."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.octet_length("text").alias("len"))
    return d.withColumn("file", F.expr("doc_id div 50"))


FILES = "d AS (SELECT doc_id, lang, strlen(text) AS len, doc_id // 50 AS file FROM documents), f AS (SELECT file, sum(len)::BIGINT AS file_bytes, sum(CASE WHEN lang = 'en' THEN len ELSE 0 END)::BIGINT AS live_bytes FROM d GROUP BY 1)"


def occupied(spark, sf):
    live = F.when(F.col("lang") == "en", F.col("len")).otherwise(0)
    sizes = records(spark, sf).groupBy("file").agg(F.sum("len").cast("long").alias("file_bytes"), F.sum(live).cast("long").alias("live_bytes"))
    return sizes


@query(f"WITH {FILES} SELECT file, live_bytes, file_bytes, live_bytes * 100 < file_bytes * 60 AS sparse FROM f")
def file_occupancy(spark, sf):
    return occupied(spark, sf).select("file", "live_bytes", "file_bytes", (F.col("live_bytes") * 100 < F.col("file_bytes") * 60).alias("sparse"))


@query(f"WITH {FILES} SELECT file FROM f WHERE file NOT IN (SELECT file FROM d GROUP BY 1 HAVING sum((lang = 'de')::INT) >= 6) AND file < least(15, (SELECT max(file) FROM d))")
def sparse_gc(spark, sf):
    files = records(spark, sf)
    held = files.groupBy("file").agg(F.count_if(F.col("lang") == "de").alias("n")).filter("n >= 6")
    top = files.agg(F.max("file")).first()[0]
    return levels.reclaimable(files.select("file").distinct(), held, [15, top])


@query(f"WITH {FILES} SELECT file FROM f EXCEPT SELECT file FROM d WHERE doc_id >= 400")
def dropped_files(spark, sf):
    files = records(spark, sf)
    return files.select("file").distinct().exceptAll(files.filter("doc_id >= 400").select("file").distinct())


@query(f"WITH {FILES} SELECT file FROM f WHERE file < (SELECT min(doc_id) // 50 FROM d WHERE doc_id >= 333)")
def log_gc(spark, sf):
    files = records(spark, sf)
    floor = files.filter("doc_id >= 333").agg(F.expr("min(doc_id) div 50")).first()[0]
    return files.filter(F.col("file") < floor).select("file").distinct()


@query()
def list_files(spark, sf):
    from keyloom.sources import store

    return store.list_files(spark, sf, "events.parquet")


@query("""WITH p AS (SELECT doc_id, ((strlen(text) + 8 + 7) // 8) * 8 AS len, sum(((strlen(text) + 8 + 7) // 8) * 8) OVER (ORDER BY doc_id) AS stop FROM documents)
SELECT doc_id, len::BIGINT AS len, ((stop - len) // 65536)::BIGINT AS fragment FROM p WHERE (stop - len) // 65536 <> (stop - 1) // 65536""")
def fragment_gaps(spark, sf):
    frames = table(spark, sf, "documents").select("doc_id", (F.floor((F.octet_length("text") + 15) / 8) * 8).cast("long").alias("len"))
    stop = scan.running_sum(frames, F.asc("doc_id"), F.col("len"), "stop")
    return stop.filter("(stop - len) div 65536 <> (stop - 1) div 65536").select("doc_id", "len", F.expr("(stop - len) div 65536").alias("fragment"))


# statistics


SIZED = "s AS (SELECT CASE WHEN event_type = 'error' THEN 'remove' ELSE 'record' END AS kind, event_type AS ks, 16 AS key_size, strlen(props) AS value_size, 16 + strlen(props) AS bytes FROM events)"


def sized(spark, sf):
    e = log(spark, sf)
    return e.select("kind", "ks", F.lit(16).alias("key_size"), F.octet_length("props").alias("value_size"), (F.octet_length("props") + 16).alias("bytes"))


@query(f"WITH {SIZED} SELECT kind, count(*) AS entries, sum(bytes)::BIGINT AS bytes, (sum(bytes) // count(*))::BIGINT AS avg_bytes, round(100.0 * sum(bytes)::DOUBLE / (SELECT sum(bytes) FROM s)::DOUBLE, 2) AS share FROM s GROUP BY 1")
def wal_stats_type(spark, sf):
    return stats.by_kind(sized(spark, sf), "bytes").withColumn("share", F.col("share").cast("double"))


@query(f"WITH {SIZED} SELECT ks, count(*) FILTER (kind = 'record') AS records, count(*) FILTER (kind = 'remove') AS removes, sum(bytes)::BIGINT AS bytes FROM s GROUP BY 1")
def wal_stats_ks(spark, sf):
    return stats.by_space(sized(spark, sf), "bytes")


@query(f"""WITH {SIZED} SELECT min(key_size)::BIGINT AS min_key, max(key_size)::BIGINT AS max_key, (sum(key_size) // count(*))::BIGINT AS avg_key, min(value_size) FILTER (kind = 'record')::BIGINT AS min_value,
max(value_size) FILTER (kind = 'record')::BIGINT AS max_value, (sum(value_size) FILTER (kind = 'record') // count(*) FILTER (kind = 'record'))::BIGINT AS avg_value FROM s""")
def wal_stats_sizes(spark, sf):
    return stats.sizes(sized(spark, sf), "key_size", "value_size")


def _dist(by: str, value: str, source: str, percents: tuple[float, ...] = stats.PERCENTS) -> str:
    picks = ", ".join(f"max(x) FILTER (r = least(n * {round(p * 1000)} // 100000, n - 1) + 1)::BIGINT AS {stats.percentile_name(p)}" for p in percents)
    return f"WITH q AS (SELECT {by}, {value} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source}) SELECT {by}, max(n)::BIGINT AS n, sum(x)::BIGINT AS total, (sum(x) // max(n))::BIGINT AS mean, min(x)::BIGINT AS least, max(x)::BIGINT AS most, {picks} FROM q GROUP BY {by}"


@query(_dist("source", "n_chars", "documents"))
def analyze_ks(spark, sf):
    return stats.distribution(table(spark, sf, "documents"), ["source"], "n_chars")


TAIL = (50, 90, 99, 99.9, 99.99, 99.999)


@query(_dist("event_type", "strlen(props)", "events", TAIL))
def latency_quantiles(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.octet_length("props").alias("x"))
    return stats.distribution(e, ["event_type"], "x", TAIL)


@query("SELECT event_type, round(count(*) * 1000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))), 9) AS ops_per_second, round(sum(strlen(props)) * 1000000.0 / (epoch_us(max(ts)) - epoch_us(min(ts))), 9) AS bytes_per_second FROM events GROUP BY 1")
def throughput(spark, sf):
    e = table(spark, sf, "events").select("event_type", "ts", F.octet_length("props").alias("x"))
    got = stats.throughput(e, ["event_type"], "ts", "x")
    return got.select("event_type", *(F.round(c, 9).alias(c) for c in ("ops_per_second", "bytes_per_second")))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def latency_moments(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"WITH {FILES} SELECT count(*) AS blobs, count(DISTINCT file) AS files, sum(len)::BIGINT AS used_bytes, (max(doc_id) FILTER (r = least(n * 50 // 100, n - 1) + 1))::BIGINT AS p50, (max(doc_id) FILTER (r = least(n * 99 // 100, n - 1) + 1))::BIGINT AS p99 FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM d)")
def cr_stats(spark, sf):
    d = records(spark, sf)
    sums = d.agg(F.count(F.lit(1)).alias("blobs"), F.countDistinct("file").alias("files"), F.sum("len").cast("long").alias("used_bytes"))
    n = d.count()
    at = lambda p: min(n * p // 100, n - 1) + 1
    ranks = scan.ranked(d.select("doc_id"), key="doc_id").filter(F.col("pos").isin(at(50), at(99)))
    picked = ranks.agg(F.max(F.when(F.col("pos") == at(50), F.col("doc_id"))).alias("p50"), F.max(F.when(F.col("pos") == at(99), F.col("doc_id"))).alias("p99"))
    return sums.join(F.broadcast(picked))  # one row each


@query("SELECT doc_id, strlen(text)::BIGINT AS len FROM documents ORDER BY doc_id LIMIT 10")
def cr_lowest(spark, sf):
    return records(spark, sf).orderBy("doc_id").limit(10).select("doc_id", long("len", "len"))


@query(f"WITH {FILES} SELECT file, min(doc_id) AS min_key, max(doc_id) AS max_key, count(*) AS entries, sum(len)::BIGINT AS bytes FROM d GROUP BY 1")
def load_cr(spark, sf):
    return records(spark, sf).groupBy("file").agg(F.min("doc_id").alias("min_key"), F.max("doc_id").alias("max_key"), F.count(F.lit(1)).alias("entries"), F.sum("len").cast("long").alias("bytes"))


VERIFY = "SELECT count(e) AS total, count(*) FILTER (e IS NOT NULL AND f IS NULL) AS lacking, count(*) FILTER (e IS NULL) AS surplus, count(*) FILTER (e IS NULL OR f IS NULL) = 0 AS ok FROM j"


@query(f"WITH {LIVE}, j AS (SELECT a.k AS e, b.k AS f FROM st a FULL JOIN (SELECT k FROM (SELECT k, arg_max(kind, off) AS kind FROM log GROUP BY 1) WHERE kind = 'record') b ON a.k = b.k) {VERIFY}")
def verify(spark, sf):
    rows = thin(spark, sf)
    return stats.verify(state.live(rows), state.merge_levels(tiers(spark, sf), ["k"]), ["k"])


@query(f"WITH {LIVE}, old AS (SELECT k FROM (SELECT * FROM log WHERE off < {LATE} QUALIFY row_number() OVER (PARTITION BY k ORDER BY off DESC) = 1) WHERE kind = 'record'), j AS (SELECT a.k AS e, b.k AS f FROM st a FULL JOIN old b ON a.k = b.k) {VERIFY}")
def verify_scan(spark, sf):
    rows = thin(spark, sf)
    return stats.verify(state.live(rows), state.live(rows, limit=late(spark, sf)), ["k"])


@query(f"WITH {LIVE} SELECT k, off FROM st WHERE off IN (SELECT event_id FROM events WHERE value >= 10)")
def dangling(spark, sf):
    kept = table(spark, sf, "events").filter("value >= 10").select(F.col("event_id").alias("off"))
    return state.live(thin(spark, sf)).join(kept, "off").select("k", "off")


@query(f"WITH {LIVE} SELECT count(*) AS n FROM st")
def count_live(spark, sf):
    return state.live(thin(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LIVE} SELECT ks, count(*) AS n FROM st GROUP BY 1")
def count_by_ks(spark, sf):
    return state.live(thin(spark, sf)).groupBy("ks").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT ks, count(DISTINCT k) AS n FROM log GROUP BY 1")
def distinct_keys(spark, sf):
    return thin(spark, sf).groupBy("ks").agg(F.countDistinct("k").alias("n"))


@query(f"WITH {LOG} SELECT ks, max(v) AS v, arg_max(off, (v, off)) AS off FROM log GROUP BY 1")
def largest_value(spark, sf):
    return thin(spark, sf).groupBy("ks").agg(F.max("v").alias("v"), F.max_by("off", F.struct("v", "off")).alias("off"))


@query(f"WITH {LOG} SELECT count(*) FILTER (off >= {MIDDLE}) AS entries, count(*) FILTER (off >= {MIDDLE} AND kind = 'record') AS records FROM log")
def since_offset(spark, sf):
    return thin(spark, sf).agg(F.count_if(F.col("off") >= middle(spark, sf)).alias("entries"), F.count_if((F.col("off") >= middle(spark, sf)) & (F.col("kind") == "record")).alias("records"))


@query(f"WITH {LIVE} SELECT (SELECT sum(16 + strlen(props)) FROM log)::BIGINT AS written, sum(16 + strlen(props))::BIGINT AS live, round((SELECT sum(16 + strlen(props)) FROM log)::DOUBLE / sum(16 + strlen(props))::DOUBLE, 4) AS ratio FROM st")
def write_amp(spark, sf):
    rows = log(spark, sf).select("off", "k", "kind", (F.octet_length("props") + 16).alias("b"))
    both = rows.agg(F.sum("b").cast("long").alias("written")).join(F.broadcast(state.live(rows).agg(F.sum("b").cast("long").alias("live"))))  # one row each
    return both.withColumn("ratio", F.round(F.col("written").cast("double") / F.col("live"), 4))


@query("WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, max(event_id) AS c FROM events GROUP BY 1) SELECT day::VARCHAR AS day, c - lag(c) OVER (ORDER BY day) AS delta, (day - lag(day) OVER (ORDER BY day))::BIGINT AS days FROM d")
def counter_rate(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("event_id").alias("c"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row per day
    return daily.select(F.col("day").cast("string").alias("day"), (F.col("c") - F.lag("c").over(w)).alias("delta"), F.date_diff("day", F.lag("day").over(w)).cast("long").alias("days"))


@query("SELECT o_orderpriority AS backend, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def bench_pivot(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("backend")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.select("backend", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


@query("SELECT event_type, median(value) AS median FROM events GROUP BY 1")
def bench_median(spark, sf):
    return stats.medians(table(spark, sf, "events"), ["event_type"], "value")


@query(f"WITH {LIVE} SELECT ks, count(*) AS n, ceil(-count(*) * ln(0.01) / (ln(2.0) * ln(2.0)))::BIGINT AS bits FROM st GROUP BY 1")
def bloom_size(spark, sf):
    g = state.live(thin(spark, sf)).groupBy("ks").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("bits", F.ceil(-F.col("n") * F.log(F.lit(0.01)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long"))


@query("SELECT source, sum(n_chars)::BIGINT AS n, CASE WHEN sum(n_chars) >= 1073741824 THEN printf('%.2f GiB', sum(n_chars) / 1073741824.0) WHEN sum(n_chars) >= 1048576 THEN printf('%.2f MiB', sum(n_chars) / 1048576.0) WHEN sum(n_chars) >= 1024 THEN printf('%.2f KiB', sum(n_chars) / 1024.0) ELSE printf('%d B', sum(n_chars)::BIGINT) END AS text FROM documents GROUP BY 1")
def human_bytes(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").cast("long").alias("n")).withColumn("text", scalars.human_bytes(F.col("n")))


# the log itself


@query(f"WITH {LOG} SELECT off, kind, ks, k, strlen(props)::BIGINT AS value_len, v FROM log")
def wal_walk(spark, sf):
    return log(spark, sf).select("off", "kind", "ks", "k", long(F.octet_length("props"), "value_len"), "v")


@query(f"WITH {LOG} SELECT off, kind, ks, k FROM log WHERE off >= {MIDDLE}")
def wal_walk_from(spark, sf):
    return thin(spark, sf).filter(F.col("off") >= middle(spark, sf)).select("off", "kind", "ks", "k")


@query(f"WITH {LIVE} SELECT k, off, props AS value FROM st")
def index_fetch(spark, sf):
    index = state.live(log(spark, sf).select("off", "k", "kind")).select("k", "off")
    return index.join(log(spark, sf).select("off", F.col("props").alias("value")), "off").select("k", "off", "value")


@query(f"WITH {LIVE} SELECT k, off, strlen(props)::BIGINT AS payload_len FROM st WHERE {CELL} = 30")
def load_index(spark, sf):
    live = state.live(log(spark, sf).select("off", "k", "kind", F.octet_length("props").alias("len")))
    return live.filter(keys.uniform_cell(F.md5("k"), 64) == 30).select("k", "off", long("len", "payload_len"))


@query(f"WITH {LIVE} SELECT (SELECT count(*) FROM log) = 0 AS never_written, count(*) = 0 AS nothing_live FROM st")
def is_empty(spark, sf):
    rows = thin(spark, sf)
    live = state.live(rows).agg((F.count(F.lit(1)) == 0).alias("nothing_live"))
    return rows.agg((F.count(F.lit(1)) == 0).alias("never_written")).join(F.broadcast(live))  # one row each


@query(f"""WITH a AS (SELECT event_type AS ks, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE event_id < {MIDDLE_ID} GROUP BY 1), b AS (SELECT event_type AS ks, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE event_id >= {MIDDLE_ID} GROUP BY 1)
SELECT coalesce(a.ks, b.ks) AS ks, a.n AS left_n, b.n AS right_n, a.u AS left_keys, b.u AS right_keys FROM a FULL JOIN b ON a.ks = b.ks""")
def compare_dbs(spark, sf):
    rows = thin(spark, sf)
    one = lambda df, side: df.groupBy("ks").agg(F.count(F.lit(1)).alias(f"{side}_n"), F.countDistinct("k").alias(f"{side}_keys"))
    return one(state.as_of(rows, middle(spark, sf)), "left").join(one(state.not_yet(rows, middle(spark, sf)), "right"), "ks", "full_outer").select("ks", "left_n", "right_n", "left_keys", "right_keys")


@query("""SELECT coalesce(n.n_name, r.r_name) AS name, CASE WHEN n.n_name IS NULL THEN 'new' WHEN r.r_name IS NULL THEN 'retained' ELSE 'kept' END AS status,
coalesce(n.n_nationkey::BIGINT, (SELECT max(n_nationkey) FROM nation)::BIGINT + row_number() OVER (PARTITION BY n.n_name IS NULL ORDER BY r.r_name)) AS id
FROM nation n FULL JOIN region r ON n.n_name = r.r_name""")
def reconcile_shape(spark, sf):
    stored = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("old_id"))
    declared = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit(True).alias("declared"))
    top = stored.agg(F.max("old_id").alias("top"))
    both = stored.join(declared, "name", "full_outer").join(F.broadcast(top))  # a registry is small
    new = F.row_number().over(Window.partitionBy(F.col("old_id").isNull()).orderBy("name"))
    status = F.when(F.col("old_id").isNull(), "new").when(F.col("declared").isNull(), "retained").otherwise("kept")
    return both.select("name", status.alias("status"), F.coalesce("old_id", F.col("top") + new).alias("id"))


# writing and streaming: rows that went through files and came back


def _store(spark: SparkSession, sf: str):  # noqa: ANN202
    """A store of the whole log in two commits, the older half of the offsets and the newer."""
    from keyloom.sources.registry import KeySpace
    from keyloom.sources.store import Store

    rows = log(spark, sf)
    low, high = rows.agg(F.min("off"), F.max("off")).first()
    writes = rows.select("ks", "k", F.col("off").cast("string").cast("binary").alias("v"), "kind", F.col("off").alias("nth"))
    names = sorted(r["ks"] for r in rows.select("ks").distinct().collect())  # key spaces
    made = Store.create(spark, new_folder(spark, "store"), [KeySpace(n, key_length=8) for n in names])
    made.commit(state.as_of(writes, (low + high) // 2, "nth"))
    made.commit(state.not_yet(writes, (low + high) // 2, "nth"))
    return made, names


def _held(rows: DataFrame) -> DataFrame:
    """What a store's row says of where it came from: its value is its offset in `events`."""
    return rows.select("ks", "k", F.col("v").cast("string").cast("long").alias("off"))


NEWEST = "newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY ks, k ORDER BY off DESC) = 1)"


@query(f"WITH {LOG} SELECT ks, k FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY ks, k ORDER BY off DESC) = 1) WHERE kind = 'record'")
def batch_commit(spark, sf):
    made, _ = _store(spark, sf)
    return state.live(made.log(), ["ks", "k"]).select("ks", "k")


@query(f"WITH {LOG}, {NEWEST} SELECT ks, k, off FROM newest WHERE kind = 'record'")
def store_compact(spark, sf):
    made, _ = _store(spark, sf)
    return _held(made.compacted(new_folder(spark, "compacted")).log())


@query(f"WITH {LOG}, {NEWEST} SELECT ks, k, off FROM newest WHERE kind = 'record' AND NOT (ks = (SELECT min(ks) FROM log) AND off % 2 = 1)")
def store_relocate(spark, sf):
    made, names = _store(spark, sf)
    odd = F.col("v").cast("string").cast("long") % 2 == 1
    return _held(made.relocated(names[0], F.when(odd, "remove").otherwise("keep"), new_folder(spark, "relocated")).log())


@query(f"WITH {LOG}, {NEWEST}, live AS (SELECT ks, count(*) AS n FROM newest WHERE kind = 'record' GROUP BY 1) SELECT DISTINCT log.ks, coalesce(n, 0)::BIGINT AS total, 0::BIGINT AS lacking, 0::BIGINT AS surplus, true AS ok FROM log LEFT JOIN live USING (ks)")
def store_verify(spark, sf):
    made, names = _store(spark, sf)
    rows = [(n, *made.verify(n).values()) for n in names]  # one row per key space
    return spark.createDataFrame(rows, "ks string, total long, lacking long, surplus long, ok boolean")


@query(f"WITH {LOG}, {NEWEST} SELECT ks, k, off FROM newest WHERE kind = 'record'")
def store_retained(spark, sf):
    """Key spaces that are not declared while the store is compacted come back whole."""
    from keyloom.sources.store import Store

    made, names = _store(spark, sf)
    spaces = [s for s in made.spaces if s.name != names[0]]
    other = Store.open(spark, made.root, spaces).compacted(new_folder(spark, "compacted"))
    return _held(Store.open(spark, other.root, made.spaces).log())


@query(f"WITH {LOG}, {NEWEST} SELECT ks, k, off FROM newest WHERE kind = 'record'")
def store_recovered(spark, sf):
    """A snapshot of the first commit and the log's tail give what the whole log gives."""
    made, _ = _store(spark, sf)
    first = made.copied(new_folder(spark, "first"), 1)
    folder = new_folder(spark, "snapshot")
    return _held(made.recovered(folder, first.snapshot(folder)))


@query(f"WITH {LOG}, {NEWEST} SELECT ks, k, off FROM newest WHERE kind = 'record'")
def store_tiers(spark, sf):
    """Two flushes, the second of which promotes the cells with many keys, and a tail that is not flushed."""
    from keyloom.sources.tiers import Tiers

    made, names = _store(spark, sf)
    tiers = Tiers(made, new_folder(spark, "tiers"))
    top = made.frontier()
    tiers.flush(top, until=top // 3)
    tiers.flush(top // 20, until=top - top // 10)
    states = [_held(tiers.state(n)) for n in names]  # key spaces
    return functools.reduce(DataFrame.unionByName, states)


@query(f"WITH {LIVE} SELECT k, off, kind FROM live")
def stream_live_state(spark, sf):
    from keyloom.streaming import live

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = live.read_files(spark, sf, schema, glob="events.parquet")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("record")
    rows = stream.select(F.col("event_id").alias("off"), keys.hex_key(F.col("user_id")).alias("k"), kind.alias("kind"))
    return live.keep_newest(rows, new_folder(spark, "state"), new_folder(spark, "stream")).select("k", "off", "kind")
