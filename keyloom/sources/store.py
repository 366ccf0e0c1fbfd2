"""A change log kept as a plain Parquet table, and the Spark jobs that users of such a log run over it.

A commit is a folder of the table, written by one Spark job; it counts once Spark has marked it as complete, whole, for
all key spaces. Folders are never changed, so a version is a number of commits, and reading an older one is a filter.
Dropped ranges and destroyed key spaces are entries of the log like others. Compaction, relocation and copies write a
new table and leave the old one as it is. Whoever needs several writers at a time, or the swap of one table for another
in place, puts a table format under it; none is built here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyloom.functions import keys
from keyloom.operators import retention, scan, state, stats
from keyloom.operators.lineage import cut, small
from keyloom.sources.registry import KeySpace, from_json, reconcile, to_json

LOG = T.StructType([T.StructField("ks", T.StringType()), T.StructField("off", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("k", T.StringType()), T.StructField("v", T.BinaryType())])
#: above every key in hex
TOP = "g"
#: a row's key lies in a range that was dropped after it was written
COVERED = "ks = of AND off < at AND k BETWEEN first AND last"


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        held = json.loads(spark.read.text(f"{self.root}/spaces", wholetext=True).first()[0])
        self.spaces, self.settings = from_json(held["spaces"]), held["settings"]

    # opening and lifecycle

    @classmethod
    def create(cls, spark: SparkSession, root: str, spaces: list[KeySpace], settings: dict | None = None) -> Store:
        """A new store; fails if there is one. `settings` stay with it: `codec` of its files, and what its users add."""
        cls._describe(spark, root, reconcile([], spaces), settings or {}, "errorifexists")
        return cls(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str, spaces: list[KeySpace]) -> Store:
        """The store with `spaces` declared; others are kept but hidden."""
        store = cls(spark, root)
        store.spaces = reconcile(store.spaces, spaces)
        cls._describe(spark, root, store.spaces, store.settings, "overwrite")
        return store

    @staticmethod
    def _describe(spark: SparkSession, root: str, spaces: list[KeySpace], settings: dict, mode: str) -> None:
        text = json.dumps({"spaces": to_json(spaces), "settings": settings})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{root.rstrip('/')}/spaces")

    def drop(self) -> None:
        fs, path = _folder(self.spark, self.root)
        fs.delete(path, True)

    def space(self, name: str | int) -> KeySpace:
        for s in self.spaces:
            if s.state == "declared" and (s.name == name or s.id == name):
                return s
        raise KeyError(f"no key space {name!r}")

    # versions

    def commits(self) -> list[str]:
        """Folders of complete commits, oldest first."""
        fs, path = _folder(self.spark, f"{self.root}/log")
        if not fs.exists(path):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        return [n for n in names if fs.exists(_folder(self.spark, f"{self.root}/log/{n}/_SUCCESS")[1])]

    def version(self) -> int:
        return len(self.commits())

    def is_empty(self) -> bool:
        return not self.commits()

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.root}/log/{n}" for n in names)) if names else self.spark.createDataFrame([], LOG)

    def frontier(self, version: int | None = None) -> int:
        """The offset that the next commit begins with, or began with after a version."""
        for name in reversed(self.commits()[:version]):  # the newest commit that has rows: nearly always the first looked at
            top = self._read([name]).agg(F.max("off")).first()[0]
            if top is not None:
                return max(top + 1, self.settings.get("frontier", 0))
        return self.settings.get("frontier", 0)

    # writing

    def commit(self, writes: DataFrame, source: str = "", batch: int | None = None) -> int:
        """Append rows (ks, k in hex, v, kind, nth) in one step; of a key's writes the highest nth stays. The new version.

        A commit with a batch number is made once: if that source's batch is there, nothing is written, and what an
        attempt that failed has left is written over. So a stream that repeats its last batch commits it once.
        """
        names = self.commits()
        mark = f".{source}.{batch}" if batch is not None else ""
        if mark and any(n.endswith(mark) for n in names):
            return len(names)
        self._check(writes)
        once = cut(state.newest(writes, ["ks", "k"], "nth").select("ks", "kind", "k", F.col("v").cast("binary").alias("v"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
        runs = once.groupBy("part").count()  # a row per partition
        ahead = runs.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("ahead"))
        rows = once.join(F.broadcast(ahead), "part").withColumn("off", F.col("row") + F.col("ahead") + F.lit(self.frontier()))
        return self._append(rows, mark)

    def _append(self, rows: DataFrame, mark: str = "") -> int:
        names = self.commits()
        folder = f"{self.root}/log/{int(names[-1][:8]) + 1 if names else 0:08d}{mark}"
        rows.select(*LOG.names).write.mode("overwrite").option("compression", self.settings.get("codec", "zstd")).parquet(folder)
        return len(names) + 1

    def _check(self, writes: DataFrame) -> None:
        """Every write's key space is declared and its key as long as that one says: one pass over the writes."""
        shown = [s for s in self.spaces if s.state == "declared"]
        right = F.lit(None).cast("boolean")
        for s in shown:
            fits = F.length("k") == 2 * s.key_length if s.indexing in ("fixed", "reduction") and s.key_length else F.length("k") <= 2 * 65535
            right = F.when(F.col("ks") == s.name, fits).otherwise(right)
        unknown, wrong = writes.agg(F.min(F.when(right.isNull(), F.col("ks"))), F.min(F.when(~right, F.col("ks")))).first()
        if unknown is not None:
            raise KeyError(f"no key space {unknown!r}")
        if wrong is not None:
            raise ValueError(f"{wrong}: a key has the wrong length")

    def batch(self) -> Batch:
        return Batch(self)

    def insert(self, ks: str, key: bytes, value: bytes) -> int:
        return self.batch().write(ks, key, value).commit()

    def remove(self, ks: str, key: bytes) -> int:
        return self.batch().delete(ks, key).commit()

    def _entry(self, ks: str, first: str, last: str) -> int:
        row = (ks, self.frontier(), "drop", first, bytearray(last.encode()))
        return self._append(self.spark.createDataFrame([row], LOG))

    def drop_cells(self, ks: str, first: bytes, last: bytes) -> int:
        """Drop whole cells: `first` and `last` must be the first and the last key of cells."""
        s = self.space(ks)
        low, high = keys.uniform_cell_of(first, s.cells), keys.uniform_cell_of(last, s.cells)
        if keys.uniform_cell_range(low, s.cells, len(first))[0] != first or keys.uniform_cell_range(high, s.cells, len(last))[1] != last:
            raise ValueError("both ends must be edges of cells")
        return self._entry(ks, first.hex(), last.hex())

    def destroy(self, ks: str) -> int:
        s = self.space(ks)
        self.spaces = [KeySpace(**{**row, "state": "destroyed"}) if row["id"] == s.id else KeySpace(**row) for row in to_json(self.spaces)]
        version = self._entry(ks, "", TOP)
        self._describe(self.spark, self.root, self.spaces, self.settings, "overwrite")
        return version

    # reading

    def log(self, version: int | None = None, hidden: bool = False) -> DataFrame:
        """All writes of a version; those that a later drop covers are gone; undeclared key spaces only if `hidden`."""
        rows = self._read(self.commits()[:version])
        if not hidden:
            rows = rows.filter(F.col("ks").isin([s.name for s in self.spaces if s.state == "declared"]))
        writes = rows.filter("kind <> 'drop'")
        return self.uncovered(writes, version)

    def _drops(self, version: int | None = None) -> DataFrame:
        drops = self._read(self.commits()[:version]).filter("kind = 'drop'")
        return drops.select(F.col("ks").alias("of"), F.col("off").alias("at"), F.col("k").alias("first"), F.col("v").cast("string").alias("last"))

    def uncovered(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """Rows that no later drop of the log covers."""
        drops = self._drops(version)
        return rows.join(small(drops), F.expr(COVERED), "left_anti") if drops.limit(1).count() else rows

    def covered(self, rows: DataFrame, since: int) -> DataFrame:
        """Rows that a later drop of the log covers, one at an offset from `since` on."""
        return rows.join(small(self._drops().filter(F.col("at") >= since)), F.expr(COVERED), "left_semi")

    def _indexed(self, rows: DataFrame) -> DataFrame:
        """With `index_key`: what stands for the key in its key space; keys that are reduced alike overwrite each other."""
        index = F.col("k")
        for s in self.spaces:
            if s.reduce_to is not None and s.state != "destroyed":
                index = F.when(F.col("ks") == s.name, keys.reduced(F.col("k"), *s.reduce_to)).otherwise(index)
        return rows.withColumn("index_key", index)

    def state(self, ks: str | int, version: int | None = None) -> DataFrame:
        return state.live(self._indexed(self.log(version).filter(F.col("ks") == self.space(ks).name)), ["ks", "index_key"])

    def get(self, ks: str | int, key: bytes, version: int | None = None) -> bytes | None:
        got = scan.get(self.state(ks, version), key.hex()).select("v").take(1)
        return bytes(got[0]["v"]) if got else None

    def exists(self, ks: str | int, key: bytes, version: int | None = None) -> bool:
        return bool(scan.get(self.state(ks, version), key.hex()).select("k").take(1))

    def multi_get(self, ks: str | int, probes: DataFrame, version: int | None = None) -> DataFrame:
        return scan.multi_get(self.state(ks, version), probes)

    def scan(self, ks: str | int, lower: bytes | None = None, upper: bytes | None = None, reverse: bool = False, version: int | None = None) -> DataFrame:
        if lower is not None or upper is not None or reverse:
            self.space(ks).check_bounds()
        rows = scan.bounded(self.state(ks, version), lower and lower.hex(), None if upper is None else upper.hex())
        return scan.ordered(rows, reverse).select("k", "v", "off")

    def get_lt(self, ks: str | int, key: bytes, n: int) -> DataFrame:
        self.space(ks).check_bounds()
        return scan.less_than(self.state(ks), key.hex(), n).select("k", "v")

    # maintenance: each job writes a new table

    def _rewrite(self, rows: DataFrame, to: str, version: int | None = None) -> Store:
        """A store at `to` whose first commit is `rows`, by key range and sorted; offsets are kept, and none is used again."""
        self._describe(self.spark, to, self.spaces, self.settings | {"frontier": self.frontier(version)}, "errorifexists")
        made = Store(self.spark, to)
        made._append(rows.repartitionByRange("ks", "k").sortWithinPartitions("ks", "k"))
        return made

    def compacted(self, to: str) -> Store:
        """The live rows alone, those of undeclared key spaces among them."""
        return self._rewrite(state.live(self._indexed(self.log(hidden=True)), ["ks", "index_key"]), to)

    def relocated(self, ks: str, decide: Column, to: str, mode: str = "index", target: int | None = None, parts: int = 1) -> Store:
        """A relocation filter applied to one key space; of others the live rows stay.

        `decide` gives keep, remove or stop for (k, v, off, kind). Mode `log`: the first stop sets the cut. Mode
        `index`: live rows below the target that decide remove go. What a row that goes had overwritten stays gone.
        The key range is moved in so many parts of like width, each a commit of the new store. A call that ended early
        is resumed by the same call: the version it began with and the target are kept with the new store, and the parts
        that are there are not made again.
        """
        name = self.space(ks).name
        asked = {"ks": name, "mode": mode, "asked": target, "parts": parts}
        fs, path = _folder(self.spark, f"{to.rstrip('/')}/spaces/_SUCCESS")
        if fs.exists(path):
            made = Store(self.spark, to)
            if {k: v for k, v in made.settings.get("relocation", {}).items() if k in asked} != asked:
                raise ValueError(f"{to}: not a relocation to resume")
        else:
            plan = asked | {"version": self.version(), "below": self.frontier() if target is None else target}
            self._describe(self.spark, to, self.spaces, self.settings | {"frontier": self.frontier(), "relocation": plan}, "errorifexists")
            made = Store(self.spark, to)
        plan = made.settings["relocation"]
        rows = self._indexed(self.log(plan["version"], hidden=True))
        if mode == "log":
            left = retention.relocate_by_log(rows, ["ks", "index_key"], decide, F.col("ks") == name)
        else:
            left = retention.relocate_by_index(rows, ["ks", "index_key"], F.when(F.col("ks") == name, decide).otherwise("keep"), plan["below"])
        for part in range(made.version(), parts):  # the bookmark: parts are made in order
            of_part = left if parts == 1 else left.filter(keys.uniform_cell(F.col("index_key"), parts) == part)
            made._append(of_part.repartitionByRange("ks", "k").sortWithinPartitions("ks", "k"), f".part.{part}")
        settings = {k: v for k, v in made.settings.items() if k != "relocation"}
        self._describe(self.spark, to, made.spaces, settings, "overwrite")
        return Store(self.spark, to)

    def copied(self, to: str, version: int | None = None) -> Store:
        """A version of the store, as it was, at another place."""
        return self._rewrite(self.log(version, hidden=True), to, version)

    def snapshot(self, to: str) -> int:
        """Write the newest entry of every key, removals too, and return the offset from which to replay."""
        replay_from = self.frontier()
        newest = state.newest(self._indexed(self.log(hidden=True)), ["ks", "index_key"])
        newest.select(*LOG.names).repartitionByRange("ks", "k").sortWithinPartitions("ks", "k").write.parquet(to)
        return replay_from

    def recovered(self, snapshot: str, replay_from: int) -> DataFrame:
        """Live rows from a snapshot and the log's tail."""
        held = self.spark.read.schema(LOG).parquet(snapshot)
        tail = self._read(self.commits()).filter((F.col("off") >= replay_from) & (F.col("kind") != "drop"))
        rows = self.uncovered(held.unionByName(tail))
        return state.live(self._indexed(rows.filter(F.col("ks").isin([s.name for s in self.spaces if s.state == "declared"]))), ["ks", "index_key"])

    def target_position(self, ratio: float) -> int | None:
        """The offset at a ratio of the way from the lowest to the highest; none for an empty log."""
        return retention.target_position(self.log(), ratio).first()["target"]

    def files(self) -> DataFrame:
        """The log's files: name, size, time of change; a listing, no row is read."""
        return list_files(self.spark, f"{self.root}/log/*")

    def verify(self, ks: str | int) -> dict:
        """Live keys by the log against those that a scan finds: totals, lacking, surplus, ok."""
        name = self.space(ks).name
        rows = self._indexed(self.log().filter(F.col("ks") == name))
        top = rows.groupBy("index_key").agg(F.max("off").alias("off"))
        expected = rows.join(top, ["index_key", "off"], "left_semi").filter("kind = 'record'")
        return stats.verify(expected, self.state(ks), ["k"]).first().asDict()


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """name, size, created of the files of a folder that match a pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("created"))


class Batch:
    """Writes across key spaces that become visible together."""

    def __init__(self, store: Store) -> None:
        self.store, self.rows = store, []

    def write(self, ks: str, key: bytes, value: bytes) -> Batch:
        self.rows.append((ks, key.hex(), bytearray(value), "record", len(self.rows)))
        return self

    def delete(self, ks: str, key: bytes) -> Batch:
        self.rows.append((ks, key.hex(), None, "remove", len(self.rows)))
        return self

    def commit(self) -> int:
        if not self.rows:
            return self.store.version()
        return self.store.commit(self.store.spark.createDataFrame(self.rows, "ks string, k string, v binary, kind string, nth long"))
