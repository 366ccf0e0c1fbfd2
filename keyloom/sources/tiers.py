"""Two tiers of a store's index state: L0 for cells with few entries, L1 for cells with many.

A flush is a Spark job: it takes the log's entries since the flush before, merges the newest of each key into L0, and
moves the cells that hold more than a limit to L1. L0 is written anew, as it is small; of L1 only the cells that take
something in are. Each flush writes folders of its own, and counts once its last one, `upto`, is there; a flush that
failed is written over by the next. Removals are kept in L0, where they hide what L1 has, and go in L1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import keys
from keyloom.operators import state
from keyloom.operators.lineage import cut, small
from keyloom.sources.store import LOG, Store

KEY = ["ks", "index_key"]
CELL = ["ks", "cell"]
LEVEL = T.StructType([*LOG.fields, T.StructField("index_key", T.StringType()), T.StructField("cell", T.LongType())])
#: marks in `upto`: flush, first offset that it does not hold
MARK = "gen long, upto long"


class Tiers:
    def __init__(self, store: Store, folder: str) -> None:
        self.store, self.spark, self.folder = store, store.spark, folder.rstrip("/")

    def flushed(self) -> tuple[int, int]:
        """How many flushes are complete, and the offset up to which (exclusive) they hold the log."""
        from keyloom.sources.store import _folder

        fs, path = _folder(self.spark, f"{self.folder}/upto")
        if not fs.exists(path) or not fs.listStatus(path):
            return 0, 0
        done = self.spark.read.schema(MARK).option("recursiveFileLookup", "true").parquet(f"{self.folder}/upto")
        got = done.agg(F.max(F.struct("gen", "upto")).alias("last")).first()["last"]  # one row per flush
        return (got["gen"], got["upto"]) if got else (0, 0)

    def level(self, name: str) -> DataFrame:
        """The rows of L0, removals among them, or of L1."""
        gen, _ = self.flushed()
        if not gen:
            return self.spark.createDataFrame([], LEVEL)
        if name == "L0":
            return self.spark.read.schema(LEVEL).parquet(f"{self.folder}/L0/gen={gen}")
        # of each cell the rows of the last flush that wrote it, if only to empty it
        part = T.StructField("gen", T.LongType())
        moved = self.spark.read.schema(T.StructType([LEVEL["ks"], LEVEL["cell"], part])).parquet(f"{self.folder}/cells")
        last = moved.filter(F.col("gen") <= gen).groupBy(*CELL).agg(F.max("gen").alias("gen"))
        rows = self.spark.read.schema(T.StructType([*LEVEL.fields, part])).parquet(f"{self.folder}/L1")
        return rows.join(small(last), [*CELL, "gen"], "left_semi").select(*LEVEL.names)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """With the index key and the cell that each key space's own number of cells gives it."""
        indexed = self.store._indexed(rows)
        cell = F.lit(0).cast("long")
        for s in self.store.spaces:
            cell = F.when(F.col("ks") == s.name, keys.uniform_cell(F.col("index_key"), s.cells).cast("long")).otherwise(cell)
        return indexed.withColumn("cell", cell).select(*LEVEL.names)

    def flush(self, limit: int, until: int | None = None) -> int:
        """Take in the log below `until`, or all of it, and promote cells of over `limit` entries. The flush's number."""
        gen, since = self.flushed()
        upto = self.store.frontier() if until is None else max(since, until)
        fresh = self.store.log(hidden=True).filter((F.col("off") >= since) & (F.col("off") < upto))
        # by offset, not by level: what is newer wins wherever it lies
        top = state.newest(self._placed(fresh).unionByName(self.store.uncovered(self.level("L0"))), KEY).select(*LEVEL.names)
        top, cold = cut(top), self.level("L1")
        full = top.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(*CELL)
        # cells of L1 from which a drop takes keys are written too, without those
        dropped = self.store.covered(cold, since).select(*CELL)
        moving = cut(full.union(dropped).distinct())  # a row per cell
        into = top.join(small(moving), CELL, "left_semi").unionByName(self.store.uncovered(cold.join(small(moving), CELL, "left_semi")))
        number = gen + 1
        self._write(state.live(into, KEY).select(*LEVEL.names), f"L1/gen={number}")
        self._write(top.join(small(moving), CELL, "left_anti"), f"L0/gen={number}")
        moving.write.mode("overwrite").parquet(f"{self.folder}/cells/gen={number}")
        self.spark.createDataFrame([(number, upto)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/upto/{number}")
        return number

    def _write(self, rows: DataFrame, name: str) -> None:
        dealt = rows.repartitionByRange(*CELL, "index_key").sortWithinPartitions(*CELL, "index_key")
        dealt.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def state(self, ks: str) -> DataFrame:
        """The live rows of a key space: what was flushed, and the log's entries since."""
        _, upto = self.flushed()
        name = self.store.space(ks).name
        held = self.level("L0").unionByName(self.level("L1"))
        since = self._placed(self.store.log().filter(F.col("off") >= upto))
        rows = self.store.uncovered(held).unionByName(since).filter(F.col("ks") == name)
        return state.live(rows, KEY).select(*LOG.names)
