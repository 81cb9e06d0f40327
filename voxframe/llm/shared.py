"""Intermediate tables in the folder that driver and executors share, and maps of wanted keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import lean


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A session that names none is refused: a folder of this machine alone would lose
    what executors write."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="voxframe-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_folders: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all operators that this process has run.  Results that have not been written or
    read yet may still need them: call it after that."""
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one run.  ``keep`` writes a table and reads it back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _folders.append(self.folder)
        self.kept: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        self.kept.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables: each name, and what was kept under it with a number."""
        for name in [k for k in self.kept if any(k == n or k.startswith(f"{n}-") for n in names)] or list(names):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.kept = [k for k in self.kept if k != name]


class KeyMap:
    """A broadcast bit map of the keys (a column of well-spread longs) of a table: what it excludes is not in the table.

    It has BITS_A_KEY bits for each key.  From MOST_BITS on it would not fit every task, and would spare little as the
    keys are a fixed part of the rows: then it excludes nothing, and the join that follows does all the work.
    """

    BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27

    def __init__(self, keys: DataFrame, column: str):
        self.column, self.bits = column, None
        n = max(keys.count(), 1)
        size = max(self.LEAST_BITS, 1 << (n * self.BITS_A_KEY - 1).bit_length())
        if size > self.MOST_BITS:
            return
        self.size = size
        cell = F.pmod(F.col(column), F.lit(size))
        words = (
            keys.select(
                (cell / 64).cast("int").alias("word"),
                F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"),
            )
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toPandas()
        )
        table = np.zeros(size // 64, dtype=np.uint64)
        table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        self.bits = keys.sparkSession.sparkContext.broadcast(table)

    def test(self) -> Callable[[np.ndarray], np.ndarray] | None:
        """For use inside tasks: which of some keys may be in the table; None if the map excludes nothing."""
        if self.bits is None:
            return None
        bits, size = self.bits, self.size

        def hits(keys: np.ndarray) -> np.ndarray:
            cell = keys % size
            return (bits.value[cell // 64] >> (cell % 64).astype(np.uint64)) & np.uint64(1) != 0

        return hits

    def filter(self, df: DataFrame, inside: bool = True) -> DataFrame | None:
        """Rows whose key may be in the table, or (not inside) those whose key is not; None if the map excludes nothing."""
        hits = self.test()
        if hits is None:
            return df if inside else None
        at = df.columns.index(self.column)

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(hits(batch.column(at).to_numpy()) == inside))

        return df.mapInArrow(lean(run), df.schema)
