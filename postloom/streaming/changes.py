"""State of foreachBatch queries as a base table plus change folders.

A batch reads the state of the keys it touches and writes only their new rows. Every few batches all rows are
written once as a new base, and folders that no replay can need are deleted. So bytes written follow the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


class ChangeStore:
    """Rows by `keys` below `path`; a key may have any number of rows, all of which a change replaces.

    `initial` is the state before the first batch; it is read, never copied, until the first base. A batch that is
    replayed sees the changes before it only and replaces its own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], initial: DataFrame, every: int = 16):
        self.spark, self.path, self.keys, self.initial, self.every = spark, path, keys, initial, every

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders of a kind: some more than `every` at most."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = fs_path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{VERSION}=")]
        return sorted(n for n in numbers if fs.exists(fs_path(f"{self.path}/{kind}/{VERSION}={n}/_SUCCESS")))

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{VERSION}={n}" for n in numbers])

    def _same(self, rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """Join by the keys, nulls equal; the key columns of `rows` stay."""
        other = other.select(*[F.col(k).alias(f"_{k}") for k in self.keys], *[c for c in other.columns if c not in self.keys])
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        condition = on[0]
        for c in on[1:]:
            condition &= c
        return rows.join(other, condition, how).drop(*[f"_{k}" for k in self.keys])

    def current(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The rows that the batches before one have left, of the keys in `touched` only if given."""
        bases = [n for n in self._numbers("base") if before is None or n < before]
        start = bases[-1] if bases else -1
        rows = self._read("base", [start]).drop(VERSION) if bases else self.initial
        rows = rows if touched is None else self._same(rows, touched, "left_semi")
        changes = [n for n in self._numbers("touched") if n > start and (before is None or n < before)]
        if not changes:
            return rows
        marks, changed = self._read("touched", changes), self._read("rows", changes)
        if touched is not None:
            marks, changed = self._same(marks, touched, "left_semi"), self._same(changed, touched, "left_semi")
        latest = marks.groupBy(*self.keys).agg(F.max(VERSION).alias("_latest"))
        kept = self._same(changed, latest, "inner").where(F.col(VERSION) == F.col("_latest")).drop(VERSION, "_latest")
        return self._same(rows, latest.drop("_latest"), "left_anti").unionByName(kept, allowMissingColumns=True)

    def write(self, batch_id: int, rows: DataFrame, touched: DataFrame) -> None:
        """The new rows of the keys `touched`; the list of these is written last and makes the change count."""
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{VERSION}={batch_id}")
        touched.select(*self.keys).distinct().write.mode("overwrite").parquet(f"{self.path}/touched/{VERSION}={batch_id}")

    def compact(self, batch_id: int, live: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> bool:
        """After a batch: a new base of the rows that `live` leaves, if `every` changes have come since the last one."""
        bases = [n for n in self._numbers("base") if n < batch_id]
        start = bases[-1] if bases else -1
        if batch_id - start < self.every:
            return False
        live(self.current(batch_id + 1)).write.mode("overwrite").parquet(f"{self.path}/base/{VERSION}={batch_id}")
        # a replay of this batch starts from the base before; older folders serve nobody
        for kind, until in (("base", start - 1), ("rows", start), ("touched", start)):
            for n in self._numbers(kind):
                if n <= until:
                    folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{VERSION}={n}")
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return True
