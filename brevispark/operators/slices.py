"""Long steps in slices: each is committed when it is done, and a run that dies goes on with the slices that are missing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Runs under a folder. A run has a plan (its work list, dealt into slices by a hash of the key) and a folder for each slice; a slice is
    committed by the marker that Spark's writer puts last, so it counts wholly or not at all, and writing it again replaces it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{path}/_SUCCESS"))

    def runs(self) -> list[str]:
        """Runs that were begun and not finished."""
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(self.root)) if self._there(f"{self.root}/{x.getPath().getName()}/plan"))

    def begin(self, work: DataFrame, key: Sequence[str], rows_per_slice: int) -> str:
        """Writes the plan of a run: its rows must not be computed anew, and each slice reads only its own files."""
        run = uuid.uuid4().hex
        n = max(1, -(-work.count() // max(1, rows_per_slice)))
        dealt = work.withColumn("_slice", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
        # a slice's rows go to as many tasks as can work on it at once, in some hundred rows each; one task would write, and read, the whole slice
        parts = max(1, min(self.spark.sparkContext.defaultParallelism, rows_per_slice // 256))
        part = F.pmod(F.xxhash64(*key, F.lit(n)), F.lit(parts))
        dealt.repartition(F.col("_slice"), part).write.partitionBy("_slice").parquet(f"{self.root}/{run}/plan")
        return run

    def slices(self, run: str) -> list[int]:
        """Slices of a run that have rows."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{run}/plan"))]
        return sorted(int(n.removeprefix("_slice=")) for n in names if n.startswith("_slice="))

    def committed(self, run: str) -> list[int]:
        return [s for s in self.slices(run) if self._there(f"{self.root}/{run}/done-{s}")]

    def work(self, run: str, slice_: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{run}/plan/_slice={slice_}")

    def process(self, run: str, step: Callable[[DataFrame], DataFrame]) -> int:
        """Runs the step on slices that are not committed yet, one after the other. Returns how many those were."""
        done = set(self.committed(run))
        todo = [s for s in self.slices(run) if s not in done]
        for s in todo:
            step(self.work(run, s)).write.mode("overwrite").parquet(f"{self.root}/{run}/done-{s}")
        return len(todo)

    def result(self, run: str) -> DataFrame | None:
        """Rows of all committed slices."""
        done = self.committed(run)
        return self.spark.read.parquet(*[f"{self.root}/{run}/done-{s}" for s in done]) if done else None

    def drop(self, run: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{run}"), True)


def in_slices(ledger: Ledger, work: Callable[[], DataFrame], key: Sequence[str], step: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], object], rows_per_slice: int) -> dict:
    """First stores what earlier runs have committed, then runs the step on what is still open and stores that.

    work: the work list, asked for after the earlier runs' rows are stored, so that it holds the rest only. store: puts rows in the place
    of those with the same keys; storing rows twice must change nothing. A run that dies leaves its committed slices to the next one."""
    resumed = 0
    for run in ledger.runs():
        rows = ledger.result(run)
        if rows is not None:
            resumed += rows.count()
            store(rows)
        ledger.drop(run)
    run = ledger.begin(work(), key, rows_per_slice)
    n = ledger.process(run, step)
    rows = ledger.result(run)
    if rows is not None:
        store(rows)
    ledger.drop(run)
    return {"resumed": resumed, "slices": n}
