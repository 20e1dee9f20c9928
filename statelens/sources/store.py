"""The state store: Parquet partitioned by run, layer and batch.

Every append, of a batch or of a stream's micro-batch, is a batch of its own: a folder that is
written whole, so doing it again replaces it and nothing is kept twice. Batch and stream share
a store. A run is never changed, only added to or reset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["run_id", "layer", "instance_id", "position", "state"]


class StateStore:
    """States under `path`/states. wide: BINARY keys instead of BIGINT ones."""

    def __init__(self, spark: SparkSession, path: str, wide: bool = False):
        self.spark, self.path = spark, f"{path.rstrip('/')}/states"
        self.schema = f"run_id string, layer string, batch string, instance_id bigint, position int, state {'binary' if wide else 'bigint'}"

    def new_run(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def _fs(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        p, fs = self._fs(*parts)
        return fs.exists(p)

    def create(self, states: DataFrame, run_id: str) -> None:
        """Write a run's first states; a run that is there already is an error, and stays as it is.

        The run's folder is made first, which only one of several writers can do.
        """
        p, fs = self._fs(f"run_id={run_id}")
        fs.mkdirs(p.getParent())
        mark, _ = self._fs("_runs", run_id)
        fs.mkdirs(mark.getParent())
        if fs.exists(p) or not fs.createNewFile(mark):
            raise FileExistsError(f"run {run_id} is in the store already")
        self.append(states, run_id)

    def append(self, states: DataFrame, run_id: str, batch: str | None = None) -> None:
        """Add states as a batch of their own; each task writes the layers it holds, and nothing is shuffled.

        batch: a name that makes the append repeatable. Writing a batch of that name again replaces it.
        """
        rows = states.drop("run_id", "batch").withColumn("run_id", F.lit(run_id)).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        lacking = [c for c in COLUMNS if c not in rows.columns]
        for c in lacking:
            rows = rows.withColumn(c, F.lit("layer") if c == "layer" else F.lit(0).cast("int" if c == "position" else "bigint"))
        rows = rows.select(*COLUMNS, "batch")
        if batch is not None:
            self._clear(run_id, batch)
        rows.write.mode("append").partitionBy("run_id", "layer", "batch").parquet(self.path)

    def _clear(self, run_id: str, batch: str) -> None:
        """Delete what an earlier try has written of a batch, in whatever layers."""
        run, fs = self._fs(f"run_id={run_id}")
        if fs.exists(run):
            for found in fs.globStatus(self._fs(f"run_id={run_id}", "layer=*", f"batch={batch}")[0]) or ():
                fs.delete(found.getPath(), True)

    def read(self, run_id: str | None = None, layers: Iterable[str] | None = None) -> DataFrame:
        """States, raw: of one run or all, of some layers or all; both filters prune folders."""
        names = [c for c in COLUMNS]
        if not self._exists():
            return self.spark.createDataFrame([], self.schema).select(*names)
        out = self.spark.read.schema(self.schema).parquet(self.path).select(*names)
        if run_id is not None:
            out = out.where(F.col("run_id") == run_id)
        return out if layers is None else out.where(F.col("layer").isin(list(layers)))

    def reset(self, run_id: str, layers: Iterable[str] | None = None) -> None:
        """Forget the states of a run's layers, or of all: what is written next is all there is."""
        if layers is None:
            self.drop_run(run_id)
            return
        for layer in layers:
            p, fs = self._fs(f"run_id={run_id}", f"layer={layer}")
            fs.delete(p, True)

    def drop_run(self, run_id: str) -> None:
        for parts in ((f"run_id={run_id}",), ("_runs", run_id)):
            p, fs = self._fs(*parts)
            fs.delete(p, True)


class HistogramStore:
    """A run's histograms, kept as a table: counted once, read by every metric.

    Each batch of states adds a table of counts under its own name; the histogram is their sum, so it
    grows with distinct states and batches, and compact() folds the batches into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/histograms"

    def add(self, counts: DataFrame, run_id: str, batch: str) -> None:
        """counts: (layer, state, count). Adding a batch again replaces it."""
        counts.select("layer", "state", "count").write.mode("overwrite").parquet(f"{self.path}/run_id={run_id}/batch={batch}")

    def _batches(self, run_id: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run_id={run_id}/batch=*")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or ())

    def read(self, run_id: str) -> DataFrame:
        """(layer, state, count) over all batches of a run; a run without any is an error."""
        at = self._batches(run_id)
        if not at:
            raise FileNotFoundError(f"run {run_id} has no histogram")
        return self.spark.read.parquet(*at).groupBy("layer", "state").agg(F.sum("count").alias("count"))

    def compact(self, run_id: str, name: str) -> None:
        """All batches as one of that name; its name must be new, and no batch may be added meanwhile."""
        old = self._batches(run_id)
        self.add(self.read(run_id), run_id, name)
        for at in old:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
