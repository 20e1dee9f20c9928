"""The state of a stream is its histogram: it grows with the distinct states, not with the rows.

Entropy doesn't add up over batches, but counts do: each micro-batch's counts are a table of the
run's histogram, written under the batch's number, so a batch that is done again is kept once.
Nothing of it is in the driver or in a state store. There is no event time here; a run (an
epoch, a phase) is a key of the groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.histogram import counts
from ..operators.metrics import layer_efficiency
from ..sources.store import HistogramStore, StateStore


def stream_histogram(states: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """The same hash aggregation as in batch, over a streaming DataFrame of states."""
    return counts(states, by)


def _each(states: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return states.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(states: DataFrame, store: HistogramStore, run_id: str, checkpoint: str) -> StreamingQuery:
    """A query that adds all available input (layer, state) to the run's histogram."""
    return _each(states, lambda rows, batch: store.add(counts(rows), run_id, f"stream-{batch}"), checkpoint)


def stream_metrics(states: DataFrame, layers: DataFrame, store: HistogramStore, run_id: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """follow(); at each trigger sink gets every layer's efficiency over all states so far, and the batch's number."""

    def each(rows: DataFrame, batch: int) -> None:
        store.add(counts(rows), run_id, f"stream-{batch}")
        sink(layer_efficiency(store.read(run_id), layers), batch)

    return _each(states, each, checkpoint)


def to_store(states: DataFrame, store: StateStore, run_id: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append a stream of states to a store that batches, and streams of other names, may share: a micro-batch is a batch of the
    store under its number, so each is kept exactly once."""
    return _each(states, lambda rows, batch: store.append(rows, run_id, f"{name}-{batch}"), checkpoint)
