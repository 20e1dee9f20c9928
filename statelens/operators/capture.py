"""From activations to states, and where in a network states are captured."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pack import BIGINT_NEURONS, activations, fires, pack_bigint, pack_state, pack_tensors, packed_array, rows_of
from ..plans.schemas import LAYERS

#: Where a probe sits, by method, and what its name ends with.
POINTS = {"before": ("_pre_states",), "after": ("_post_states",), "both": ("_pre_states", "_post_states")}


def capture_states(df: DataFrame, n_neurons: int, positions: int = 1, channel_axis: int = -1, column: str = "activations", keep: tuple[str, ...] = (), capture_on: bool = True, kind: str = "auto") -> DataFrame:
    """(keep..., position, state): a state for each row and spatial position.

    A row's array is a tensor of n_neurons channels by `positions` places, flattened channels
    first (channel_axis 1) or last (-1). The pack is part of the scan's projection: floats never
    reach an exchange. With capture_on false nothing is recorded. A null array gives null states.
    """
    if channel_axis not in (1, -1):
        raise ValueError("channel_axis is 1 or -1")
    if not capture_on:
        df = df.where(F.lit(False))
    if positions == 1:
        return df.select(*keep, F.lit(0).alias("position"), pack_state(df, column, n_neurons, kind).alias("state"))
    a, boolean = activations(df, column)
    width = n_neurons * positions
    kind = ("bigint" if n_neurons <= BIGINT_NEURONS else "arrow") if kind == "auto" else kind
    rows = df.select(*keep, a.alias("__a"), F.explode(F.sequence(F.lit(0), F.lit(positions - 1))).alias("position"))
    at = (lambda c: F.lit(c * positions) + F.col("position")) if channel_axis == 1 else (lambda c: F.col("position") * n_neurons + c)
    ok = F.when(F.col("__a").isNotNull() & (F.size("__a") != width), F.raise_error(F.lit(f"expected {width} values"))).otherwise(F.col("__a").isNotNull())
    if kind == "bigint":
        state = F.when(ok.cast("boolean"), pack_bigint([fires(F.get("__a", at(c)), boolean) for c in range(n_neurons)]))
        return rows.select(*keep, "position", state.alias("state"))
    if kind == "binary":
        part = F.when(ok.cast("boolean"), F.transform(F.sequence(F.lit(0), F.lit(n_neurons - 1)), lambda c: F.get("__a", c * positions + F.col("position") if channel_axis == 1 else F.col("position") * n_neurons + c)))
        rows = rows.select(*keep, "position", part.alias("__a"))
        return rows.select(*keep, "position", pack_state(rows, "__a", n_neurons, kind).alias("state"))
    # wide: a batch of tensors is turned and packed at once, and the keys are exploded, not the tensors
    keys = pack_tensors(n_neurons, positions, channel_axis)(a.cast("array<float>") if boolean else a)
    none = F.array(*[F.lit(None).cast("binary")] * positions)
    return df.select(*keep, F.posexplode(F.coalesce(keys, none)).alias("position", "state"))


def capture_enabled(activations: DataFrame, layers: DataFrame) -> DataFrame:
    """Rows of activations (layer, ...) whose layer's capture_on is true in the catalog; a layer that it lacks is not captured."""
    on = layers.where("capture_on").select("layer").distinct()
    return activations.join(on, "layer", "left_semi").select(*activations.columns)


def register_model(rows: list[tuple[str, str, int, list[int]]], model_id: str, spark: SparkSession, channel_axis: int = 1, capture_on: bool = True) -> DataFrame:
    """The catalog of a model: (layer, class, neurons, shape) in order. A layer named twice, or of no neurons, is a ValueError."""
    names = [r[0] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a layer's name stands for one layer")
    if any(r[2] < 1 for r in rows):
        raise ValueError("a layer has one neuron at least")
    return spark.createDataFrame([(model_id, name, kind, k, n, list(shape), channel_axis, capture_on) for k, (name, kind, n, shape) in enumerate(rows)], LAYERS)


def slice_layers(df: DataFrame, layers: dict[str, tuple[int, int]], column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., layer, state): slices (start, neurons) of one array as layers, all in one pass over the rows."""
    a, boolean = activations(df, column)
    packs = [F.struct(F.lit(name).alias("layer"), F.when(a.isNotNull(), pack_bigint([fires(F.get(a, F.lit(lo + i)), boolean) for i in range(n)])).alias("state")) for name, (lo, n) in layers.items()]
    return df.select(*keep, F.explode(F.array(*packs)).alias("__x")).select(*keep, "__x.layer", "__x.state")


def run_network(df: DataFrame, forward: Callable[[np.ndarray], dict[str, np.ndarray]], column: str, id_column: str, positions: dict[str, int] | None = None) -> DataFrame:
    """(instance_id, layer, position, state BINARY) of a network run over df.

    forward gets a batch of rows as a matrix and returns each layer's activations, channels last
    (rows, ..., neurons). States are packed in the worker that ran the network. A row of a null array has
    no activations and is left out; a null value in an array is NaN to the network; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows:
                continue
            for layer, out in forward(rows_of(b.column(1))).items():
                n = out.shape[-1]
                places = out.reshape(b.num_rows, -1, n).shape[1]
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), places)))
                at = pa.array(np.tile(np.arange(places, dtype=np.int32), b.num_rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array([layer] * len(ids), pa.string()), at, packed_array(out.reshape(-1, n) > 0)], names=["instance_id", "layer", "position", "state"])

    return df.select(F.col(id_column).cast("bigint"), F.col(column).cast("array<float>")).mapInArrow(run, "instance_id bigint, layer string, position int, state binary")


def _listed(x: str | list[str] | tuple[str, ...] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def selected(attach_to: str | list[str], exclude: str | list[str] | None = None) -> Column:
    """Layers that attach_to names or whose class it names, but for names in exclude."""
    to, out = _listed(attach_to), _listed(exclude)
    return (F.col("layer").isin(to) | F.col("layer_class").isin(to)) & ~F.col("layer").isin(out)


def build_probes(layers: DataFrame, attach_to: str | list[str], exclude: str | list[str] | None = None, method: str = "after", edges: DataFrame | None = None) -> DataFrame:
    """The capture points of a model: the selected catalog rows with probe (its name) and point.

    method: before, after or both. With edges (source, target) a point before a layer is named
    after each of the layers that feed it. An unknown method is a ValueError.
    """
    if method not in POINTS:
        raise ValueError(f"method is one of {sorted(POINTS)}, not {method!r}")
    chosen = layers.where(selected(attach_to, exclude)).dropDuplicates(["model_id", "layer"])
    points = chosen.withColumn("point", F.explode(F.array(*[F.lit(p) for p in POINTS[method]])))
    if edges is None:
        return points.withColumn("probe", F.concat("layer", "point"))
    fed = edges.select(F.col("target").alias("layer"), "source").distinct()
    before = points.where(F.col("point") == "_pre_states").join(fed, "layer", "left").withColumn("probe", F.concat(F.coalesce("source", "layer"), "point")).drop("source")
    return points.where(F.col("point") != "_pre_states").withColumn("probe", F.concat("layer", "point")).unionByName(before)


def remove_probes(probes: DataFrame, names: str | list[str] | None = None) -> DataFrame:
    """probes without those named; without names, none."""
    return probes.where(F.lit(False)) if names is None else probes.where(~F.col("probe").isin(_listed(names)))


def states_per_instance(layers: DataFrame) -> DataFrame:
    """The catalog with the states that one instance gives: all values but the batch axis, over the neurons."""
    size = F.aggregate(F.slice("shape", F.lit(2), F.size("shape")), F.lit(1).cast("bigint"), lambda a, x: a * x)
    return layers.withColumn("states_per_instance", F.floor(size / F.col("n_neurons")).cast("bigint"))
