"""The engine's registered queries and the same in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pack import fires, pack_array, pack_native, pack_state, sort_key, unpack_state
from ..operators import capture, histogram, metrics, training
from ..sources.tables import table

#: Slices of the 64 embedding values that stand for layers: (start, neurons).
SLICES = {"l0": (0, 4), "l1": (4, 8), "l2": (12, 16)}
CATALOG = (("conv1", "Conv2d", 20, [1, 20, 24, 24]), ("conv2", "Conv2d", 50, [1, 50, 8, 8]), ("conv3", "Conv2d", 100, [1, 100, 1, 1]), ("fc1", "Linear", 10, [1, 10]), ("pool1", "MaxPool2d", 20, [1, 20, 12, 12]))


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _layers(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return capture.slice_layers(_emb(spark, d), SLICES, "embedding", keep)


def _hist(spark: SparkSession, d: str) -> DataFrame:
    return histogram.counts(_layers(spark, d))


def _catalog(spark: SparkSession, extra: tuple = ()) -> DataFrame:
    return spark.createDataFrame([*((k, n) for k, (_, n) in SLICES.items()), *extra], "layer string, n_neurons int")


def _models(spark: SparkSession) -> DataFrame:
    rows = [("m", name, kind, k, n, shape, 1, True) for k, (name, kind, n, shape) in enumerate(CATALOG)]
    return spark.createDataFrame(rows, "model_id string, layer string, layer_class string, ordinal int, n_neurons int, shape array<int>, channel_axis int, capture_on boolean")


def _r(c: str | Column) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _one(spark: SparkSession, d: str, n: int, name: str = "x") -> DataFrame:
    """States of the first n values."""
    return _emb(spark, d).select("vec_id", "label", F.lit(name).alias("layer"), pack_array(F.col("embedding"), n).alias("state"))


def quantize(spark, d):
    bits = F.array_join(F.transform("embedding", lambda x: F.when(fires(x), "1").otherwise("0")), "")
    return _emb(spark, d).select("vec_id", bits.alias("bits"))


def pack_bigint(spark, d):
    return _one(spark, d, 16).select("vec_id", "state")


def pack_binary_hex(spark, d):
    e = F.col("embedding")
    return _emb(spark, d).select("vec_id", F.hex(pack_native(e, 64)).alias("k64"), F.hex(pack_native(F.slice(e, 1, 12), 12)).alias("k12"))


def unpack_roundtrip(spark, d):
    e = _emb(spark, d)
    x = e.select("vec_id", pack_state(e, "embedding", 64, "binary").alias("k"))
    return x.select("vec_id", F.array_join(F.transform(unpack_state(F.col("k"), 64, True), lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"))


def _spatial(axis: int):
    return lambda spark, d: capture.capture_states(_emb(spark, d), 8, 8, axis, "embedding", ("vec_id",))


def state_count(spark, d):
    return histogram.state_count(_hist(spark, d)).select("layer", "state_count")


def histogram_8(spark, d):
    return histogram.counts(_one(spark, d, 8)).select("state", "count")


def state_ids_ordered(spark, d):
    return histogram.state_ids(histogram.counts(_one(spark, d, 12))).select("position", "state", "count")


def state_ids_wide(spark, d):
    e = _emb(spark, d)
    s = e.select(F.lit("x").alias("layer"), pack_state(e, "embedding", 64).alias("state"))
    x = histogram.state_ids(histogram.counts(s), binary=True)
    return x.select("position", F.hex("state").alias("state"), "count")


def bin_edges(spark, d):
    return histogram.bin_edges(histogram.counts(_one(spark, d, 12))).select("bin", "edge")


def sort_index(spark, d):
    return histogram.sort_index(_one(spark, d, 8), "vec_id").select("vec_id", "state", "sorted_at")


def distinct_states(spark, d):
    return histogram.state_count(_hist(spark, d)).select("layer", "n_states")


def states_per_instance(spark, d):
    return capture.states_per_instance(_models(spark)).select("layer", "states_per_instance")


def subset_counts_ids(spark, d):
    s = histogram.of_instances(_one(spark, d, 4), [0, 1, 2, 3, 5, 8, 13, 21, 34, 55], "vec_id")
    return histogram.counts(s).select("state", "count")


def subset_counts_mask(spark, d):
    mask = _emb(spark, d).where("label = 3").select("vec_id")
    return histogram.counts(histogram.of_mask(_one(spark, d, 4), mask, "vec_id")).select("state", "count")


def _entropy(alpha):
    return lambda spark, d: metrics.entropy(_hist(spark, d), (alpha,)).select("layer", _r("entropy").alias("entropy"))


def max_entropy(spark, d):
    return metrics.max_entropy(_catalog(spark))


def _efficiency(a1=1, a2=None):
    def q(spark, d):
        x = metrics.layer_efficiency(_hist(spark, d), _catalog(spark), a1, a2)
        return x.select("layer", "state_count", "n_states", _r("entropy").alias("entropy"), _r("efficiency").alias("efficiency"))

    return q


layer_efficiency = _efficiency()


def network_efficiency(spark, d):
    x = metrics.network_efficiency(metrics.layer_efficiency(_hist(spark, d), _catalog(spark)))
    return x.select(_r("network_efficiency").alias("network_efficiency"))


def network_efficiency_zero_layer(spark, d):
    dead = _emb(spark, d).select(F.lit("dead").alias("layer"), F.lit(0).cast("bigint").alias("state"))
    hist = histogram.counts(_layers(spark, d).unionByName(dead))
    x = metrics.network_efficiency(metrics.layer_efficiency(hist, _catalog(spark, (("dead", 4),))))
    return x.select(_r("network_efficiency").alias("network_efficiency"))


def empty_layer(spark, d):
    x = metrics.layer_efficiency(_hist(spark, d), _catalog(spark, (("silent", 8),)))
    return x.select("layer", "state_count", "n_states", _r("entropy").alias("entropy"), _r("efficiency").alias("efficiency"))


def aiq(spark, d):
    net = metrics.network_efficiency(metrics.layer_efficiency(_hist(spark, d), _catalog(spark)))
    acc = table(spark, d, "labels").agg(F.avg((F.col("quality") == 1).cast("double")).alias("accuracy"))
    both = net.withColumn("one", F.lit(1)).join(acc.withColumn("one", F.lit(1)), "one")
    return both.select(*[_r(metrics.aiq(F.col("network_efficiency"), F.col("accuracy"), w)).alias(f"aiq_{w}") for w in (1, 2)])


def sum_entropy(spark, d):
    return metrics.sum_entropy(metrics.entropy(_hist(spark, d))).select(_r("sum_entropy").alias("sum_entropy"))


def frequencies(spark, d):
    x = metrics.frequencies(histogram.counts(_one(spark, d, 4)))
    return x.select("state", _r("frequency").alias("frequency"))


def probe_points(spark, d):
    x = capture.build_probes(_models(spark), ["Conv2d", "fc1"], "conv2", "both")
    return x.select("layer", "probe")


def probe_points_fed(spark, d):
    edges = spark.createDataFrame([("conv1", "pool1"), ("pool1", "conv2"), ("conv2", "conv3"), ("conv3", "fc1")], "source string, target string")
    x = capture.build_probes(_models(spark), "Conv2d", None, "before", edges)
    return x.select("layer", "probe")


def per_class_histogram(spark, d):
    return histogram.per_class(_one(spark, d, 4)).select("label", "state", "count", "all_classes")


def per_class_efficiency(spark, d):
    s = _layers(spark, d, ("label",))
    x = metrics.layer_efficiency(histogram.counts(s, ("label", "layer")), _catalog(spark), by=("label", "layer"))
    return x.select("label", "layer", _r("entropy").alias("entropy"), _r("efficiency").alias("efficiency"))


def class_compare(spark, d):
    one = lambda c: histogram.counts(_one(spark, d, 8).where(F.col("label") == c))
    return histogram.compare(one(1), one(0)).select("state", "count_left", "count_right")


def weighted_mean(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderstatus").agg(training.weighted_mean(F.col("o_totalprice"), F.col("o_custkey")).alias("m"))
    return x.select("o_orderstatus", F.round("m", 3).alias("mean_price"))


def argmax_accuracy(spark, d):
    x = _emb(spark, d).select(training.argmax(F.slice("embedding", 1, 10)).alias("p"), "label")
    return x.agg(_r(training.accuracy(F.col("p"), F.col("label"))).alias("accuracy"))


def _epochs(spark, d):
    e = table(spark, d, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("epoch"))
    return e.agg(F.round(F.avg("value"), 6).alias("accuracy"), F.round(F.stddev_samp("value"), 6).alias("net_efficiency"))


def early_stop(spark, d):
    x = _epochs(spark, d)
    return training.early_stop(x, 3).select(F.lit(3).alias("patience"), "stop_epoch", "best_epoch")


def dual_stop(spark, d):
    return training.dual_stop(_epochs(spark, d), 4)


def epoch_series(spark, d):
    s = _layers(spark, d, ("vec_id",)).select(F.pmod("vec_id", F.lit(5)).cast("int").alias("epoch"), F.when(F.pmod("vec_id", F.lit(2)) == 0, "train").otherwise("test").alias("split"), "layer", "state")
    eff = metrics.layer_efficiency(histogram.counts(s, ("epoch", "split", "layer")), _catalog(spark), by=("epoch", "split", "layer"))
    return training.epoch_series(eff).select("epoch", "split", "layers", _r("network_efficiency").alias("network_efficiency"))


def run_isolation(spark, d):
    """Resetting starts a new run: each run's histogram holds its own states only."""
    s = _layers(spark, d, ("vec_id",)).withColumn("run_id", F.when(F.col("vec_id") % 2 == 0, "run-a").otherwise("run-b"))
    return histogram.state_count(histogram.counts(s, ("run_id", "layer")), ("run_id", "layer"))


def stream_histogram(spark, d):
    """The embeddings as a file stream, counted to the end; equal to the batch histogram."""
    from ..sources import HistogramStore
    from ..streaming import follow

    store = HistogramStore(spark, _work(spark))
    src = spark.readStream.schema(_emb(spark, d).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/embeddings.parquet*")
    follow(src.select(F.lit("x").alias("layer"), pack_array(F.col("embedding"), 8).alias("state")), store, "r", _work(spark)).awaitTermination()
    return store.read("r").select("state", "count")


def _work(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only a local session may do without spark.checkpoint.dir."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="statelens-")
    return f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}"


def store_batch_and_stream(spark, d):
    """Batch, stream and batch again into one store; a part of the rows each time, and all of them read back raw."""
    from ..sources import StateStore
    from ..streaming import to_store

    store, at = StateStore(spark, _work(spark)), _work(spark)
    states = lambda x: x.select("vec_id", F.col("vec_id").alias("instance_id"), F.lit("x").alias("layer"), pack_array(F.col("embedding"), 16).alias("state"))
    part = lambda x, k: states(x).where(F.pmod("vec_id", F.lit(3)) == k).drop("vec_id")
    src = spark.readStream.schema(_emb(spark, d).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/embeddings.parquet*")
    store.create(part(_emb(spark, d), 0), "r")
    to_store(part(src, 1), store, "r", at).awaitTermination()
    store.append(part(_emb(spark, d), 2), "r")
    return store.read("r").select("layer", "instance_id", "state")


def store_reset(spark, d):
    """A layer of a run is reset and written anew, another layer stays."""
    from ..sources import StateStore

    store, s = StateStore(spark, _work(spark)), _layers(spark, d, ("vec_id",)).withColumnRenamed("vec_id", "instance_id")
    store.create(s.where("layer <> 'l2'"), "r")
    store.reset("r", ["l0"])
    store.append(s.where("layer = 'l0' and instance_id % 2 = 0"), "r")
    return histogram.state_count(histogram.counts(store.read("r")))


def cached_histogram(spark, d):
    """Counted once into a table by halves, then read by two metrics."""
    from ..sources import HistogramStore

    store = HistogramStore(spark, _work(spark))
    s = _layers(spark, d, ("vec_id",))
    for k in (0, 1):
        store.add(histogram.counts(s.where(F.pmod("vec_id", F.lit(2)) == k)), "r", f"half-{k}")
    store.compact("r", "all")
    hist = store.read("r")
    return metrics.entropy(hist, (1, 2)).select("layer", "alpha", _r("entropy").alias("entropy"))


def capture_by_catalog(spark, d):
    """Only layers that the catalog captures."""
    on = spark.createDataFrame([("l0", True), ("l1", False), ("l2", True)], "layer string, capture_on boolean")
    return histogram.state_count(histogram.counts(capture.capture_enabled(_layers(spark, d), on)))


def raw_states(spark, d):
    """Every observation, unpacked from its key."""
    x = histogram.states_all(_one(spark, d, 16), 16)
    return x.select("vec_id", F.array_join(F.transform("neurons", lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"))


def unique_states(spark, d):
    """Every distinct state, unpacked, with its count."""
    x = histogram.states_unique(histogram.counts(_one(spark, d, 8)), 8)
    return x.select(F.array_join(F.transform("neurons", lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"), "count")


def _wide(spark, d, times: int) -> DataFrame:
    """Embeddings repeated, each time with its values moved by one place: times * 64 neurons."""
    e = F.col("embedding")
    parts = [F.concat(F.slice(e, k % 64 + 1, 64), F.slice(e, 1, k % 64)) for k in range(times)]
    return _emb(spark, d).select("vec_id", F.concat(*parts).alias("a"))


def wide_states_1024(spark, d):
    """1,024 neurons, packed in Arrow batches."""
    x = _wide(spark, d, 16)
    return x.select("vec_id", F.hex(pack_state(x, "a", 1024)).alias("state"))


def wide_roundtrip_1024(spark, d):
    x = _wide(spark, d, 16)
    k = x.select("vec_id", pack_state(x, "a", 1024).alias("k"))
    return k.select("vec_id", F.array_join(F.transform(unpack_state(F.col("k"), 1024, True), lambda b: F.when(b, "1").otherwise("0")), "").alias("bits"))


def spatial_states_wide(spark, d):
    """128 channels at 8 positions, channels first."""
    x = _wide(spark, d, 16)
    return capture.capture_states(x, 128, 8, 1, "a", ("vec_id",)).select("vec_id", "position", F.hex("state").alias("state"))


def wide_pack_efficiency(spark, d):
    e = _emb(spark, d)
    s = e.select(F.lit("wide").alias("layer"), pack_state(e, "embedding", 64).alias("state"))
    x = metrics.layer_efficiency(histogram.counts(s), spark.createDataFrame([("wide", 64)], "layer string, n_neurons int"))
    return x.select("layer", "state_count", "n_states", _r("entropy").alias("entropy"), _r("efficiency").alias("efficiency"))


def network_capture(spark, d):
    """A seeded two-layer network run in the workers; its states are packed where it ran."""
    w = np.sign(np.sin(np.arange(64 * 6)).reshape(64, 6))

    def rounded(x: np.ndarray, digits: int) -> np.ndarray:
        """Halves go away from zero, as in SQL; numpy's own rounding takes them to an even digit."""
        y = x * 10.0**digits
        whole = np.trunc(y)
        return (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 10.0**digits

    def forward(x: np.ndarray) -> dict[str, np.ndarray]:
        # added up from the first value to the last, as in SQL: what a sum of doubles is, and so which sums are halves, depends on the order
        h = rounded(sum(v[:, None] * to for v, to in zip(rounded(x.astype(np.float64), 3).T, w, strict=True)), 2)
        return {"hidden": h, "out": h[:, :3] - h[:, 3:]}

    x = capture.run_network(_emb(spark, d), forward, "embedding", "vec_id")
    return histogram.counts(x).select("layer", F.hex("state").alias("state"), "count")


def _lineitem_states(spark, d):
    cols = (("l_quantity", 25.0), ("l_discount", 0.05), ("l_tax", 0.04), ("l_extendedprice", 30000.0))
    from ..functions.pack import pack_bigint as pack

    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("layer"), pack([fires(F.col(c) - F.lit(m)) for c, m in cols]).alias("state"))


def bench_lineitem_states(spark, d):
    hist = histogram.counts(_lineitem_states(spark, d))
    x = hist.groupBy("layer").agg(F.sum("count").alias("state_count"), F.count("*").alias("n_states"), metrics.entropy_of(F.col("count")).alias("h1"), metrics.entropy_of(F.col("count"), 2).alias("h2"))
    return x.select("layer", "state_count", "n_states", _r("h1").alias("h1"), _r("h2").alias("h2"), _r(F.col("h1") / 4).alias("efficiency"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "quantize": quantize, "pack_bigint": pack_bigint, "pack_binary_hex": pack_binary_hex, "unpack_roundtrip": unpack_roundtrip,
        "spatial_states_nchw": _spatial(1), "spatial_states_nhwc": _spatial(-1), "state_count": state_count, "histogram": histogram_8,
        "state_ids_ordered": state_ids_ordered, "state_ids_wide": state_ids_wide, "bin_edges": bin_edges, "sort_index": sort_index,
        "distinct_states": distinct_states, "states_per_instance": states_per_instance, "subset_counts_ids": subset_counts_ids, "subset_counts_mask": subset_counts_mask,
        "entropy_shannon": _entropy(1), "entropy_alpha0": _entropy(0), "entropy_alpha_half": _entropy(0.5), "entropy_alpha2": _entropy(2),
        "max_entropy": max_entropy, "layer_efficiency": layer_efficiency, "layer_efficiency_2_0": _efficiency(2, 0), "network_efficiency": network_efficiency,
        "network_efficiency_zero_layer": network_efficiency_zero_layer, "empty_layer": empty_layer, "aiq": aiq, "sum_entropy": sum_entropy, "frequencies": frequencies,
        "probe_points": probe_points, "probe_points_fed": probe_points_fed, "per_class_histogram": per_class_histogram, "per_class_efficiency": per_class_efficiency,
        "class_compare": class_compare, "weighted_mean": weighted_mean, "argmax_accuracy": argmax_accuracy, "early_stop": early_stop, "dual_stop": dual_stop,
        "epoch_series": epoch_series, "run_isolation": run_isolation, "stream_histogram": stream_histogram, "wide_pack_efficiency": wide_pack_efficiency,
        "network_capture": network_capture, "bench_lineitem_states": bench_lineitem_states, "store_batch_and_stream": store_batch_and_stream, "store_reset": store_reset,
        "cached_histogram": cached_histogram, "capture_by_catalog": capture_by_catalog, "raw_states": raw_states, "unique_states": unique_states,
        "wide_states_1024": wide_states_1024, "wide_roundtrip_1024": wide_roundtrip_1024, "spatial_states_wide": spatial_states_wide,
    }


def oracle_sql() -> dict[str, str]:
    on = lambda x: f"({x} > 0 and not isnan({x}))"
    key = lambda lo, n: f"cast(list_sum([case when {on(f'embedding[{lo} + i + 1]')} then 1::bigint << i else 0 end for i in range(0, {n})]) as bigint)"
    hexed = lambda n: f"array_to_string([printf('%02X', cast(list_sum([case when b * 8 + j < {n} and {on('embedding[b * 8 + j + 1]')} then 1 << j else 0 end for j in range(0, 8)]) as int)) for b in range(0, {(n + 7) // 8})], '')"
    st = "st as (" + " union all ".join(f"select vec_id, label, '{k}' as layer, {n} as n, {key(lo, n)} as state from embeddings" for k, (lo, n) in SLICES.items()) + ")"
    h = f"{st}, h as (select layer, max(n) as n, state, count(*) as c from st group by layer, state)"
    shannon = "round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0::double"
    renyi = lambda a: f"round((log2(sum(pow(c, {a}))) - {a} * log2(sum(c))) / (1 - {a}), 6) + 0.0::double"
    one = lambda n: f"s as (select vec_id, label, {key(0, n)} as state from embeddings)"
    eff = f"{h}, e as (select layer, max(n) as n, sum(c)::bigint as state_count, count(*) as n_states, log2(sum(c)) - sum(c * log2(c)) / sum(c) as entropy from h group by layer)"
    epochs = "a as (select datediff('day', date '2024-01-01', ts::date)::int as e, round(avg(value), 6) as up, -round(stddev_samp(value), 6) as down from events group by 1)"

    def stop(v: str, first: str, p: int, tag: str) -> str:
        return f"""b{tag} as (select e, {v} as v, greatest(coalesce(max({v}) over (order by e rows between unbounded preceding and 1 preceding), {first}), {first}) as best from a),
g{tag} as (select e, sum(case when v > best then 1 else 0 end) over (order by e rows unbounded preceding) as g from b{tag}),
c{tag} as (select e, g, row_number() over (partition by g order by e) - case when g = 0 then 0 else 1 end as streak, case when g > 0 then min(e) over (partition by g) end as best_epoch from g{tag}),
z{tag} as (select min(case when streak >= {p} then e end) as stop_epoch, case when min(case when streak >= {p} then e end) is null then max(best_epoch) else arg_min(best_epoch, case when streak >= {p} then e end) end as best_epoch from c{tag})"""

    models = "m(layer, class, n, shape) as (values " + ", ".join(f"('{a}', '{b}', {n}, {s})" for a, b, n, s in CATALOG) + ")"
    w = np.sign(np.sin(np.arange(64 * 6)).reshape(64, 6)).astype(int)
    hidden = ", ".join("round(" + " + ".join(f"({w[i, j]}) * round(embedding[{i + 1}]::double, 3)" for i in range(64)) + f", 2) as h{j}" for j in range(6))
    out = {
        "quantize": f"select vec_id, array_to_string([case when {on('x')} then '1' else '0' end for x in embedding], '') as bits from embeddings",
        "pack_bigint": f"select vec_id, {key(0, 16)} as state from embeddings",
        "pack_binary_hex": f"select vec_id, {hexed(64)} as k64, {hexed(12)} as k12 from embeddings",
        "state_count": f"with {st} select layer, count(*) as state_count from st group by layer",
        "histogram": f"with {one(8)} select state, count(*) as count from s group by state",
        "state_ids_ordered": f"with {one(12)} select row_number() over (order by state) - 1 as position, state, count(*) as count from s group by state",
        "state_ids_wide": f"with s as (select {hexed(64)} as state from embeddings), r as (select state, count(*) as count, array_to_string(list_reverse(regexp_extract_all(state, '..')), '') as k from s group by state) select row_number() over (order by k) - 1 as position, state, count from r",
        "bin_edges": f"with {one(12)}, h as (select state, count(*) as c from s group by state) select 0::bigint as bin, 0::bigint as edge union all select row_number() over (order by state), (sum(c) over (order by state))::bigint from h",
        "sort_index": f"with {one(8)} select vec_id, state, row_number() over (order by state, vec_id) - 1 as sorted_at from s",
        "distinct_states": f"with {st} select layer, count(distinct state) as n_states from st group by layer",
        "states_per_instance": f"with {models} select layer, (list_product(shape[2:]) / n)::bigint as states_per_instance from m",
        "subset_counts_ids": f"with {one(4)} select state, count(*) as count from s where vec_id in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55) group by state",
        "subset_counts_mask": f"with {one(4)} select state, count(*) as count from s where label = 3 group by state",
        "entropy_shannon": f"with {h} select layer, {shannon} as entropy from h group by layer",
        "max_entropy": "select layer, n::double as max_entropy from (values " + ", ".join(f"('{k}', {n})" for k, (_, n) in SLICES.items()) + ") l(layer, n)",
        "layer_efficiency": f"with {eff} select layer, state_count, n_states, round(entropy, 6) as entropy, round(entropy / n, 6) as efficiency from e",
        "layer_efficiency_2_0": f"with {h}, e as (select layer, sum(c)::bigint as state_count, count(*) as n_states, (log2(sum(pow(c, 2))) - 2 * log2(sum(c))) / (1 - 2) as entropy, log2(count(*)) as top from h group by layer) select layer, state_count, n_states, round(entropy, 6) as entropy, round(entropy / top, 6) as efficiency from e",
        "network_efficiency": f"with {eff} select round(exp(avg(ln(entropy / n))), 6) as network_efficiency from e",
        "network_efficiency_zero_layer": f"with {eff}, x as (select entropy / n as f from e union all select 0.0) select case when min(f) = 0 then 0.0::double else exp(avg(ln(f))) end as network_efficiency from x",
        "empty_layer": f"with {eff} select layer, state_count, n_states, round(entropy, 6) as entropy, round(entropy / n, 6) as efficiency from e union all select 'silent', 0::bigint, 0::bigint, 0.0::double, 0.0::double",
        "aiq": f"with {eff}, x as (select exp(avg(ln(entropy / n))) as f from e), y as (select avg((quality = 1)::int::double) as acc from labels) select round(pow(pow(acc, 1) * f, 1.0::double / 2), 6) as aiq_1, round(pow(pow(acc, 2) * f, 1.0::double / 3), 6) as aiq_2 from x cross join y",
        "sum_entropy": f"with {eff} select round(sum(entropy), 6) as sum_entropy from e",
        "frequencies": f"with {one(4)} select state, round(count(*)::double / (select count(*) from s), 6) as frequency from s group by state",
        "probe_points": f"with {models} select layer, layer || p as probe from m cross join (values ('_pre_states'), ('_post_states')) v(p) where class = 'Conv2d' and layer <> 'conv2' or layer = 'fc1'",
        "probe_points_fed": f"with {models}, f(source, target) as (values ('conv1', 'pool1'), ('pool1', 'conv2'), ('conv2', 'conv3'), ('conv3', 'fc1')) select layer, coalesce(source, layer) || '_pre_states' as probe from m left join f on target = layer where class = 'Conv2d'",
        "per_class_histogram": f"with {one(4)} select label, state, count(*) as count, grouping(label) = 1 as all_classes from s group by grouping sets ((label, state), (state))",
        "per_class_efficiency": f"with {st}, h as (select label, layer, max(n) as n, state, count(*) as c from st group by label, layer, state) select label, layer, {shannon} as entropy, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / max(n), 6) + 0.0::double as efficiency from h group by label, layer",
        "class_compare": f"with {one(8)}, x as (select state, count_if(label = 1)::bigint as count_left, count_if(label = 0)::bigint as count_right from s where label in (0, 1) group by state) select * from x",
        "weighted_mean": "select o_orderstatus, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 3) as mean_price from orders group by o_orderstatus",
        "argmax_accuracy": "select round(avg((list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = label)::int::double), 6) as accuracy from embeddings",
        "early_stop": f"with {epochs}, {stop('up', '0.0', 3, '1')} select 3 as patience, stop_epoch, best_epoch from z1",
        "dual_stop": f"with {epochs}, {stop('up', '0.0', 4, '1')}, {stop('down', chr(39) + '-inf' + chr(39) + '::double', 4, '2')} select z1.stop_epoch as stop_up, z1.best_epoch as best_up, z2.stop_epoch as stop_down, z2.best_epoch as best_down from z1 cross join z2",
        "epoch_series": f"with {st}, h as (select (vec_id % 5)::int as epoch, case when vec_id % 2 = 0 then 'train' else 'test' end as split, layer, max(n) as n, state, count(*) as c from st group by 1, 2, 3, state), e as (select epoch, split, layer, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / max(n) as f from h group by 1, 2, 3) select epoch, split, count(*) as layers, round(case when min(f) = 0 then 0 else exp(avg(ln(f))) end, 6) as network_efficiency from e group by 1, 2",
        "run_isolation": f"with {st} select case when vec_id % 2 = 0 then 'run-a' else 'run-b' end as run_id, layer, count(*) as state_count, count(distinct state) as n_states from st group by 1, 2",
        "wide_pack_efficiency": f"with h as (select {hexed(64)} as state, count(*) as c from embeddings group by 1) select 'wide' as layer, sum(c)::bigint as state_count, count(*) as n_states, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) as entropy, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 64, 6) as efficiency from h",
        "network_capture": f"with n as (select {hidden} from embeddings), s as (select 'hidden' as layer, " + " + ".join(f"(h{j} > 0)::int * {1 << j}" for j in range(6)) + " as k from n union all select 'out', " + " + ".join(f"(h{j} > h{j + 3})::int * {1 << j}" for j in range(3)) + " from n) select layer, printf('%02X', k) as state, count(*) as count from s group by layer, k",
        "bench_lineitem_states": "with s as (select l_returnflag as layer, (l_quantity - 25.0 > 0)::int + 2 * (l_discount - 0.05::double > 0)::int + 4 * (l_tax - 0.04::double > 0)::int + 8 * (l_extendedprice - 30000.0 > 0)::int as k from lineitem), h as (select layer, k, count(*) as c from s group by layer, k) select layer, sum(c)::bigint as state_count, count(*) as n_states, " + f"{shannon} as h1, {renyi(2)} as h2, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 4, 6) + 0.0::double as efficiency from h group by layer",
    }
    wide = "w as (select vec_id, flatten([list_concat(embedding[k % 64 + 1:], embedding[1:k % 64]) for k in range(0, 16)]) as a from embeddings)"
    bits = lambda at, n: f"array_to_string([printf('%02X', cast(list_sum([case when {on(f'a[{at}]')} then 1 << j else 0 end for j in range(0, 8)]) as int)) for b in range(0, {n // 8})], '')"
    out |= {
        "store_batch_and_stream": f"select 'x' as layer, vec_id as instance_id, {key(0, 16)} as state from embeddings",
        "store_reset": f"with {st} select layer, count(*) as state_count, count(distinct state) as n_states from st where layer = 'l1' or layer = 'l0' and vec_id % 2 = 0 group by layer",
        "cached_histogram": f"with {h} select layer, 1.0::double as alpha, {shannon} as entropy from h group by layer union all select layer, 2.0::double, {renyi(2)} from h group by layer",
        "capture_by_catalog": f"with {st} select layer, count(*) as state_count, count(distinct state) as n_states from st where layer <> 'l1' group by layer",
        "raw_states": f"select vec_id, array_to_string([case when {on('x')} then '1' else '0' end for x in embedding[1:16]], '') as bits from embeddings",
        "unique_states": f"select array_to_string([case when {on('x')} then '1' else '0' end for x in embedding[1:8]], '') as bits, count(*) as count from embeddings group by 1",
        "wide_states_1024": f"with {wide} select vec_id, {bits('b * 8 + j + 1', 1024)} as state from w",
        "wide_roundtrip_1024": f"with {wide} select vec_id, array_to_string([case when {on('x')} then '1' else '0' end for x in a], '') as bits from w",
        "spatial_states_wide": f"with {wide} select vec_id, p::int as position, {bits('(b * 8 + j) * 8 + p + 1', 128)} as state from w, (select unnest(range(0, 8)) as p) x",
    }
    out["unpack_roundtrip"], out["stream_histogram"] = out["quantize"], out["histogram"]
    for name, a in (("entropy_alpha0", "0"), ("entropy_alpha_half", "0.5::double"), ("entropy_alpha2", "2")):
        out[name] = f"with {h} select layer, {renyi(a)} as entropy from h group by layer"
    for name, at in (("nchw", "c * 8 + p"), ("nhwc", "p * 8 + c")):
        out[f"spatial_states_{name}"] = f"select vec_id, p::int as position, cast(list_sum([case when {on(f'embedding[{at} + 1]')} then 1::bigint << c else 0 end for c in range(0, 8)]) as bigint) as state from embeddings, (select unnest(range(0, 8)) as p) x"
    return out
