from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from statelens.functions import pack
from statelens.operators import capture, histogram, metrics, training
from statelens.sources import HistogramStore, StateStore


def arrays(spark, x, kind="float"):
    rows = [(i, None if v is None else [bool(a) if kind == "boolean" else None if a is None else float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"id long, a array<{kind}>")


@pytest.mark.parametrize("n", [1, 5, 7, 8, 9, 12, 63, 64, 65, 1024])
def test_pack_and_unpack_equal_numpy(spark, n):
    x = np.random.default_rng(n).random((40, n)).astype(np.float32) - 0.5
    df = arrays(spark, x)
    want = [r.tobytes() for r in np.packbits(x > 0, axis=1, bitorder="little")]
    for kind in (["bigint"] if n <= 63 else []) + ["binary", "arrow"]:
        if kind == "binary" and n > 100:
            continue
        got = df.select("id", pack.pack_state(df, "a", n, kind).alias("k")).orderBy("id")
        keys = [r["k"] for r in got.collect()]
        if kind == "bigint":
            assert keys == [int.from_bytes(w, "little") for w in want]
        else:
            assert [bytes(k) for k in keys] == want
        back = got.select(pack.unpack_state(F.col("k"), n, kind != "bigint").alias("b"))
        assert [r["b"] for r in back.collect()] == (x > 0).tolist()


def test_firing_edges(spark):
    df = arrays(spark, [[0.0, -0.0, float("nan"), 1.0], [1e-60, None, -1.0, float("inf")], None])
    for kind in ("bigint", "binary", "arrow"):
        got = [r[0] for r in df.select(pack.pack_state(df, "a", 4, kind)).collect()]
        assert [g if g is None or kind == "bigint" else g[0] for g in got] == [8, 8, None]
    b = arrays(spark, [[0, 1, 1, 1, 1]], "boolean")
    assert b.select(pack.pack_state(b, "a", 5)).first()[0] == 0x1E


def test_wrong_width_and_type(spark):
    df = arrays(spark, [[1.0, 2.0]])
    for kind in ("bigint", "binary", "arrow"):
        with pytest.raises(PySparkException):
            df.select(pack.pack_state(df, "a", 3, kind)).collect()
    with pytest.raises(TypeError):
        pack.pack_state(spark.createDataFrame([(["x"],)], "a array<string>"), "a", 1)


def test_state_order(spark):
    keys = [bytes.fromhex(k) for k in ("0001", "ff00", "0100")]
    df = spark.createDataFrame([(k,) for k in keys], "state binary").withColumn("layer", F.lit("x")).withColumn("count", F.lit(1))
    got = histogram.state_ids(df, binary=True).orderBy("position").collect()
    assert [bytes(r["state"]).hex() for r in got] == ["0100", "ff00", "0001"]


@pytest.mark.parametrize("axis", [1, -1])
@pytest.mark.parametrize("n", [3, 70])
def test_spatial_states(spark, axis, n):
    x = np.random.default_rng(n).standard_normal((5, n, 4)).astype(np.float32)
    flat = (x if axis == 1 else x.transpose(0, 2, 1)).reshape(5, -1)
    got = capture.capture_states(arrays(spark, flat), n, 4, axis, "a", ("id",)).collect()
    want = {(i, p): np.packbits(x[i, :, p] > 0, bitorder="little").tobytes() for i in range(5) for p in range(4)}
    assert {(r["id"], r["position"]): (r["state"].to_bytes(1, "little") if n == 3 else bytes(r["state"])) for r in got} == want
    assert capture.capture_states(arrays(spark, flat), n, 4, axis, "a", capture_on=False).count() == 0


def numpy_entropy(c, a):
    p = np.array(c, float) / sum(c)
    return -(p * np.log2(p)).sum() if a == 1 else np.log2((p**a).sum()) / (1 - a)


def hist_of(spark, **layers):
    return spark.createDataFrame([(k, i, int(c)) for k, v in layers.items() for i, c in enumerate(v)], "layer string, state long, count long")


@pytest.mark.parametrize("alpha", [0, 0.5, 1, 2, 3])
def test_entropy(spark, alpha):
    h = hist_of(spark, a=[1, 2, 3, 100], u=[7] * 16, s=[500])
    got = {r["layer"]: r["entropy"] for r in metrics.entropy(h, (alpha,)).collect()}
    assert got["a"] == pytest.approx(numpy_entropy([1, 2, 3, 100], alpha)) and got["u"] == pytest.approx(4)
    assert got["s"] == 0 and math.copysign(1, got["s"]) == 1
    assert metrics.entropy(h, (float("inf"),)).where("layer = 'a'").first()["entropy"] == pytest.approx(math.log2(106 / 100))


def test_efficiency_rules(spark):
    h = hist_of(spark, a=[1, 1], s=[9])
    cat = spark.createDataFrame([("a", 4), ("s", 4), ("silent", 2)], "layer string, n_neurons int")
    e = metrics.layer_efficiency(h, cat)
    assert {r["layer"]: (r["state_count"], r["entropy"], r["efficiency"]) for r in e.collect()} == {"a": (2, 1.0, 0.25), "s": (9, 0.0, 0.0), "silent": (0, 0.0, 0.0)}
    assert metrics.network_efficiency(e).first()[0] == 0 and metrics.network_efficiency(e.where("layer = 'a'")).first()[0] == pytest.approx(0.25)
    assert metrics.network_efficiency(e.limit(0)).first()[0] is None
    assert math.isnan({r["layer"]: r["efficiency"] for r in metrics.layer_efficiency(h, cat, 1, 0).collect()}["s"])
    for a1, a2 in (("1", None), (1, 1), (None, 0), (True, None), (1, "0")):
        with pytest.raises(AssertionError):
            metrics.check_alphas(a1, a2)
    assert metrics.network_efficiency_of([0.25, 1.0]) == pytest.approx(0.5) and metrics.network_efficiency_of([0.0, 1.0]) == 0
    with pytest.warns(UserWarning):
        assert metrics.network_efficiency_of([]) is None
    with pytest.raises(AssertionError):
        metrics.network_efficiency_of((1.0,))


def test_empty_layers_of_every_class(spark):
    h = spark.createDataFrame([(1, "a", 0, 2), (1, "a", 1, 2), (None, "b", 0, 3)], "label int, layer string, state long, count long")
    cat = spark.createDataFrame([("a", 4), ("b", 2), ("silent", 2)], "layer string, n_neurons int")
    got = {(r["label"], r["layer"]): (r["state_count"], r["entropy"], r["efficiency"]) for r in metrics.layer_efficiency(h, cat, by=("label", "layer")).collect()}
    assert got == {(1, "a"): (4, 1.0, 0.25), (1, "b"): (0, 0.0, 0.0), (1, "silent"): (0, 0.0, 0.0), (None, "a"): (0, 0.0, 0.0), (None, "b"): (3, 0.0, 0.0), (None, "silent"): (0, 0.0, 0.0)}


def test_a_network_run_leaves_null_rows_out(spark):
    df = arrays(spark, [[1.0, -1.0], None, [None, 2.0]]).union(spark.createDataFrame([(None, [1.0, 1.0])], "id long, a array<float>"))
    got = capture.run_network(df, lambda x: {"l": x, "two": np.stack([x, -x], axis=1)}, "a", "id").collect()
    assert sorted((r["instance_id"] or 9, r["layer"], r["position"], bytes(r["state"])[0]) for r in got) == [(2, "l", 0, 2), (2, "two", 0, 2), (2, "two", 1, 0), (9, "l", 0, 1), (9, "l", 0, 3), (9, "two", 0, 1), (9, "two", 0, 3), (9, "two", 1, 0), (9, "two", 1, 2)]
    assert capture.run_network(df.limit(0), lambda x: {"l": x}, "a", "id").collect() == []


def test_places_need_no_window_over_a_layer(spark):
    from pyspark.sql.window import Window  # noqa: F401

    rnd = random.Random(4)
    rows = [(k, rnd.choice(["x", "y", None]), bytes([rnd.randrange(256), rnd.randrange(3)])) for k in range(500)]
    s = spark.createDataFrame(rows, "instance_id long, layer string, state binary")
    got = {r["instance_id"]: r["sorted_at"] for r in histogram.sort_index(s, "instance_id", binary=True).collect()}
    for layer in ("x", "y", None):
        own = sorted((r for r in rows if r[1] == layer), key=lambda r: (r[2][::-1], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))
    plan = histogram.state_ids(histogram.counts(s), binary=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "[layer#" in plan and all("__part" in line for line in plan.splitlines() if "Window" in line)


def test_sort_index_of_more_rows_than_a_sample_holds(spark):
    s = spark.range(0, 30000, 1, 4).select(F.col("id").alias("instance_id"), F.lit("x").alias("layer"), (F.col("id") * 7919 % 256).alias("state"))
    got = histogram.sort_index(s, "instance_id").orderBy("sorted_at").collect()
    assert [r["sorted_at"] for r in got] == list(range(30000))
    assert [r["instance_id"] for r in got] == sorted(range(30000), key=lambda i: (i * 7919 % 256, i))


def test_sort_index_of_null_ids(spark):
    s = spark.createDataFrame([(None, "x", 1), (5, "x", 1), (2, "x", 1), (7, "x", 0), (None, "x", 0)], "instance_id long, layer string, state long")
    got = histogram.sort_index(s, "instance_id").orderBy("sorted_at").collect()
    assert [(r["state"], r["instance_id"]) for r in got] == [(0, 7), (0, None), (1, 2), (1, 5), (1, None)]


def test_wide_states_ids_of_more_states_than_a_sample_holds(spark):
    s = spark.range(0, 30000, 1, 4).select(F.lit("x").alias("layer"), F.unhex(F.substring(F.sha2((F.col("id") % 20000).cast("string"), 256), 1, 20)).alias("state"))
    got = histogram.state_ids(histogram.counts(s), binary=True).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(20000)) and sum(r["count"] for r in got) == 30000
    keys = [bytes(r["state"])[::-1] for r in got]
    assert keys == sorted(keys)


def test_catalog(spark):
    cat = capture.register_model([("c", "Conv2d", 4, [1, 4, 2, 2]), ("f", "Linear", 2, [1, 2])], "m", spark)
    assert [(r["layer"], r["ordinal"], r["capture_on"]) for r in cat.orderBy("ordinal").collect()] == [("c", 0, True), ("f", 1, True)]
    off = cat.withColumn("capture_on", F.col("layer") == "f")
    x = spark.createDataFrame([(1, "c"), (2, "f"), (3, "other"), (4, None)], "instance_id long, layer string")
    assert [r["instance_id"] for r in capture.capture_enabled(x, off).collect()] == [2]
    for bad in ([("c", "C", 1, [1]), ("c", "C", 1, [1])], [("c", "C", 0, [1])]):
        with pytest.raises(ValueError):
            capture.register_model(bad, "m", spark)


def test_aiq(spark):
    assert spark.range(1).select(metrics.aiq(F.lit(0.25), F.lit(1.0))).first()[0] == 0.5
    for w in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            metrics.aiq(F.lit(1.0), F.lit(1.0), w)


def test_histogram_parts(spark):
    rnd = random.Random(1)
    rows = [(i, "x", rnd.randrange(6), i % 3) for i in range(300)] + [(300, "x", None, 0)]
    s = spark.createDataFrame(rows, "instance_id long, layer string, state long, label int").repartition(3)
    want = np.bincount([r[2] for r in rows[:-1]])
    assert {r["state"]: r["count"] for r in histogram.counts(s).collect()} == dict(enumerate(want.tolist()))
    at = {r["instance_id"]: r["sorted_at"] for r in histogram.sort_index(s, "instance_id").collect()}
    assert [i for i, _ in sorted(at.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows[:-1], key=lambda r: (r[2], r[0]))] and sorted(at.values()) == list(range(300))
    assert [r["edge"] for r in histogram.bin_edges(histogram.counts(s)).orderBy("bin").collect()] == [0, *np.cumsum(want).tolist()]
    some = histogram.of_instances(s, range(0, 300, 1))
    assert some.count() == 300 and histogram.of_instances(s, 5).count() == 1
    a, b = histogram.counts(s.where("label = 0")), histogram.counts(s.where("label > 0"))
    assert {r["state"]: r["count"] for r in histogram.merge(a, b).collect()} == dict(enumerate(want.tolist()))
    both = histogram.compare(a.where("state < 3"), b.where("state > 1")).collect()
    assert {r["state"] for r in both if r["count_left"] == 0} == {3, 4, 5} and {r["state"] for r in both if r["count_right"] == 0} == {0, 1}
    total = histogram.per_class(s).where("all_classes").agg(F.sum("count")).first()[0]
    assert total == 300


def test_probes(spark):
    cat = spark.createDataFrame([("m", "c1", "Conv"), ("m", "c2", "Conv"), ("m", "f", "Linear")], "model_id string, layer string, layer_class string")
    names = lambda *a, **k: sorted(r["probe"] for r in capture.build_probes(cat, *a, **k).collect())
    assert names("Conv") == ["c1_post_states", "c2_post_states"] and names("Conv", "c1", "both") == ["c2_post_states", "c2_pre_states"]
    assert names(["f", "c1"], ["c1"]) == ["f_post_states"] and names("Con") == []
    probes = capture.build_probes(cat, "Conv")
    assert capture.remove_probes(probes, "c1_post_states").count() == 1 and capture.remove_probes(probes).count() == 0
    with pytest.raises(ValueError):
        capture.build_probes(cat, "Conv", method="around")


def simulate(values, patience, smaller=False):
    best, streak, best_at = (math.inf if smaller else 0.0), 0, None
    for e, v in enumerate(values):
        if v < best if smaller else v > best:
            best, streak, best_at = v, 0, e
        else:
            streak += 1
        if streak >= patience:
            return e, best_at
    return None, best_at


@pytest.mark.parametrize("smaller", [False, True])
def test_early_stop_equals_simulation(spark, smaller):
    rnd = random.Random(8)
    runs = {f"r{k}": [rnd.choice([0.0, 0.1, 0.3, 0.5, 0.9]) for _ in range(12)] for k in range(30)} | {"doc": [0.1, 0.3, 0.3, 0.2, 0.9]}
    df = spark.createDataFrame([(k, e, v) for k, vs in runs.items() for e, v in enumerate(vs)], "run string, epoch long, accuracy double")
    got = {r["run"]: (r["stop_epoch"], r["best_epoch"]) for r in training.early_stop(df, 2, by=("run",), smaller=smaller).collect()}
    assert got == {k: simulate(v, 2, smaller) for k, v in runs.items()}


def test_store_and_streaming(spark, tmp_path):
    from statelens.streaming import follow, stream_metrics, to_store

    x = np.random.default_rng(2).standard_normal((60, 4)).astype(np.float32)
    src = str(tmp_path / "in")
    df = arrays(spark, x).repartition(4)
    df.write.parquet(src)
    states = capture.capture_states(df.withColumnRenamed("id", "instance_id").withColumn("layer", F.lit("l")), 4, column="a", keep=("instance_id", "layer"))
    store = StateStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    run = store.new_run()
    store.create(states, run)
    store.append(states.limit(10), run)
    with pytest.raises(FileExistsError):
        store.create(states, run)
    other = store.new_run()
    store.create(states.limit(5), other)
    assert store.read(run).count() == 70 and store.read(other, ["l"]).count() == 5 and store.read().count() == 75
    store.drop_run(other)
    assert store.read().count() == 70

    def stream():
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumnRenamed("id", "instance_id").withColumn("layer", F.lit("l"))
        return capture.capture_states(s, 4, column="a", keep=("instance_id", "layer"))

    hists = HistogramStore(spark, str(tmp_path / "hists"))
    with pytest.raises(FileNotFoundError):
        hists.read("f")
    follow(stream(), hists, "f", str(tmp_path / "c1")).awaitTermination()
    want = {r["state"]: r["count"] for r in histogram.counts(states).collect()}
    got = lambda run: {r["state"]: r["count"] for r in hists.read(run).collect()}
    assert got("f") == want
    hists.compact("f", "whole")
    hists.add(histogram.counts(states), "f", "whole")  # the same batch again replaces it
    assert got("f") == want
    seen = []
    cat = spark.createDataFrame([("l", 4)], "layer string, n_neurons int")
    stream_metrics(stream(), cat, hists, "m", lambda m, b: seen.append(m.first()["state_count"]), str(tmp_path / "c2")).awaitTermination()
    assert seen[-1] == 60 and seen == sorted(seen)
    sink = StateStore(spark, str(tmp_path / "sunk"))
    to_store(stream(), sink, "r", str(tmp_path / "c3")).awaitTermination()
    assert {r["state"]: r["count"] for r in histogram.counts(sink.read("r")).collect()} == want
    # batch, stream and batch in one store; the stream started anew writes the same batches again
    shared = StateStore(spark, str(tmp_path / "shared"))
    shared.append(states.limit(10), "r")
    to_store(stream(), shared, "r", str(tmp_path / "c4")).awaitTermination()
    assert shared.read("r").count() == 70
    shared.append(states.limit(10), "r")
    to_store(stream(), shared, "r", str(tmp_path / "c5")).awaitTermination()
    assert shared.read("r").count() == 80 and shared.read("r").columns == ["run_id", "layer", "instance_id", "position", "state"]
    shared.reset("r", ["l"])
    assert shared.read("r").count() == 0


def test_sql_functions(spark):
    pack.register(spark)
    r = spark.sql("select hex(pack_state(array(0f, 1f, 1f, 1f, 1f))) as k, unpack_state(unhex('1E'), 5) as b").first()
    assert r["k"] == "1E" and r["b"] == [False, True, True, True, True]
    df = spark.createDataFrame([([1.0] * 9,), (None,), ([-1.0, 1.0],), ([],), ([1.0] * 9,)], "a array<float>").coalesce(1)
    assert [x[0] and x[0].hex() for x in df.selectExpr("pack_state(a)").collect()] == ["ff01", None, "02", b"", "ff01"]


def test_queries_equal_their_sql(spark, sf):
    import duckdb
    from statelens.plans.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("embeddings", "events", "labels", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = oracle_sql()
    assert set(sql) == set(queries())
    text = lambda rows: sorted(str(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)
    for name, q in queries().items():
        df = q(spark, sf)
        cols = sorted(df.columns)
        assert text(df.select(*cols).collect()) == text(con.execute(f"select {', '.join(cols)} from ({sql[name]})").fetchall()), name


def test_network_capture_rounds_halves_as_its_sql(spark, tmp_path):
    import duckdb
    from statelens.plans.queries import oracle_sql, queries

    # values that are halves of a thousandth, and sums that are halves of a hundredth
    x = np.random.default_rng(6).choice([0.0625, -0.0625, 0.1875, 0.3125, 0.005, -0.005, 0.015, 0.01, -0.02], (2000, 64)).astype(np.float32)
    x[1000:, 9:] = 0
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"select layer, state, count from ({oracle_sql()['network_capture']})").fetchall()
    assert sorted(map(tuple, queries()["network_capture"](spark, str(tmp_path)).collect())) == sorted(want)


def test_counting_needs_one_exchange(spark, sf):
    from statelens.plans.queries import queries

    plan = queries()["histogram"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "ReadSchema: struct<embedding:array<float>>" in plan
