"""Histograms of states: the one aggregation that all metrics rest on.

Counting is a hash aggregation with a partial step before the exchange on (keys, state), so
a state that most rows share costs one row for each task.

Places in state order are counted by ranges: rows are dealt out by ranges of (keys, state), a
window runs inside a range, and what stands before a range is one number for each range and
group. So no task holds a layer, however many distinct states a wide one has. Spark draws the
ranges' bounds from a sample, another one each time a plan runs: rows and numbers have to come
from one dealing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pack import sort_key, unpack_state


def counts(states: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(by..., state, count): observed states only. Null states are not observations."""
    return states.where("state is not null").groupBy(*by, "state").agg(F.count("*").alias("count"))


def state_count(hist: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Observations, repeats included, and distinct states."""
    return hist.groupBy(*by).agg(F.sum("count").alias("state_count"), F.count("*").alias("n_states"))


def with_empty_layers(summary: DataFrame, layers: DataFrame) -> DataFrame:
    """A row for every layer of the catalog; those without states have counts of 0."""
    out = layers.select("layer").join(summary, "layer", "left")
    return out.withColumn("state_count", F.coalesce("state_count", F.lit(0))).withColumn("n_states", F.coalesce("n_states", F.lit(0)))


def dealt_once(df: DataFrame) -> DataFrame:
    """df as a scan of its own rows. Its plan is run here up to its last exchange, and whatever reads the frame reads that exchange's output.

    The output's files go when nothing refers to the frame any more; lost ones are made again with the same bounds.
    """
    spark, jdf = df.sparkSession, df._jdf
    jdf.toLocalIterator()  # reads no row, but runs the exchange as a query that Spark's UI and event log show
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def ranked(rows: DataFrame, by: tuple[str, ...], order: list[Column], place: str, weight: Column | None = None) -> DataFrame:
    """rows with `place`: how many rows (or how much weight) of the group stand before each in `order`, which must tell all rows of a group apart.

    The ranges are as many as shuffle partitions; their sums are a row for each range and group,
    which windows by group put in order. Rows are dealt out when this is called.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    keys = [f"__k{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumns(dict(zip(keys, order, strict=True))).withColumn("__w", weight)
    ranged = dealt_once(ranged.repartitionByRange(parts, *by, *keys).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("__upto", F.sum("__w").over(inside))
    sums = ranged.groupBy(*by, "__part").agg(F.sum("__w").alias("__all"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), (F.sum("__all").over(earlier) - F.col("__all")).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__b{i}"))
    out = ranged.join(sums, same)
    return out.withColumn(place, (F.col("__before") + F.col("__upto") - F.col("__w")).cast("bigint")).drop(*keys, "__w", "__part", "__upto", "__before", "__p", *[f"__b{i}" for i in range(len(by))])


def state_ids(hist: DataFrame, by: tuple[str, ...] = ("layer",), binary: bool = False) -> DataFrame:
    """hist with position: the state's place, from 0, in state order inside its group."""
    return ranked(hist, by, [sort_key(F.col("state"), binary)], "position")


def states_unique(hist: DataFrame, n_neurons: int, binary: bool = False) -> DataFrame:
    """hist with the states unpacked."""
    return hist.withColumn("neurons", unpack_state(F.col("state"), n_neurons, binary))


def states_all(states: DataFrame, n_neurons: int, binary: bool = False) -> DataFrame:
    """Every observation, unpacked."""
    return states.withColumn("neurons", unpack_state(F.col("state"), n_neurons, binary))


def bin_edges(hist: DataFrame, by: tuple[str, ...] = ("layer",), binary: bool = False) -> DataFrame:
    """(by..., bin, edge): running sums of the counts in state order, with a leading 0."""
    pair = F.struct(F.lit(1).cast("bigint").alias("n"), F.col("count").alias("c"))
    hist = hist.withColumn("__pair", pair)
    order = [sort_key(F.col("state"), binary)]
    rows = ranked(ranked(hist, by, order, "__bin"), by, order, "__edge", F.col("count"))
    first = F.struct(F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("edge"))
    own = F.struct((F.col("__bin") + 1).alias("bin"), (F.col("__edge") + F.col("count")).alias("edge"))
    both = F.when(F.col("__bin") == 0, F.array(first, own)).otherwise(F.array(own))
    return rows.select(*by, F.explode(both).alias("__x")).select(*by, "__x.bin", "__x.edge")


def sort_index(states: DataFrame, row: str, by: tuple[str, ...] = ("layer",), binary: bool = False) -> DataFrame:
    """states with sorted_at: the row's place in state order; rows of one state are ordered by `row`, nulls last."""
    return ranked(states.where("state is not null"), by, [sort_key(F.col("state"), binary), F.col(row).isNull(), F.col(row)], "sorted_at")


def of_instances(states: DataFrame, ids: int | Iterable[int], column: str = "instance_id") -> DataFrame:
    """States of one instance or of a list of them: a filter that reaches the scan."""
    ids = [ids] if isinstance(ids, int) and not isinstance(ids, bool) else list(ids)
    if any(isinstance(i, (list, tuple, bool)) for i in ids):
        raise ValueError("instance ids are a number or a flat list of numbers")
    if len(ids) <= 200:
        return states.where(F.col(column).isin(ids))
    wanted = states.sparkSession.createDataFrame([(int(i),) for i in sorted(set(ids))], f"{column} bigint")
    return states.join(wanted, column, "left_semi")


def of_mask(states: DataFrame, mask: DataFrame, column: str = "instance_id") -> DataFrame:
    """States of the instances that mask lists; a small mask is broadcast by Spark's own size check."""
    return states.join(mask.select(column), column, "left_semi")


def compare(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(by..., state, count_left, count_right) over the states of either histogram; 0 where one lacks it."""
    a, b = left.withColumnRenamed("count", "count_left"), right.withColumnRenamed("count", "count_right")
    out = a.join(b, [*by, "state"], "full_outer")
    return out.select(*by, "state", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("count_left", "count_right")))


def merge(*hists: DataFrame) -> DataFrame:
    """One histogram of several of the same columns: counts of a state add up."""
    out = hists[0]
    for h in hists[1:]:
        out = out.unionByName(h)
    return out.groupBy(*[c for c in out.columns if c != "count"]).agg(F.sum("count").alias("count"))


def per_class(states: DataFrame, label: str = "label", by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Histograms of every class and of all classes together (all_classes true), in one pass."""
    x = states.where("state is not null")
    got = x.groupingSets([[F.col(label), *map(F.col, by), F.col("state")], [*map(F.col, by), F.col("state")]], F.col(label), *map(F.col, by), F.col("state"))
    return got.agg(F.count("*").alias("count"), (F.grouping(label) == 1).alias("all_classes"))
