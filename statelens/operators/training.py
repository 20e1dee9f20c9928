"""Figures of a training run: batch means, accuracy, and when to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight); null where the weights sum to 0."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def argmax(a: Column) -> Column:
    """The place, from 0, of an array's first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def accuracy(predicted: Column, label: Column) -> Column:
    """Aggregate: the share of rows whose prediction is the label."""
    return F.avg((predicted == label).cast("double"))


def early_stop(epochs: DataFrame, patience: int, value: str = "accuracy", epoch: str = "epoch", by: tuple[str, ...] = (), smaller: bool = False) -> DataFrame:
    """(by..., stop_epoch, best_epoch): where training ends, and the best epoch until then.

    A value strictly above the best so far (0 before the first; with smaller, below it, infinity
    before the first) resets the count of epochs without gain; at `patience` of them training
    stops. stop_epoch is null if it never does. Windows run inside a run; a run has few epochs.
    """
    if patience < 1:
        raise ValueError("patience must be 1 or more")
    sign = -1.0 if smaller else 1.0
    start = F.lit(float("-inf") if smaller else 0.0)
    w = Window.partitionBy(*by).orderBy(epoch) if by else Window.partitionBy(F.lit(0)).orderBy(epoch)
    x = epochs.withColumn("__v", F.col(value) * sign)
    x = x.withColumn("__best", F.greatest(F.coalesce(F.max("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)), start), start))
    x = x.withColumn("__gain", F.coalesce(F.col("__v") > F.col("__best"), F.lit(False)).cast("int"))
    x = x.withColumn("__g", F.sum("__gain").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (Window.partitionBy(*by, "__g") if by else Window.partitionBy("__g")).orderBy(epoch)
    x = x.withColumn("__streak", F.row_number().over(inside) - F.when(F.col("__g") == 0, 0).otherwise(1))
    x = x.withColumn("__start", F.when(F.col("__g") > 0, F.first(epoch).over(inside)))
    stopped = F.col("__streak") >= patience
    got = x.groupBy(*by).agg(F.min(F.when(stopped, F.col(epoch))).alias("stop_epoch"), F.min_by(F.col("__start"), F.when(stopped, F.col(epoch))).alias("__at_stop"), F.max("__start").alias("__last"))
    return got.select(*by, "stop_epoch", F.when(F.col("stop_epoch").isNull(), F.col("__last")).otherwise(F.col("__at_stop")).alias("best_epoch"))


def dual_stop(epochs: DataFrame, patience: int, up: str = "accuracy", down: str = "net_efficiency", epoch: str = "epoch", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., stop_up, best_up, stop_down, best_down): both criteria over one run, each on its own."""
    key = by or ("__one",)
    x = epochs if by else epochs.withColumn("__one", F.lit(0))
    a = early_stop(x, patience, up, epoch, key).withColumnsRenamed({"stop_epoch": "stop_up", "best_epoch": "best_up"})
    b = early_stop(x, patience, down, epoch, key, smaller=True).withColumnsRenamed({"stop_epoch": "stop_down", "best_epoch": "best_down"})
    return a.join(b, list(key)).drop("__one")


def epoch_series(efficiency: DataFrame, by: tuple[str, ...] = ("epoch", "split")) -> DataFrame:
    """(by..., layers, network_efficiency): a series of the network's efficiency by epoch and split."""
    from .metrics import geometric_mean

    return efficiency.groupBy(*by).agg(F.count("*").alias("layers"), geometric_mean(F.col("efficiency")).alias("network_efficiency"))
