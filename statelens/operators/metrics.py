"""Entropy, efficiency, and the network's figures, from histograms.

With N observations, H1 = log2 N - sum(c log2 c) / N, and Ha = (log2 sum(c^a) - a log2 N) / (1 - a):
one aggregation over a histogram gives every order at once.
"""

from __future__ import annotations

import warnings
from math import isinf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Alpha = float | int | None


def _positive(x: Column) -> Column:
    """-0.0 as 0.0."""
    return x + F.lit(0.0)


def entropy_of(count: Column, alpha: float | int = 1) -> Column:
    """Aggregate: the Renyi entropy in bits of a group's counts; alpha 1 is Shannon, inf the min-entropy (an extension).

    A group without observations has Shannon entropy 0; for other orders it is null.
    """
    n, c = F.sum(count).cast("double"), count.cast("double")
    if isinf(alpha):
        return _positive(F.log2(n / F.max(c)))
    sole = F.max(c) == n  # one state: exactly 0, whatever the logarithms' rounding
    if alpha == 1:
        return _positive(F.when(sole, F.lit(0.0)).otherwise(F.coalesce(F.log2(n) - F.sum(c * F.log2(c)) / n, F.lit(0.0))))
    a = F.lit(float(alpha))
    return _positive(F.when(sole, F.lit(0.0)).otherwise((F.log2(F.sum(F.pow(c, a))) - a * F.log2(n)) / (F.lit(1.0) - a)))


def entropy(hist: DataFrame, alphas: tuple[float | int, ...] = (1,), by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(by..., alpha, entropy) for every order, in one pass over the histogram."""
    got = hist.groupBy(*by).agg(*[entropy_of(F.col("count"), a).alias(f"__h{k}") for k, a in enumerate(alphas)])
    rows = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"__h{k}").alias("entropy")) for k, a in enumerate(alphas)])
    return got.select(*by, F.explode(rows).alias("__x")).select(*by, "__x.*")


def check_alphas(alpha1: Alpha, alpha2: Alpha) -> None:
    for name, a in (("alpha1", alpha1), ("alpha2", alpha2)):
        if isinstance(a, bool) or not isinstance(a, (int, float)) and not (a is None and name == "alpha2"):
            raise AssertionError(f"{name} must be a number" + " or None" * (name == "alpha2"))
    if alpha2 is not None and alpha1 <= alpha2:
        raise AssertionError("alpha1 must be larger than alpha2")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and NaN where b is 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(_positive(a / b))


def layer_efficiency(hist: DataFrame, layers: DataFrame, alpha1: float | int = 1, alpha2: Alpha = None, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """(by..., n_neurons, state_count, n_states, entropy, efficiency) of every layer in the catalog.

    efficiency is H(alpha1) over H(alpha2), or over the neurons where alpha2 is None. A layer
    without states has counts, entropy and efficiency 0; with more columns in by (a class, an epoch), in
    each group of them that any layer has states of. The catalog is small and joined by Spark's choice.
    """
    check_alphas(alpha1, alpha2)
    others = [c for c in by if c != "layer"]
    cols = [F.sum("count").alias("state_count"), F.count("*").alias("n_states"), entropy_of(F.col("count"), alpha1).alias("entropy")]
    cols += [entropy_of(F.col("count"), alpha2).alias("__low")] if alpha2 is not None else []
    catalog = layers.select("layer", "n_neurons")
    if others:  # every layer once for each group that has states at all
        groups = hist.select(*others).distinct().select(F.struct(*others).alias("__g"))
        catalog = groups.withColumn("__one", F.lit(1)).join(catalog.withColumn("__one", F.lit(1)), "__one").drop("__one").select("__g.*", "layer", "n_neurons")
    got = hist.groupBy(*by).agg(*cols)
    same = F.lit(True)
    for c in by:  # a null label is a class like any other
        got = got.withColumnRenamed(c, f"__h_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__h_{c}"))
    got = catalog.join(got, same, "left")
    low = F.col("n_neurons").cast("double") if alpha2 is None else F.coalesce("__low", F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    return got.select(*by, "n_neurons", F.coalesce("state_count", zero).alias("state_count"), F.coalesce("n_states", zero).alias("n_states"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), ratio(F.coalesce("entropy", F.lit(0.0)), low).alias("efficiency"))


def max_entropy(layers: DataFrame) -> DataFrame:
    """(layer, max_entropy): one bit for each neuron."""
    return layers.select("layer", F.col("n_neurons").cast("double").alias("max_entropy"))


def geometric_mean(e: Column) -> Column:
    """Aggregate: 0 if any value is 0; null over no rows. ln(0) is null in Spark, and avg would skip it."""
    return F.when(F.min(e) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(e))))


def network_efficiency(efficiency: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., network_efficiency): the geometric mean of the layers' efficiencies; null without layers."""
    if not isinstance(efficiency, DataFrame):
        raise AssertionError("a DataFrame with a column efficiency is needed")
    return efficiency.groupBy(*by).agg(geometric_mean(F.col("efficiency")).alias("network_efficiency"))


def network_efficiency_of(values: list[float]) -> float | None:
    """The same of a list of numbers; an empty list warns and gives None."""
    from math import exp, log

    if not isinstance(values, list):
        raise AssertionError("a list is needed")
    if not values:
        warnings.warn("no layer to take the mean of", stacklevel=2)
        return None
    return 0.0 if min(values) == 0 else exp(sum(map(log, values)) / len(values))


def check_weight(weight: int) -> None:
    if isinstance(weight, bool) or not isinstance(weight, int) or weight <= 0:
        raise ValueError("weight must be an integer larger than 0")


def aiq(net_efficiency: Column, accuracy: Column, weight: int = 1) -> Column:
    """The artificial intelligence quotient: accuracy weighs `weight` times as much as efficiency."""
    check_weight(weight)
    return F.pow(F.pow(accuracy, F.lit(float(weight))) * net_efficiency, F.lit(1.0 / (weight + 1)))


def sum_entropy(entropies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return entropies.groupBy(*by).agg(F.sum("entropy").alias("sum_entropy"))


def frequencies(hist: DataFrame, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """hist with each state's share of its group: a join with the groups' totals, not a window over a layer's states."""
    total = hist.groupBy(*by).agg(F.sum("count").alias("__n"))
    return hist.join(total, list(by)).withColumn("frequency", F.col("count") / F.col("__n")).drop("__n")
