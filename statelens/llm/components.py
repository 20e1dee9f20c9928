"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, in_arrow, save


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a[i], b[i]) as stars: each node but a component's smallest, with that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links seen so far, folded every 200,000 links, so memory holds one forest."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    held, size = [], 0
    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        size += x.num_rows
        if size > 200_000 + 2 * len(a):
            a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
            held, size = [], 0
    if held:
        a, b = forest(np.concatenate([a, *(h[0] for h in held)]), np.concatenate([b, *(h[1] for h in held)]))
    for i in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["u", "v"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node with a link; component is the smallest node it reaches.

    links: two long columns. Each partition first folds its links into stars; then large-star
    and small-star rounds go on until nothing changes. Each round's links are a table in the
    shared folder, so a lost executor costs one round at most. Rows with a null or with equal
    ends are no links. An empty table gives no rows.
    """
    x, y = links.columns[:2]
    e = links.select(F.col(x).cast("long").alias("u"), F.col(y).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = save(in_arrow(e, _local, "u long, v long"), "cc")
    before = None
    for _ in range(most_rounds):
        # each side of a join is a written table, so Spark can split the partition of a node that very many link to
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        large = save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        # every edge now runs from the larger node to the smaller
        small = save(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        star = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        nxt = save(star.select("x.u", "x.v").where("u <> v").distinct(), "cc")
        for x in (low, large, small):
            forget(x)
        forget(e)
        e = nxt
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
