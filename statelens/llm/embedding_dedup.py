"""Embedding near-dedup by NN-descent on the cosine.

Equal vectors are one node. A few tables of random-hyperplane blocks start every node's neighbour
list; then each round joins every node's neighbours, and the nodes that list it, with each other,
so neighbours of neighbours meet and lists improve. A list full of links (cosine >= threshold)
doubles. Links are the lists' entries at the threshold or above, and the pairs at the threshold
that a join meets; blocks give no links of their own. Lists beyond K_MOST lose nothing: links go into a
forest, the forest gives components, and a last pass counts every link inside each component exactly. An audit of
drawn nodes against all rows bounds the recall node by node; while it is short, more tables and rounds follow,
and once they join no more components all nodes are compared exactly.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from math import acos, ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import forget, in_arrow, longs, save, sorted_groups, table
from .components import components, forest

THRESHOLD = 0.95
#: Hyperplane tables of a pass, nodes in a block that is aimed at, and nodes in a block when links are counted.
TABLES, LEAF, BLOCK = 4, 200, 1024
#: Nodes above which a hyperplane block is compared in pairs of parts: larger parts mean fewer copies of each row.
PART = 4096
#: Entries of a neighbour list: at first, and where doubling ends.
K, K_MOST = 6, 48
#: Others that a local join offers to each of its members.
OFFER = 3
#: Rounds of a pass at most (it ends when a round improves less than SETTLED of the lists), nodes with links audited of each kind, recall to reach.
ROUNDS, SETTLED, AUDIT, RECALL = 4, 0.01, 400, 0.98
#: Nodes of a component above which it is audited apart, and nodes compared with all rows at once.
LARGE, DRAW = 1000, 8192


def unit(col) -> np.ndarray:
    """A list column as unit rows in double precision; shorter ones are padded with zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == n[0]).all():
        x = flat.reshape(len(n), n[0])
    else:
        x = np.zeros((len(n), int(n.max(initial=0))))
        x[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(e: Column) -> Column:
    """Whether a vector can link: not null or empty, every component finite, one of them not zero."""
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(e, lambda x: x != 0), F.lit(False))


def _planes(dim: int, table_no: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, table_no]).standard_normal((dim, bits))


def _keys(bits: int, tables: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dim, x = b.column("d").to_numpy(), unit(b.column("e"))
            keys = np.zeros((b.num_rows, len(tables)), np.int64)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                for j, t in enumerate(tables):
                    keys[at, j] = (x[at, :d] @ _planes(int(d), t, bits) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=[*b.schema.names, "keys"])

    return run


def _top(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest along the last axis."""
    return np.argpartition(s, -k, axis=-1)[..., -k:] if k < s.shape[-1] else np.broadcast_to(np.arange(s.shape[-1]), s.shape)


FOUND = "node long, nbr long, sim double, link boolean"


def _rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """List entries, and the links as a forest."""
    a = [np.concatenate(x) if x else np.empty(0) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    u, v = forest(*(np.concatenate(x) for x in zip(*links, strict=True))) if links else (np.empty(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([a[0], u]).astype(np.int64)), pa.array(np.concatenate([a[1], v]).astype(np.int64)), pa.array(np.concatenate([a[2], np.ones(len(u))])), pa.array(np.repeat([False, True], [len(a[0]), len(u)]))],
        names=["node", "nbr", "sim", "link"],
    )


def _blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["t", "key", "d", "bi", "bj"]):
            node, side, col = longs(t["node"]), longs(t["side"]), t["e"].combine_chunks()
            parts = []
            for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(node)], strict=True):
                if b - a < 2:
                    continue
                x, own, right = unit(col.slice(a, b - a)), node[a:b], side[a:b] > 0
                # one part with itself, or the left part's nodes with the right part's and back
                for rows, others in [(~right, right), (right, ~right)] if right.any() else [(~right, ~right)]:
                    at, to = np.flatnonzero(rows), np.flatnonzero(others)
                    if not len(to):
                        continue
                    for some in np.array_split(at, -(-len(at) // 128)) if len(at) else []:
                        s = x[some] @ x[to].T
                        s[some[:, None] == to] = -2
                        top = _top(s, k)
                        sim = np.take_along_axis(s, top, 1)
                        ok = sim > -2
                        parts.append((np.broadcast_to(own[some][:, None], top.shape)[ok], own[to][top][ok], sim[ok]))
            yield _rows(parts, [])

    return run


def _local_join(threshold: float, offer: int):
    """At each middle node its neighbours are compared, but for pairs that both stood there before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["mid"], 1 << 14):
            node, fresh, x = longs(t["node"]), t["fresh"].combine_chunks().to_numpy(zero_copy_only=False), unit(t["e"])
            size = np.diff(np.append(starts, len(node)))
            parts, links = [], []
            for m in np.unique(size[size > 1]).tolist():
                at = starts[size == m]
                for some in np.array_split(at, max(1, len(at) * m * m // 1_000_000)):
                    idx = some[:, None] + np.arange(m)
                    own, new, y = node[idx], fresh[idx], x[idx]
                    s = y @ y.transpose(0, 2, 1)
                    s[~(new[:, :, None] | new[:, None, :]) | (own[:, :, None] == own[:, None, :])] = -2
                    g, i, j = np.nonzero(np.triu(s >= threshold))
                    links.append((own[g, i], own[g, j]))
                    top = _top(s, offer)
                    sim = np.take_along_axis(s, top, 2)
                    ok = sim > -2
                    parts.append((np.broadcast_to(own[:, :, None], top.shape)[ok], np.take_along_axis(np.broadcast_to(own[:, None, :], s.shape), top, 2)[ok], sim[ok]))
            yield _rows(parts, links)

    return run


def _merge(entries: DataFrame, threshold: float, k: int, k_most: int) -> DataFrame:
    """Lists (node, nbrs: sim, nbr, fresh) of the best k entries of each node; a list full of links doubles, up to k_most."""
    one = entries.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    # a hub that very many name: each task keeps its best k_most before the exchange
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("sim").desc(), F.col("nbr").desc()))
    lists = one.withColumn("rank", rank).where(F.col("rank") <= k_most).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sim", "nbr", "fresh")), asc=False).alias("all"))
    size, step = F.lit(k), k
    while step < k_most:
        size = F.when((size == step) & (F.get("all", F.lit(step - 1))["sim"] >= threshold), F.lit(min(2 * step, k_most))).otherwise(size)
        step *= 2
    return lists.select("node", F.slice("all", F.lit(1), size).alias("nbrs"))


def _start(nodes: DataFrame, tables: list[int], bits: int, k: int) -> DataFrame:
    """Each node's best k of its block in each hyperplane table, as list entries. A block of over PART nodes is
    dealt into parts of about as many, and every pair of parts is compared, so all of a block's pairs are."""
    keyed = save(in_arrow(nodes, _keys(bits, tables), nodes.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",keys:array<bigint>"), "keys")
    rows = keyed.select("node", "e", "d", F.posexplode("keys").alias("t", "key")).withColumn("t", F.col("t").cast("long"))
    large = save(rows.groupBy("t", "key", "d").count().where(F.col("count") > PART).select("t", "key", "d", F.ceil(F.col("count") / PART).cast("long").alias("nb")), "large")
    rows = rows.join(F.broadcast(large) if large.count() <= 100_000 else large, ["t", "key", "d"], "left")
    one = F.lit(1).cast("long")
    rows = rows.withColumn("nb", F.coalesce("nb", one)).withColumn("sub", F.pmod(F.xxhash64("node", "t"), F.col("nb")))
    rows = rows.withColumn("with", F.explode(F.sequence(one - 1, F.col("nb") - 1)))
    rows = rows.withColumn("bi", F.least("sub", "with")).withColumn("bj", F.greatest("sub", "with")).withColumn("side", (F.col("sub") > F.col("with")).cast("long"))
    by = ["t", "key", "d", "bi", "bj"]
    out = save(in_arrow(rows.select(*by, "side", "node", "e").repartition(*by).sortWithinPartitions(*by), _blocks(k), FOUND), "found")
    forget(keyed)
    forget(large)
    return out


def _round(nodes: DataFrame, lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """The joins of neighbours of neighbours: what they show, as list entries and links."""
    forward = lists.select(F.col("node").alias("mid"), F.explode("nbrs").alias("x")).select("mid", F.col("x.nbr").alias("node"), F.col("x.fresh").alias("fresh"))
    # a node that very many list is a middle for as many of them as its own list holds, k at least; the limit of K_MOST works before the exchange too
    back = forward.select(F.col("node").alias("mid"), F.col("mid").alias("node"), "fresh")
    rank = F.row_number().over(Window.partitionBy("mid").orderBy(F.xxhash64("node", "mid")))
    back = back.withColumn("rank", rank).where(F.col("rank") <= max(k, K_MOST))
    back = back.join(lists.select(F.col("node").alias("mid"), F.size("nbrs").alias("size")), "mid", "left")
    back = back.where(F.col("rank") <= F.greatest(F.lit(k), F.coalesce("size", F.lit(k)))).select("mid", "node", "fresh")
    both = forward.unionByName(back).groupBy("mid", "node").agg(F.max("fresh").alias("fresh"))
    x = both.join(nodes.select("node", "e"), "node")
    return save(in_arrow(x.select("mid", "node", "fresh", "e").repartition("mid").sortWithinPartitions("mid"), _local_join(threshold, OFFER), FOUND), "found")


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with their component, their own number without a link."""
    x = nodes.join(components(links), "node", "left")
    return save(x.select("node", "n", "d", "e", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked")), "labelled")


def _lower(mean: float, n: int, z: float = 1.645) -> float:
    """Wilson's lower bound (95%, one side) of a mean of n shares between 0 and 1; 0 without any."""
    return (mean + z * z / (2 * n) - z * sqrt(mean * (1 - mean) / n + (z / (2 * n)) ** 2)) / (1 + z * z / n) if n else 0.0


def _against(labelled: DataFrame, drawn: pa.Table, threshold: float) -> DataFrame:
    """Drawn nodes against all rows, saved: by place in drawn and task the links (total) and those inside
    one component (same); with a null place the links between components, as a forest."""
    dims = drawn["d"].to_numpy()
    sent = labelled.sparkSession.sparkContext.broadcast((longs(drawn["node"]), longs(drawn["component"]), dims, unit(drawn["e"]).astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, comp, d, q = sent.value
        total, same = np.zeros((2, len(own)), np.int64)
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x, node, dim, c = unit(part.column("e")), *(longs(part.column(k)) for k in ("node", "d", "component"))
                w = min(x.shape[1], q.shape[1])
                for lo in range(0, len(own), 1024):
                    to = slice(lo, lo + 1024)
                    near = x[:, :w] @ q[to, :w].T >= threshold
                    near &= (dim[:, None] == d[to]) & (node[:, None] != own[to])
                    total[to] += near.sum(axis=0)
                    near &= c[:, None] != comp[to]
                    away = near.sum(axis=0)
                    same[to] -= away
                    if away.any():
                        i, j = np.nonzero(near)
                        u, v = forest(np.concatenate([u, node[i]]), np.concatenate([v, own[to][j]]))
        same += total
        some = np.flatnonzero(total)
        none, zero = pa.nulls(len(u), pa.int64()), pa.nulls(len(some), pa.int64())
        cols = [(pa.array(some), none), (zero, pa.array(u)), (zero, pa.array(v)), (pa.array(total[some]), none), (pa.array(same[some]), none)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in cols], names=["place", "node", "nbr", "total", "same"])

    return save(in_arrow(labelled.select("node", "d", "e", "component"), run, "place long, node long, nbr long, total long, same long"), "audit")


def _audit(labelled: DataFrame, threshold: float, turn: int, most: int, whole: bool = False) -> tuple[dict, DataFrame | None]:
    """Recall of the components, and the links between components that the audit met.

    Nodes are drawn by hash, those of components of over LARGE nodes apart from the others, and
    compared with all rows, until `most` of each kind that have a link were drawn, or all nodes
    were. Each counts alike, with the share of its links whose ends are in one component. A kind's
    recall is the mean of these shares if all its nodes were drawn, else the mean's lower
    bound; the smaller recall of the two counts. whole: all nodes are drawn.
    """
    large = save(labelled.groupBy("component").count().where(F.col("count") > LARGE).select("component", F.lit(True).alias("large")), "large")
    rows = labelled.join(large, "component", "left").select("node", "d", "e", "component", F.coalesce("large", F.lit(False)).alias("large"))
    h = F.pmod(F.xxhash64(F.lit(f"audit {turn}"), "node"), F.lit(1 << 32))
    sizes = dict(map(tuple, rows.groupBy("large").count().collect()))
    out, met = {"recall": 1.0, "audited_links": 0, "found_links": 0, "audited_nodes": 0, "drawn_nodes": 0}, None
    for kind, n in sizes.items():
        lo, step, shares = 0, DRAW // 4, []
        while lo < 1 << 32 and (whole or len(shares) < most):
            hi = min(1 << 32, lo + max(1, step * (1 << 32) // n))
            drawn = rows.where((F.col("large") == kind) & (h >= lo) & (h < hi)).select("node", "d", "e", "component").toArrow()
            lo, step = hi, min(2 * step, DRAW)
            if not len(drawn):
                continue
            got = _against(labelled, drawn, threshold)
            counts = got.where("place is not null").groupBy("place").agg(F.sum("total"), F.sum("same")).collect()
            shares += [r[2] / r[1] for r in counts]
            out["audited_links"] += sum(r[1] for r in counts)
            out["found_links"] += sum(r[2] for r in counts)
            out["drawn_nodes"] += len(drawn)
            if any(r[2] < r[1] for r in counts):
                links = got.where("place is null").select("node", "nbr")
                met = links if met is None else met.unionByName(links)
        out["audited_nodes"] += len(shares)
        mean = sum(shares) / len(shares) if shares else 1.0
        out["recall"] = min(out["recall"], mean if lo >= 1 << 32 else _lower(mean, len(shares)))
    forget(large)
    return out, met


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            cos = np.einsum("ij,ij->i", unit(b.column("e")), unit(b.column("pivot")))
            keep = [b.column(c) for c in ("component", "node", "n", "e")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.arccos(np.clip(cos, -1, 1)))], names=["component", "node", "n", "e", "angle"])


def _pairs(threshold: float):
    """For each node of a group of far nodes and others: how many vectors its links of the group stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["component", "band", "lb", "rb"], 1 << 13):
            node, n, left, near, col = longs(t["node"]), longs(t["n"]), longs(t["is_left"]) > 0, longs(t["is_near"]) > 0, t["e"].combine_chunks()
            out, mass = [], []
            for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(node)], strict=True):
                x, own, w, far = unit(col.slice(a, b - a)), node[a:b], n[a:b], left[a:b]
                link = (x[far] @ x[~far].T >= threshold) | (own[far][:, None] == own[~far])
                out += [own[far], own[~far][near[a:b][~far]]]
                mass += [link @ w[~far], (w[far] @ link)[near[a:b][~far]]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(mass).astype(np.int64))], names=["node", "mass"])

    return run


def _count_links(linked: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, mass): how many vectors each node of a component is linked with, its own among them.

    Nodes within half the threshold's angle of the component's first node are all linked with
    each other, by the triangle inequality: no pair of them is compared, so a large group of
    near copies costs its rows. Every other node is compared, in pairs of blocks, with the nodes
    whose angle to the first node differs by the threshold's angle at most: by the same inequality no
    other can be linked with it, so a drawn-out component costs its bands of angles and not its square.
    """
    half, width = acos(threshold) / 2 - 1e-6, acos(threshold) + 1e-6
    kind = linked.schema["e"].dataType.simpleString()
    pivots = linked.where("node = component").groupBy("component").agg(F.first("e").alias("pivot"))
    x = linked.join(save(pivots, "pivots"), "component").select("component", "node", "n", "e", "pivot")
    x = save(in_arrow(x, _angles, f"component long, node long, n long, e {kind}, angle double"), "angles")
    one, near = F.lit(1).cast("long"), F.col("angle") <= half
    x = x.withColumn("is_near", near.cast("long")).withColumn("band", F.floor(F.col("angle") / width).cast("long"))
    around = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    sums = save(x.groupBy("component", "band").agg(F.sum(F.when(near, F.col("n"))).alias("near_mass"), F.count(F.when(~near, 1)).alias("far"), F.count("*").alias("all")), "sums")
    partners = sums.select("component", around, "all").groupBy("component", "band").agg(F.sum("all").alias("all"))
    cells = sums.where("far > 0").select("component", "band", F.ceil(F.col("far") / block).cast("long").alias("lbs")).join(partners, ["component", "band"])
    cells = save(cells.select("component", "band", "lbs", F.ceil(F.col("all") / block).cast("long").alias("rbs")), "cells")
    base = x.where(near).join(sums.groupBy("component").agg(F.sum("near_mass").alias("mass")), "component").select("node", "mass")
    salt = F.xxhash64("node")
    left = x.where(~near).join(cells, ["component", "band"])
    left = left.select("component", "band", F.pmod(salt, F.col("lbs")).alias("lb"), F.explode(F.sequence(one - 1, F.col("rbs") - 1)).alias("rb"), "node", "n", one.alias("is_left"), "is_near", "e")
    right = x.select("component", around, "node", "n", "is_near", "e").join(cells, ["component", "band"])
    right = right.select("component", "band", F.explode(F.sequence(one - 1, F.col("lbs") - 1)).alias("lb"), F.pmod(salt, F.col("rbs")).alias("rb"), "node", "n", (one - 1).alias("is_left"), "is_near", "e")
    by = ["component", "band", "lb", "rb"]
    pairs = in_arrow(left.unionByName(right).repartition(*by).sortWithinPartitions(*by), _pairs(threshold), "node long, mass long")
    return base.unionByName(pairs).groupBy("node").agg(F.sum("mass").alias("mass"))


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, k: int = K, recall: float = RECALL, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of df.

    Linked are vectors of one length with cosine >= threshold in double precision; vectors that
    are null, empty, zero or hold null or non-finite components link with nothing. n_links counts
    the other vectors linked directly, exactly inside each component found; repeated rows count as
    further vectors. component_id is the smallest id reachable, kept is id = component_id. A row of
    null id neither links nor has a component. Rows of one id but different vectors are one node
    of the graph, to which the links of each count. Empty tables give no rows; other columns are ignored.
    report, if given, receives the last audit: recall (what _audit bounds), audited_nodes with a link among
    drawn_nodes, their links, those found before links the audit met were added, the passes and rounds made, by_round (the
    share of all directed links that the lists' and joins' components hold after the start and after each round, against an audit
    of their own, which costs time), and exact: whether
    all nodes were compared at last because a pass joined no more components below the recall to reach. Where
    hardly any node has a link, audit and exact comparison cost the square of the nodes.
    """
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    e = F.col(vector_col).cast(kind)
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable(e) & F.col(id_col).isNotNull(), e).alias("e"))
    base = save(base.select("vec_id", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("h1"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(1), "e")).alias("h2"), "e"), "vectors")
    classes = save(base.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    first = base.withColumnRenamed("vec_id", "node").join(classes, ["node", "h1", "h2"]).dropDuplicates(["node", "h1", "h2"])
    nodes = save(first.select("node", "n", F.size("e").cast("long").alias("d"), "e"), "nodes")
    total = nodes.count()
    bits = min(62, max(0, ceil(log2(max(1, total) / LEAF))))
    entries, links, labelled = None, None, None
    rounds, turn, parts = 0, 0, nodes.select("node").distinct().count()
    in_lists = lambda fresh: lists.select("node", F.explode("nbrs").alias("x")).select("node", "x.nbr", "x.sim", fresh.alias("fresh"))
    at_threshold = lambda: in_lists(F.lit(False)).where(F.col("sim") >= threshold).select("node", "nbr")
    by_round: list[float] = []

    def audit_round() -> None:
        if report is not None:
            seen = _audit(_labelled(nodes, at_threshold() if links is None else links.unionByName(at_threshold())), threshold, 1000 + rounds, AUDIT)[0]
            by_round.append(seen["found_links"] / max(1, seen["audited_links"]))

    while True:
        got = _start(nodes, list(range(turn * tables, (turn + 1) * tables)), bits, k)
        rows = got.select("node", "nbr", "sim", F.lit(True).alias("fresh"))
        entries = rows if entries is None else entries.unionByName(rows)
        lists = save(_merge(entries, threshold, k, K_MOST), "lists")
        audit_round()
        for _ in range(ROUNDS):
            got = _round(nodes, lists, threshold, k)
            rounds += 1
            met = got.where("link").select("node", "nbr")
            links = met if links is None else links.unionByName(met)
            entries = in_lists(F.lit(False)).unionByName(got.where("not link").select("node", "nbr", "sim", F.lit(True).alias("fresh")))
            lists = save(_merge(entries, threshold, k, K_MOST), "lists")
            audit_round()
            improved = lists.where(F.exists("nbrs", lambda x: x["fresh"])).count()
            if improved <= SETTLED * total:
                break
        entries = in_lists(F.lit(False))
        links = links.unionByName(at_threshold())
        labelled = _labelled(nodes, links)
        audit, met = _audit(labelled, threshold, turn, AUDIT)
        turn += 1
        left, parts = parts, labelled.select("component").distinct().count()
        exact = audit["recall"] < recall and parts == left
        if exact:
            _, met = _audit(labelled, threshold, turn, AUDIT, whole=True)
        if exact or audit["recall"] >= recall:
            break
    if met is not None:
        labelled = _labelled(nodes, links.unionByName(met))
    audit.update(exact=exact, passes=turn, rounds=rounds, nodes=total, by_round=by_round)
    logging.getLogger(__name__).info("near_vectors: %s", audit)
    if report is not None:
        report.update(audit)
    mass = save(_count_links(labelled.where("linked"), threshold), "mass")
    by_node = labelled.groupBy("node").agg(F.min("component").alias("component")).join(mass, "node", "left")
    by_class = save(classes.join(by_node, "node").select("h1", "h2", "component", (F.coalesce("mass", "n") - 1).alias("n_links")), "by_class")
    valid = base.where("h1 is not null").select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"])
    out = valid.select("vec_id", "n_links", F.col("component").alias("component_id"))
    out = out.unionByName(base.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
