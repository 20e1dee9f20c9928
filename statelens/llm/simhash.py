"""SimHash near-dedup by covering locality-sensitive hashing.

Every bit of the fingerprint gets a random vector of r + 1 bits. For each of the 2^(r+1) - 1
nonzero vectors v, table v keys fingerprints by the bits whose vector has odd inner product
with v. Any r differing bits span at most r dimensions, so some v is orthogonal to all of
them: in its table the pair has one key. No pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_arrow, save, sorted_groups, table
from .components import components, forest

RADIUS, SHINGLE = 4, 4
#: A key with more distinct fingerprints is compared in pairs of blocks of about this many.
GROUP = 2048


def masks(radius: int, seed: int = 11) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; for any set of `radius` bits one mask avoids them all."""
    rnd = Random(seed)
    vectors = [rnd.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """64 bits; bit i is 1 if set in over half of the k-word shingles' XXH64 (seed 42). No words: 0."""
    w = (text or b"").lower().split()  # bytes: A-Z, and the blanks \x20 \x09-\x0D, only
    if not w:
        return 0
    flat = b" ".join(w)
    h = xxhash.xxh64_intdigest
    if len(w) <= k:
        return h(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = np.zeros(64, np.int64)
    n = len(w) - k + 1
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        got = np.array([h(flat[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist(), strict=True)], dtype="<u8")
        count += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((signed(fingerprint(t, k)) for t in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")), run, "doc_id long, fp long")


def _near(radius: int):
    def pairs(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what all links of one large group connect, in steps of 1,024 rows."""
        a, b = node[:0], node[:0]
        for at in range(0, len(fp), 1024):
            x, y = np.nonzero(np.bitwise_count(fp[at : at + 1024, None] ^ fp[None, at:]) <= radius)
            ok = y > x
            a, b = forest(np.concatenate([a, node[at + x[ok]]]), np.concatenate([b, node[at + y[ok]]]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["t", "key", "bi", "bj"]):
            fp = t["fp"].combine_chunks().to_numpy().view(np.uint64)
            node = t["node"].combine_chunks().to_numpy()
            size = np.diff(np.append(starts, len(fp)))
            left = np.repeat(size, size) - (np.arange(len(fp)) - np.repeat(starts, size)) - 1  # rows after this one in its group
            small = np.repeat(size, size) <= 64
            a, b = [], []
            rows = np.flatnonzero(small & (left > 0))
            d = 1
            while len(rows):
                near = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= radius]
                a.append(node[near])
                b.append(node[near + d])
                d += 1
                rows = rows[left[rows] >= d]
            for s, n in zip(starts[size > 64].tolist(), size[size > 64].tolist(), strict=True):
                x, y = pairs(fp[s : s + n], node[s : s + n])
                a.append(x)
                b.append(y)
            if a:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    return run


def near_links(classes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (u, v) between nodes of classes (fp, node), fp distinct, that connect all pairs within radius.

    Each fingerprint goes to all tables. A key of over `group` fingerprints is dealt out as
    block pairs to many tasks; each task returns a forest of the links it finds, so what comes
    back grows with the rows, not with the pairs.
    """
    spark = classes.sparkSession
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks(radius))])
    rows = classes.select("fp", "node", F.explode(keys).alias("x")).select("x.t", "x.key", "fp", "node")
    large = save(rows.groupBy("t", "key").count().where(F.col("count") > group).select("t", "key", F.ceil(F.col("count") / group).cast("long").alias("nb")), "large")
    if n := large.count():
        rows = rows.join(F.broadcast(large) if n <= 100_000 else large, ["t", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("nb"))
        rows = rows.select("t", "key", "fp", "node", "nb", F.when(F.col("nb").isNull(), F.lit(0)).otherwise(own).alias("own"))
        rows = rows.select("t", "key", "fp", "node", "own", F.explode(F.when(F.col("nb").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).alias("o"))
        rows = rows.select("t", "key", F.least("own", "o").alias("bi"), F.greatest("own", "o").alias("bj"), "fp", "node")
    else:
        rows = rows.select("t", "key", F.lit(0).cast("long").alias("bi"), F.lit(0).cast("long").alias("bj"), "fp", "node")
    by = ["t", "key", "bi", "bj"]
    return in_arrow(rows.repartition(*by).sortWithinPartitions(*by), _near(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased; a text of fewer than k words is one
    shingle. Null, empty and blank texts have fingerprint 0, linked like any other. Equal
    fingerprints are one class; classes within radius bits are linked. Rows of one doc_id are
    one document. A row with null doc_id gets a component only if its class has another row
    with an id. Empty docs give no rows.
    """
    fps = save(fingerprints(docs, k), "fps")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("node"))
    # written first: a task that searched and folded at once would hold two Python workers
    comp = components(save(near_links(classes.where("node is not null"), radius), "near"))
    by_fp = classes.join(comp, "node", "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "node").alias("component_id"))
    return fps.join(by_fp, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """docs with one row for each component: its smallest doc_id's. Of several rows of that doc_id one stays,
    whatever their order: one of null text, else the one of the smallest hash. Rows of null doc_id stay."""
    first = near_duplicates(docs, radius, k).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(save(first, "first"), "doc_id", "left_semi")
    rank = F.struct(F.col("text").isNotNull(), F.sha2("text", 256), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    kept = kept.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), rank).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
