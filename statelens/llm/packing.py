"""Sequence packing: shortest-pack-first over the histogram of lengths.

Only piece lengths matter for packing, and there are at most `size` of them: the driver packs
the histogram, not the documents, and the patterns are joined back by each piece's rank
among pieces of its length.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import forget, in_arrow, save, shuffle_parts, table

SIZE = 1024
TOKENIZER = "byte_bpe_50k"
END = 0


@lru_cache(2)
def tokenizer(name: str):
    """text -> ids as numpy uint32, as the `tokenizers` library gives them for name.json with add_special_tokens=False.

    The same vocabulary's rank file gives the same ids several times faster; a text that holds
    the special token's string, which `tokenizers` takes as that token, goes to `tokenizers`.
    """
    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    with open(files.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = lru_cache(1)(lambda: Tokenizer.from_file(files.path(f"{name}.json")))  # some 30 MB, which most workers never need

    def ids(text: str) -> np.ndarray:
        if "<|" in text:
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


PIECE = "row long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, size: int = SIZE, tokenizer_name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Each document's ids and a final END, cut every `size` ids: row, doc_id, start, length, ids_crc32, doc_tokens[, ids].

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers. Null and empty texts are
    END alone; each row of docs is a document of its own, also if repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_name)
        for b in batches:
            rows, held, n = [], [], 0

            def out():
                cols = list(zip(*rows, strict=True))
                got = [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)]
                names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    got.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(got, names=names)

            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), size):
                    x = ids[at : at + size]
                    rows.append((row, doc, at, len(x), zlib.crc32(x.tobytes()), len(ids)))
                    if with_ids:
                        held.append(x.astype(np.int32))
                        n += len(x)
                if n > 4_000_000:
                    yield out()
                    rows, held, n = [], [], 0
            if rows:
                yield out()

    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(x, run, PIECE + (", ids array<int>" if with_ids else ""))


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Shortest-pack-first: ([piece lengths], how many sequences) of each pattern.

    Lengths are placed longest first. A group of pieces of one length goes on the open pattern
    with the most room left (the shortest pack) if it fits, on as many of its sequences as
    there are; the rest of the pattern stays open as it was. What doesn't fit opens a new one.
    Each placement ends a length or uses up a pattern, so there are at most two patterns for
    each length placed, whatever the number of pieces.
    """
    heap: list[tuple[int, int, list[int], int]] = []  # (-room, order, lengths, sequences)
    done: list[tuple[list[int], int]] = []
    order = 0
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if heap and -heap[0][0] >= length:
                room, _, had, n = heapq.heappop(heap)
                put = min(left, n)
                if n > put:
                    heapq.heappush(heap, (room, order, had, n - put))
                    order += 1
                new, count, left = [*had, length], put, left - put
            else:
                # no open pattern has room: full packs of this length at once
                each = max(1, size // length)
                new, count = ([length] * each, left // each) if left >= each else ([length] * left, 1)
                left -= len(new) * count
            room = size - sum(new)
            if room:
                grown.append((-room, new, count))
            else:
                done.append((new, count))
        for room, new, count in grown:
            heapq.heappush(heap, (room, order, new, count))
            order += 1
    return done + [(had, n) for _, _, had, n in heap]


def _slots(packs: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank, first sequence and offset of each slot, in order of rank."""
    got: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    seq = 0
    for lengths, n in packs:
        at = 0
        for x in lengths:
            got.setdefault(x, []).append((used.get(x, 0), seq, at))
            used[x] = used.get(x, 0) + n
            at += x
        seq += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in got.items()}


def pack(docs: DataFrame, size: int = SIZE, tokenizer_name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: in each sequence pieces follow each other from 0, at most size ids.

    A piece's rank among those of its length is its place in its salted bucket plus the counts
    of the buckets before, so a length that most pieces have (such as full ones) is ranked by
    many tasks. Empty docs give no rows.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, size, tokenizer_name, with_ids), "pieces")
    buckets = max(64, shuffle_parts(spark))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)).cast("int"))
    counts = save(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")  # at most size * buckets rows
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most size rows
    sent = spark.sparkContext.broadcast(_slots(patterns(histogram, size)))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "start")) - 1
    ranked = cut.withColumn("place", place).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts):
                if len(at):
                    first, s, o = slots[int(length[at[0]])]
                    k = np.searchsorted(first, rank[at], side="right") - 1
                    seq[at], off[at] = s[k] + rank[at] - first[k], o[k]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    extra, kind = (["ids"], ", ids array<int>") if with_ids else ([], "")
    out = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *extra, "rank")
    return in_arrow(out, run, f"doc_id long, start long, length int, ids_crc32 long, doc_tokens long{kind}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumn("length", F.col("length").cast("long"))
