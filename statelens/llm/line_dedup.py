"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, delete, forget, new_path, save, shuffle_parts

#: What is stripped at both ends of a line: space, tab, \n, VT, FF, CR.
BLANKS = " \t\n\x0b\x0c\r"
#: While runs are read: a scan of bucket files, one to a bucket, gives its rows in the order they were written in,
#: and a union of runs keeps their buckets, so that the merged run again has one file to a bucket.
SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
#: While a run is written: a batch's partitions stay those of the buckets, so that its union with runs keeps them too.
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class Runs:
    """Sorted runs on levels: a level that would hold `fanout` runs becomes one run of the next.

    A run is a table bucketed and sorted by hash, (h1, h2, holder, shared, is_new, batch), one file for
    each bucket: joins read it without an exchange and without a sort, and merging runs moves no row
    between buckets' files. A batch that fills levels is written once only, in the run that they
    become. Used in a with statement: at its end the runs' tables and files go, and SETTINGS are
    what they were before.
    """

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_parts(spark)
        self.levels: list[list[tuple[str, str]]] = [[]]

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k) for k in SETTINGS}
        for k, v in SETTINGS.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *failure) -> None:
        for k, v in self.before.items():
            self.spark.conf.set(k, v)
        for level in self.levels:
            self._drop(level)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for n, p in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
            delete(self.spark, p)

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "run")
        before = self.spark.conf.get(COALESCE)
        self.spark.conf.set(COALESCE, "false")
        try:
            (df.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name))
        finally:
            self.spark.conf.set(COALESCE, before)
        return name, path

    def all(self) -> list[DataFrame]:
        return [self.spark.table(name).where("is_new").select("h1", "h2", F.col("holder").alias("held")) for level in self.levels for name, _ in level]

    def shared(self) -> list[DataFrame]:
        """The keys that the batches so far share, in themselves or with an earlier one; read as plain files."""
        return [self.spark.read.schema(self.spark.table(name).schema).parquet(path).where("shared") for level in self.levels for name, path in level]

    def add(self, batch: DataFrame) -> None:
        """Write a batch's keys as a run of level 0, or with the runs of the levels that it fills."""
        full = 0
        while full < len(self.levels) and len(self.levels[full]) + 1 >= self.fanout:
            full += 1
        old = [run for level in self.levels[:full] for run in level]
        for name, _ in old:
            batch = batch.unionByName(self.spark.table(name))
        new = self._write(batch)
        self.levels[:full] = [[] for _ in range(full)]
        if full == len(self.levels):
            self.levels.append([])
        self.levels[full].append(new)
        self._drop(old)


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, tid, drops): the line numbers, from 0, that each document loses; tid is its text's hash.

    Documents come in `batches` ranges of ascending doc_id. Each batch's distinct keys
    (128 bits of two XXH64; partial sums absorb a line that a third of all documents hold) are
    merge-anti-joined to the runs so far: keys found there belong to an earlier document, the
    rest are new. Its keys join the sorted runs, but for the last batch's, which no other reads.
    A key's holder is then the smallest doc_id in the whole table. Each table written has at most one
    file for each partition: files cost time, memory and, on a local disk, processes.
    """
    spark = docs.sparkSession
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col("doc_id") > F.lit(c)).cast("int")
    line = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = line.select("doc_id", "tid", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = save(key.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "tid", "pos", part.alias("batch")), "lines")
    with Runs(spark, fanout) as runs:
        for b in range(len(set(cuts)) + 1):
            if b:
                runs.add(own)
            own = lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
            held = F.lit(None).cast("long")
            for k, run in enumerate(runs.all()):
                own = own.join(run.withColumnRenamed("held", f"held{k}"), ["h1", "h2"], "left")
                held = F.coalesce(held, F.col(f"held{k}"))
            own = own.select("h1", "h2", F.coalesce(held, "holder").alias("holder"), (held.isNotNull() | (F.col("last") > F.col("holder"))).alias("shared"), held.isNull().alias("is_new"), F.lit(b).alias("batch"))
        shared = own.where("shared")
        for run in runs.shared():
            shared = shared.unionByName(run)
        found = lines.join(shared.select("batch", "h1", "h2", "holder"), ["batch", "h1", "h2"]).where("doc_id > holder")
        drops = save(found.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("drops")), "drops")
    forget(lines)
    return drops


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped.

    Text is split at \\n; a line's key is the line stripped of blanks at both ends, with A-Z
    lower-cased. A key of min_chars code points or more that several documents hold stays in
    the smallest doc_id only; there, and for shorter keys, every line stays. Null or empty text
    is one empty line and comes out as the empty string. Rows of one doc_id are one document;
    repeated rows lose the same lines. A null doc_id neither holds nor loses lines. A text of
    which every line goes is empty. Other columns pass through; clashing ones are replaced.
    """
    drops = dropped_lines(docs, min_chars, batches, fanout).select(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid"), F.col("drops").alias("__drops"))
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    x = docs.join(drops, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__tid")), "left")
    n = F.size(lines_of(F.col("text")))
    # array_except is a hash pass and keeps order, so a long document costs its length; the outer transform splits the text once
    kept = F.transform(F.array(lines_of(F.col("text"))), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drops")), lambda i: F.get(ls, i)), "\n"))[0]
    return x.select(
        *docs.columns,
        F.when(F.col("__drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
with l as (select doc_id, rn, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
           from (select *, row_number() over () as rn from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
h as (select key, min(doc_id) as holder from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select k.*, coalesce(k.doc_id > h.holder, false) as gone from k left join h on k.key = h.key)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '')) as kept_sha256
from m group by doc_id, rn
"""


def query(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
