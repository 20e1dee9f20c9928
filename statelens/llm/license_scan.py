"""License scan: exact set-similarity join of text blocks with licence templates. DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, ascii_lower, save, table

#: Word separators in original case; A-Z belongs to words and is lower-cased after the split.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that are looked up word for word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of licence notices: a label and the words a block should hold.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
)
THRESHOLD = 0.8
#: A block is WINDOW words, one every STRIDE: any run of up to WINDOW - STRIDE + 1 words lies whole in a block.
WINDOW, STRIDE = 64, 32


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(text.translate(str.maketrans(UPPER, LOWER)).replace(".", " ").split()))


def words_of(text: Column) -> Column:
    """The words of a text in their original case."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS, -1), lambda w: w != "")


def _places(ws: Column, phrase: str) -> Column:
    """Places in the lower-cased words ws where the phrase's words stand one after another."""
    parts = phrase.split()
    first = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i) == parts[0])
    ok = lambda i: F.lit(True) if len(parts) == 1 else _all([F.get(ws, i + k) == p for k, p in enumerate(parts) if k])
    return F.filter(first, lambda i: F.coalesce(ok(i), F.lit(False)))


def _labelled_places(phrase: str, label: str):
    return lambda ws: F.transform(_places(ws, phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))


def _need(tokens: list[str], threshold: float) -> int:
    return max(1, ceil(threshold * len(tokens) - 1e-9))


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def prefix_index(spark: SparkSession, sets: list[tuple[str, list[int]]], threshold: float) -> DataFrame:
    """(token, template, label, place, size, need, tokens): each template under the words of its prefix.

    sets: (label, ranks in the global order, ascending). A block with `need` of the `size` words must hold
    one of the rarest size - need + 1, and the rarest word that both hold is one of these.
    """
    rows = []
    for k, (label, tokens) in enumerate(sets):
        need = _need(tokens, threshold)
        rows += [(t, k, label, place, len(tokens), need, tokens) for place, t in enumerate(tokens[: len(tokens) - need + 1])]
    return spark.createDataFrame(rows, "token int, template int, label string, place int, size int, need int, tokens array<int>")


def candidates(blocks: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """Pairs of blocks (row, block, ranks: their template words in the global order) and templates that the filters leave.

    Prefix: of a block's words the first size - least + 1 are looked up (least: the smallest need), and
    for a template of larger need only as many as that leaves. Length: a block has `need` words of the
    templates at all. Position: from the shared word on, both sides have words enough left.
    """
    n = F.size("ranks")
    probes = blocks.select("row", "block", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.greatest(n - (least - 1), F.lit(0)))).alias("at", "token"))
    pairs = probes.join(F.broadcast(index), "token")  # a row for each word of a template's prefix
    by_length, by_prefix = n >= F.col("need"), F.col("at") <= n - F.col("need")
    by_place = 1 + F.least(F.col("size") - F.col("place") - 1, n - F.col("at") - 1) >= F.col("need")
    return pairs.where(by_length & by_prefix & by_place)


def similar_blocks(blocks: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """(row, label, block, containment) of every pair that meets the threshold, once: where the shared word is the pair's rarest."""
    both = F.array_intersect("tokens", "ranks")  # in the order of tokens
    x = candidates(blocks, index, least).withColumn("both", both).where((F.size("both") >= F.col("need")) & (F.get("both", F.lit(0)) == F.col("token")))
    return x.select("row", "label", "block", (F.size("both") / F.col("size").cast("double")).alias("containment"))


def blocks_of(texts: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(row, block, ranks) of each block of texts (row, lw): the distinct words that rank knows, by their rank."""
    known = F.array(*[F.lit(w) for w in rank])
    number = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    starts = F.sequence(F.lit(0), F.greatest(F.size("lw") - 1, F.lit(0)), F.lit(STRIDE))
    own = lambda s: F.array_sort(F.transform(F.array_intersect(F.slice("lw", s + 1, F.lit(WINDOW)), known), lambda w: number[w]))
    return texts.select("row", F.explode(F.transform(starts, lambda s: F.struct(s.alias("block"), own(s).alias("ranks")))).alias("x")).select("row", "x.block", "x.ranks")


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (label, start), found (label, block, containment).

    The words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased; null text has none.
    `places` are all places of the phrases. `found` has, for every block of 64 words (one every
    32) and every template of which the block holds at least `threshold` of the distinct words,
    the block's first word and the share it holds.

    The join is exact. The first pass orders the templates' words by how many documents hold them,
    and leaves out of the join documents that hold fewer than `need` of every template's words: no
    block of theirs can hold more. The blocks of the others are joined with the templates' prefix
    index, which grows with the templates only. Rows repeat as in docs; null ids stay null; no
    templates or empty docs are fine.
    """
    spark = docs.sparkSession
    sets = [(label, t) for label, text in templates if (t := _tokens(text))]
    vocab = sorted({w for _, t in sets for w in t})
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("ws"))
    known = F.array(*[F.lit(w) for w in vocab]) if vocab else F.array().cast("array<string>")
    low = F.transform(F.array(F.col("ws")), lambda ws: F.transform(ws, ascii_lower))[0]
    x = base.select("row", "doc_id", F.size("ws").cast("long").alias("n_words"), low.alias("lw"))
    x = x.withColumn("own", F.array_intersect("lw", known))
    may = F.lit(False)
    for p in phrases:
        may = may | _all([F.array_contains("lw", w) for w in p.split()])
    joined = F.lit(False)
    for _, t in sets:
        joined = joined | (F.size(F.array_intersect(F.array(*[F.lit(w) for w in t]), "own")) >= _need(t, threshold))
    x = x.withColumn("phrase", may).withColumn("joined", joined)
    x = save(x.select("row", "doc_id", "n_words", "own", "phrase", "joined", F.when(F.col("phrase") | F.col("joined"), F.col("lw")).alias("lw")), "license")

    bound = lambda f: F.transform(F.array(F.col("lw")), f)[0]  # noqa: E731  evaluates lw once
    some = [bound(_labelled_places(p, label)) for p, label in phrases.items()]
    kind = "array<struct<label:string,start:int>>"
    places = F.when(F.col("phrase") & (F.size("lw") > 0), F.concat(*some)) if some else F.lit(None)
    out = x.select("row", "doc_id", "n_words", F.coalesce(places, F.array().cast(kind)).alias("places"))
    none = F.array().cast("array<struct<label:string,block:int,containment:double>>")
    if not sets:
        return out.select("doc_id", "n_words", "places", none.alias("found"))
    freq = {r[0]: r[1] for r in x.select(F.explode("own").alias("w")).groupBy("w").count().collect()}  # at most the templates' words
    rank = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (freq.get(w, 0), w)))}
    index = prefix_index(spark, [(label, sorted(rank[w] for w in t)) for label, t in sets], threshold)
    hits = similar_blocks(blocks_of(x.where("joined").select("row", "lw"), rank), index, min(_need(t, threshold) for _, t in sets))
    found = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "block", "containment"))).alias("found"))  # a text's blocks, as its row held them
    return out.join(save(found, "found"), "row", "left").select("doc_id", "n_words", "places", F.coalesce("found", none).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan(table(spark, sf_dir, "documents"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    best = F.coalesce(F.array_max("found.containment"), F.lit(0.0))
    return x.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.col("places.label"), F.col("found.label")).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def oracle_sql() -> str:
    """The same in DuckDB: phrases by word tuples, templates by counting shared words of every block."""
    phrase = " union all ".join(
        f"select rn, '{label}' as label, i from (select rn, ws, unnest(range(0, len(ws))) as i from w) where " + " and ".join(f"coalesce(ws[i + {k + 1}], '') = '{p}'" for k, p in enumerate(ph.split()))
        for ph, label in PHRASES.items()
    )
    temp = ", ".join(f"({k}, '{label}', {_tokens(t)!r}, {_need(_tokens(t), THRESHOLD)})" for k, (label, t) in enumerate(TEMPLATES))
    return rf"""
with w as (select rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
           from (select *, row_number() over () as rn from documents)),
p as ({phrase}),
pl as (select rn, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as ls from p group by rn),
b as (select rn, ws[s + 1 : s + {WINDOW}] as block from (select rn, ws, unnest(range(0, len(ws), {STRIDE})) as s from w)),
t(k, label, words, need) as (values {temp}),
f as (select rn, label, len(list_intersect(words, block)) / len(words)::double as c from b cross join t where len(list_intersect(words, block)) >= need),
fl as (select rn, max(c) as best, list(distinct label) as ls from f group by rn)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(pl.ls, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(pl.ls, []), coalesce(fl.ls, [])))), ',') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
from w left join pl using (rn) left join fl using (rn)
"""
