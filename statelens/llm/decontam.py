"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document, as search engines do it: a few MB of training text become
one segment, a row with the term list, every term's postings (token places in ascending
order, all documents of the segment laid end to end) and each document's first place. It holds every token, so any test phrases can be looked up in it. Building and searching
move no text and no posting between executors; a lost executor costs its own segments.

A phrase is found by intersecting its terms' lists, each moved by the term's place in the
phrase, from the rarest term in the corpus to the commonest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import forget, in_arrow, save, table

#: On UTF-8 bytes after lower-casing A-Z: every byte of a character above U+007F is part of a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words more than a window's own among which the proximity query looks for all of them: a few inserted ones.
SLOP = 4
#: Pairs of document and item that a search holds before it folds them.
FOLD = 1 << 20
#: places and ptr are int32 numbers, as bytes: a value each, so Spark moves a block and not its elements.
SEGMENT = "rows array<long>, docs array<long>, first array<int>, n_words array<int>, terms array<binary>, ptr binary, gaps binary"
#: Of a byte: 0 between words, else the byte with A-Z lower-cased.
LETTER = np.frombuffer(bytes(ord(chr(c).lower()) if c < 128 and WORD.fullmatch(bytes([c]).lower()) else c if c > 127 else 0 for c in range(256)), np.uint8)


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


class Phrases:
    """Test phrases: windows of at most n words of each item, distinct, as term numbers."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({str(item) for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            for s in range(max(1, len(ids) - n + 1) if ids else 0):
                found.setdefault(tuple(ids[s : s + n]), set()).add(number[str(item)])
        self.windows = list(found)
        self.items = [np.array(sorted(found[w]), np.int64) for w in self.windows]
        self.by_rarest: dict[int, list[tuple[int, list[int]]]] = {}

    def order(self, counts: dict[int, int]) -> None:
        """For each window its word offsets from the corpus's rarest term to the commonest."""
        for k, w in enumerate(self.windows):
            offs = sorted(range(len(w)), key=lambda o: (counts.get(w[o], 0), w[o], o))
            if all(counts.get(t, 0) for t in w):  # else no document holds it
                self.by_rarest.setdefault(w[offs[0]], []).append((k, offs))


def _order(x: np.ndarray) -> np.ndarray:
    """A stable sort's order of numbers below 2^32: numpy sorts 16 bits at a time by radix."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _encode(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, each word's term, each text's words) of an Arrow array of texts as bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    low = LETTER[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]] if raw is not None else np.empty(0, np.uint8)
    at = at - at[0]
    inside = low != 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]  # a text's end is a word's end
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    n = np.diff(np.searchsorted(start, at))
    ends = np.append(0, np.cumsum(stop - start)).astype(np.int32)
    got = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])]).dictionary_encode()
    return got.dictionary, got.indices.to_numpy(zero_copy_only=False), n


def _segment(rows: pa.Array, docs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One segment: the postings of all words of some documents."""
    terms, word, n = _encode(texts)
    first = np.cumsum(n + 1) - n - 1  # an empty place ends each document
    place = np.arange(len(word)) + np.repeat(np.arange(len(n)), n)
    places = place[_order(word)].astype(np.int32)
    ptr = np.append(0, np.cumsum(np.bincount(word, minlength=len(terms)))).astype(np.int32)
    gaps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    cols = [whole(x) for x in (rows, docs, pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), terms)] + [pa.array([x.tobytes()], pa.binary()) for x in (ptr, gaps)]
    return pa.RecordBatch.from_arrays(cols, names=["rows", "docs", "first", "n_words", "terms", "ptr", "gaps"])


def build_index(docs: DataFrame) -> DataFrame:
    """The positional inverted index over docs (row, doc_id, text as bytes): every token, saved in the shared folder.

    An Arrow batch, which holds a few MB or one document, is a segment. Places within its
    postings are stored as gaps. An index of one table can be searched for any number of test tables.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _segment(*b.columns)

    return save(in_arrow(docs.select("row", "doc_id", F.coalesce("text", F.lit(b"")).alias("text")), build, SEGMENT), "segments", compression="zstd")


def _known(b: pa.RecordBatch, i: int, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers in vocab, places in the term list, ptr) of a segment's terms that vocab holds."""
    number = pc.index_in(b.column("terms")[i].values, value_set=vocab)
    at = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
    return number.drop_null().to_numpy(), at, np.frombuffer(b.column("ptr")[i].as_buffer(), np.int32)


class Segment:
    """One segment's postings of the terms in vocab; a term's number is its place there."""

    def __init__(self, b: pa.RecordBatch, i: int, vocab: pa.Array):
        self.rows, self.docs = b.column("rows")[i].values, b.column("docs")[i].values
        self.first, self.n = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("first", "n_words"))
        self.total = int(self.first[-1] + self.n[-1] + 1) if len(self.first) else 0
        places = np.cumsum(np.frombuffer(b.column("gaps")[i].as_buffer(), np.int32), dtype=np.int64)
        number, at, ptr = _known(b, i, vocab)
        self.lists = {t: places[ptr[k] : ptr[k + 1]] for t, k in zip(number.tolist(), at.tolist(), strict=True)}
        self.none = places[:0]

    def exact(self, window: tuple[int, ...], offs: list[int]) -> np.ndarray:
        """Starts of the phrase: the rarest term's list moved by its offset, cut down to each other term's.

        Places of a document never reach beyond the empty one at its end, so no match does.
        """
        starts = self.lists.get(window[offs[0]], self.none) - offs[0]
        for o in offs[1:]:
            if not len(starts):
                break
            other = self.lists.get(window[o], self.none)
            if len(other):
                k = np.searchsorted(other, starts + o)
                starts = starts[other[np.minimum(k, len(other) - 1)] == starts + o]
            else:
                starts = self.none
        return starts

    def near(self, window: tuple[int, ...], offs: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths): for each place of the rarest term the first run of at most len(window) + slop words
        of its document that takes in this place and holds every word of the phrase, in any order."""
        span, need = len(window) + slop, {}
        for t in window:
            need[t] = need.get(t, 0) + 1
        a = self.lists.get(window[offs[0]], self.none)
        for t in dict.fromkeys(window[o] for o in offs[1:]):
            if not len(a):
                break
            p = self.lists.get(t, self.none)
            lo, hi = np.searchsorted(p, a - span + 1), np.searchsorted(p, a + span)
            a = a[hi - lo >= need[t]]
        if not len(a):
            return self.none, self.none
        d = np.searchsorted(self.first, a, side="right") - 1
        lo, hi = np.maximum(self.first[d], a - span + 1), np.minimum(self.first[d] + self.n[d], a + span)
        start, size = np.full(len(a), -1, np.int64), np.zeros(len(a), np.int64)
        for shift in range(span):  # the run's start, counted from the earliest that takes in the place
            s = np.minimum(lo + shift, a)
            e = np.minimum(s + span, hi)
            ok = start < 0
            for t, c in need.items():
                p = self.lists[t]
                ok &= np.searchsorted(p, e) - np.searchsorted(p, s) >= c
            start[ok], size[ok] = s[ok], (e - s)[ok]
        return start[start >= 0], size[start >= 0]


def _counts(index: DataFrame, vocab: dict[bytes, int]) -> dict[int, int]:
    """How often the corpus holds each term of vocab: a row for each at most."""
    sent = index.sparkSession.sparkContext.broadcast(list(vocab))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.binary())
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                number, at, ptr = _known(b, i, known)
                total[number] += np.diff(ptr)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    got = in_arrow(index.select("terms", "ptr"), run, "term int, n long").groupBy("term").agg(F.sum("n")).collect()
    sent.unpersist()
    return dict(map(tuple, got))


def _blocks(bench: DataFrame, most_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The test items in blocks of at most most_bytes of text (one item at least): the bound of what is broadcast."""
    held, size = [], 0
    for r in bench.select(F.col("item_id").cast("string"), F.col("text").cast("string").cast("binary")).toLocalIterator():
        if held and size + len(r[1] or b"") > most_bytes:
            yield held
            held, size = [], 0
        held.append((r[0], bytes(r[1]) if r[1] is not None else None))
        size += len(r[1] or b"")
    yield held


def _runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    step = np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))
    return np.flatnonzero(step > 0), np.flatnonzero(step < 0)


class _Items:
    """Distinct (document, item) pairs: folded as they come, so a passage that many items and documents share costs its pairs once."""

    def __init__(self, n_items: int):
        self.n, self.held, self.size, self.seen = max(1, n_items), [], 0, np.empty(0, np.int64)

    def add(self, docs: np.ndarray, items: np.ndarray) -> None:
        step = max(1, FOLD // max(1, len(items)))
        for at in range(0, len(docs), step):
            x = (docs[at : at + step, None] * self.n + items).ravel()
            self.held.append(x)
            self.size += len(x)
            if self.size >= FOLD:
                self.fold()

    def fold(self) -> np.ndarray:
        if self.held:
            self.seen = np.unique(np.concatenate([self.seen, *self.held]))
            self.held, self.size = [], 0
        return self.seen

    def lists(self, n_docs: int, names: pa.Array, without: np.ndarray | None = None) -> pa.Array:
        """Each document's items; names are sorted, and so are a document's."""
        x = self.fold()
        if without is not None:
            x = np.setdiff1d(x, without, assume_unique=True)
        ends = np.searchsorted(x, (np.arange(n_docs) + 1) * self.n)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), names.take(pa.array(x % self.n)))


FOUND = "row long, doc_id long, n_words long, items array<string>, spans array<struct<start:int,stop:int>>, near_items array<string>"


def search(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """FOUND of every document of the index: items with a window word for word, the merged spans of words in
    such windows, and, with slop, further items that have all words of a window close together."""
    sent = index.sparkSession.sparkContext.broadcast((list(phrases.vocab), phrases.names, phrases.windows, phrases.items, phrases.by_rarest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, names, windows, items, by_rarest = sent.value
        names, vocab = pa.array(names, pa.string()), pa.array(vocab, pa.binary())
        for b in batches:
            for i in range(b.num_rows):
                seg = Segment(b, i, vocab)
                cover = np.zeros(seg.total + 1, np.int32)
                exact, close = _Items(len(names)), _Items(len(names))
                for term in seg.lists:
                    for k, offs in by_rarest.get(term, ()):
                        starts = seg.exact(windows[k], offs)
                        if len(starts):
                            np.add.at(cover, starts, 1)
                            np.add.at(cover, starts + len(windows[k]), -1)
                            exact.add(np.unique(np.searchsorted(seg.first, starts, side="right") - 1), items[k])
                        if slop is not None:
                            starts = seg.near(windows[k], offs, slop)[0]
                            if len(starts):
                                close.add(np.unique(np.searchsorted(seg.first, starts, side="right") - 1), items[k])
                n = len(seg.first)
                start, stop = _runs(np.cumsum(cover) > 0)
                doc = np.searchsorted(seg.first, start, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array((start - seg.first[doc]).astype(np.int32)), pa.array((stop - seg.first[doc]).astype(np.int32))], names=["start", "stop"])
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int32)
                out = [seg.rows, seg.docs, pa.array(seg.n.astype(np.int64)), exact.lists(n, names), pa.ListArray.from_arrays(pa.array(ends), spans), close.lists(n, names, exact.fold())]
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "n_words", "items", "spans", "near_items"])

    return in_arrow(index, run, FOUND)


def _united(spans: Column) -> Column:
    """Overlapping or touching spans as one."""
    far = F.array_sort(spans)
    put = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(far, F.slice(far, 1, 0), put)


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, slop: int | None = None, least_share: int = 20, most_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of docs: row, doc_id, n_words, n_hit, items, spans, near_items, contaminated.

    A document's words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. Windows
    are n consecutive words of an item; an item of fewer, but not none, is one window. items (sorted
    as strings) are those of which the document holds a window word for word, spans the runs
    [start, stop) of words inside such windows, n_hit their words; contaminated is n_hit > 0 and
    least_share * n_hit >= n_words. With slop, near_items are further items that have all words of a
    window, in any order, within its length + slop words. Null or empty text has no words; a null
    doc_id stays null; repeated rows give a row each; an empty bench gives no hits, empty docs no
    rows. The index is built once; test text beyond most_bytes is searched in it block by block, and
    the hits are put together by row.
    """
    return lookup(build_index(_numbered(docs, F.monotonically_increasing_id())), bench, n, slop, least_share, most_bytes)


def _numbered(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def lookup(index: DataFrame, bench: DataFrame, n: int = 13, slop: int | None = None, least_share: int = 20, most_bytes: int = 16 << 20) -> DataFrame:
    """contamination() of the documents of an index that is there already."""
    out, many = None, False
    for items in _blocks(bench, most_bytes):
        phrases = Phrases(items, n)
        phrases.order(_counts(index, phrases.vocab))
        found = search(index, phrases, slop)
        # a second block means that the first one's result must be kept while the driver goes on
        many = many or out is not None
        out = found if out is None else save(out, "hits").unionByName(save(found, "hits"))
    if many:
        out = out.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), _united(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
        out = out.withColumn("near_items", F.array_except("near_items", "items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    out = out.withColumn("n_hit", hit)
    return out.select("row", "doc_id", "n_words", "n_hit", "items", "spans", "near_items", ((F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each span."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def _cut(docs: DataFrame, bench: DataFrame, n: int, least_share: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs without a hit, rows that were cut and not dropped), saved."""
    numbered = save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    index = build_index(_numbered(numbered, F.col("__row")))
    hit = lookup(index, bench, n, None, least_share).where("n_hit > 0")
    hit = save(hit.select(F.col("row").alias("__row"), F.col("contaminated").alias("__bad"), F.col("spans").alias("__spans")), "hits")
    forget(index)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [cut_words(t.as_py(), [(s["start"], s["stop"]) for s in spans.as_py()]) for t, spans in zip(b.column(at), b.column(len(names)), strict=True)]
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    x = in_arrow(numbered.join(hit.where("not __bad"), "__row").select(*names, "__spans"), run, StructType(docs.schema.fields))
    if "n_chars" in names:
        x = x.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    cut = save(x.select(*names), "cut")
    return numbered.join(hit, "__row", "left_anti").select(*names), cut


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 13, least_share: int = 20) -> DataFrame:
    """docs without its contaminated rows; of the others' texts every hit span is cut out, and n_chars, if there, follows.

    Cutting can bring words together that hold a window again, so what was cut is searched again
    until nothing is hit; a text gets shorter each time, so this ends. Rows that are contaminated
    then go too. Rows without a hit stay as they are, null and empty texts and null ids among them.
    """
    clean, cut = _cut(docs, bench, n, least_share)
    while cut.head(1):
        more, again = _cut(cut, bench, n, least_share)
        clean = clean.unionByName(more)
        forget(cut)
        cut = again
    return clean


ORACLE = r"""
with w as (select rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
           from (select *, row_number() over () as rn from documents)),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, len, array_to_string(ws[s : s + len - 1], ' ') as gram
        from (select item_id, ws, least(13, len(ws)) as len, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) as s from b where len(ws) > 0)),
lens as (select distinct len from win),
g as (select rn, s, len, array_to_string(ws[s : s + len - 1], ' ') as gram
      from (select rn, ws, len, unnest(range(1, greatest(len(ws) - len, -1) + 2)) as s from w cross join lens where len(ws) >= len)),
m as (select rn, s, g.len, item_id from g join win on g.len = win.len and g.gram = win.gram),
h as (select rn, count(distinct p) as n_hit from (select rn, unnest(range(s, s + len)) as p from m) group by rn),
i as (select rn, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct rn, item_id from m) group by rn)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws)) as contaminated
from w left join h using (rn) left join i using (rn)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity half: items with all words of a window, in any order, within its length + SLOP words of a document that
    holds none of the item's windows word for word. A query of its own, as op2_decontamination's columns are those of its SQL."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    near = F.array_join("near_items", ",")
    return out.select("doc_id", "n_words", F.size("near_items").cast("long").alias("n_near"), F.sha2(near.cast("binary"), 256).alias("near_sha256"))
