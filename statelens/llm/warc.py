"""WARC records, and the resolution of not-modified revisits.

A server-not-modified revisit holds no body: an as-of join by canonical URL finds the latest
earlier full response, the validators are compared, and the stored response's headers are
updated with those a 304 may carry.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import in_arrow, save, shuffle_parts, table

#: Header fields that a 304 response carries for the stored one (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Statuses of responses without a whole body.
PARTIAL = (206, 304)
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)="


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host lower-cased without a default port, tracking parameters and fragment
    dropped, the other parameters sorted, no slash at the path's end. Null, or no ://, stays null."""
    rest = F.regexp_extract(url, r"^[^:/?#]*://([^#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per row of records: record_id, canonical, type, outcome, ref_id, status, headers, digest.

    records: record_id, url, date (any ordered type), type (`response` or `revisit`, other
    types pass through), status int, headers map<string,string>, digest (of the payload), and, if
    there, profile (the WARC-Profile) and truncated (the WARC-Truncated reason).

    A response is full if it has a status other than 304 and 206, which bring no whole body, and
    isn't truncated. Earlier is smaller by (date, record_id), and of equal ones a full response
    comes before a revisit; of several full responses of one (date, record_id) the one of the greatest
    digest, then status, then headers counts (null is smallest), whatever the order of the rows.

    A revisit is of one of two kinds by its profile: `identical-payload-digest` brings headers of its own
    and lacks the payload only, any other one, or none, is server-not-modified. Its response is the
    latest earlier full one of its canonical URL; which record it names as its original isn't asked.
    outcome: `full` for other records than revisits; for a revisit `orphan` (no earlier full response
    of its canonical URL, or no URL or date), `mismatch` (a validator differs: ETag by weak comparison,
    Last-Modified where no ETag is on both sides, or digest where both have one; of an
    identical payload the digest only), `unchecked` (nothing to compare) or `resolved`. The last two take the
    response's digest; a server-not-modified one its status too, and its headers, with `permitted` fields (names in
    lower case) of the revisit put over them, while an identical payload keeps its own status and headers.
    ref_id is the response's id, and is given for a mismatch too. Of header names that differ in
    case only one stays. Null headers are empty. Repeated rows each give a row. Empty tables give no rows.

    A URL that a third of all records share is dealt out by ranges of (url, date): windows run
    inside a range, and what a range needs of the ones before it is one row per range and URL.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    given = lambda c: F.col(c).cast("string") if c in records.columns else F.lit(None).cast("string")
    x = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "date", "type", "status", F.coalesce(_first_keys(F.col("headers")), none).alias("headers"), "digest", given("profile").alias("profile"), given("truncated").alias("truncated"))
    whole = F.coalesce((F.col("type") == "response") & ~F.col("status").isin(*PARTIAL) & F.col("truncated").isNull(), F.lit(False))
    # what orders full responses of one date and id, and headers are compared by
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "\n")
    x = x.withColumn("whole", whole).withColumn("tie", F.struct("digest", "status", text.alias("text")))
    by = ["date", "record_id"]
    parts = shuffle_parts(x.sparkSession)
    keyed = x.where("canonical is not null and date is not null")
    keyed = save(keyed.repartitionByRange(parts, "canonical", *by).withColumn("part", F.spark_partition_id()), "records")
    # rows of one (date, record_id) are in one range: a full response stands before other records, the greatest tie last of the full ones
    order = [*map(F.col, by), F.col("whole").desc(), F.col("tie").asc()]
    full = F.when(F.col("whole"), F.struct("record_id", "status", "headers", "digest"))
    inside = Window.partitionBy("part", "canonical").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = keyed.withColumn("before", F.last(full, ignorenulls=True).over(inside))
    ends = keyed.where("whole").groupBy("canonical", "part").agg(F.max_by(F.struct("record_id", "status", "headers", "digest"), F.struct("date", "record_id", "tie")).alias("last"))
    spans = keyed.groupBy("canonical", "part").agg(F.count("*").alias("n")).join(ends, ["canonical", "part"], "left")
    carry = spans.select("canonical", "part", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry")).where("carry is not null")
    got = got.join(carry, ["part", "canonical"], "left").withColumn("ref", F.when(F.col("type") == "revisit", F.coalesce("before", "carry"))).drop("part", "before", "carry", "n")
    lost = x.where("canonical is null or date is null").withColumn("ref", F.lit(None).cast(got.schema["ref"].dataType))
    y = got.unionByName(lost)

    same_payload = F.coalesce(F.col("profile").contains("identical-payload-digest"), F.lit(False))
    tag, ref_tag = _tag(F.col("headers")["etag"]), _tag(F.col("ref.headers")["etag"])
    time, ref_time = F.col("headers")["last-modified"], F.col("ref.headers")["last-modified"]
    by_tag, by_time, by_digest = ~same_payload & tag.isNotNull() & ref_tag.isNotNull(), ~same_payload & time.isNotNull() & ref_time.isNotNull(), F.col("digest").isNotNull() & F.col("ref.digest").isNotNull()
    differs = (by_tag & (tag != ref_tag)) | (~by_tag & by_time & (time != ref_time)) | (by_digest & (F.col("digest") != F.col("ref.digest")))
    outcome = (
        F.when(F.coalesce(F.col("type") != "revisit", F.lit(True)), "full")
        .when(F.col("ref").isNull(), "orphan")
        .when(F.coalesce(differs, F.lit(False)), "mismatch")
        .when(~(by_tag | by_time | by_digest), "unchecked")
        .otherwise("resolved")
    )
    y = y.withColumn("outcome", outcome).withColumn("takes", F.col("outcome").isin("resolved", "unchecked")).withColumn("merges", F.col("takes") & ~same_payload)
    update = F.map_filter("headers", lambda k, v: k.isin(*permitted))
    stays = F.map_filter(F.col("ref.headers"), lambda k, v: ~F.array_contains(F.map_keys(update), k))
    return y.select(
        "record_id",
        "canonical",
        "type",
        "outcome",
        F.col("ref.record_id").alias("ref_id"),
        F.when(F.col("merges"), F.col("ref.status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("merges"), F.map_concat(stays, update)).otherwise(F.col("headers")).alias("headers"),
        F.when(F.col("takes"), F.coalesce("ref.digest", "digest")).otherwise(F.col("digest")).alias("digest"),
    )


def _first_keys(headers: Column) -> Column:
    """Names in lower case; of names that then clash the first in the map stays."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    whole = F.zip_with(F.sequence(F.lit(1), F.size(names)), names, lambda i, k: F.struct(i.alias("i"), k.alias("k")))
    first = F.filter(whole, lambda p: F.array_position(names, p["k"]) == p["i"])
    values = F.map_values(headers)
    return F.when(F.size(headers) > 0, F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], F.get(values, p["i"] - 1)))))


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """resolved with the payload (payloads: record_id, payload) of each record, or of the response it refers to."""
    own = F.when(F.col("outcome").isin("resolved", "unchecked"), F.col("ref_id")).otherwise(F.col("record_id"))
    p = payloads.select(F.col("record_id").alias("__id"), "payload")
    return resolved.drop("payload").withColumn("__of", own).join(p, F.col("__of") == F.col("__id"), "left").drop("__of", "__id")


RECORD = "record_id string, url string, date string, type string, status int, headers map<string,string>, digest string, profile string, truncated string, refers_to string, payload binary"
RECORD_PA = pa.schema([*((c, pa.string()) for c in ("record_id", "url", "date", "type")), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), *((c, pa.string()) for c in ("digest", "profile", "truncated", "refers_to")), ("payload", pa.binary())])
#: Bytes read from a file at once, and payload bytes in one batch of records (one record at least).
CHUNK, BATCH = 1 << 20, 4 << 20
#: How a gzip member starts.
MEMBER = b"\x1f\x8b\x08"


class _Lines:
    """A reader over an iterator of chunks that can push bytes back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def _more(self) -> bool:
        got = next(self.chunks, b"")
        self.held += got
        return bool(got)

    def readline(self) -> bytes:
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more():
                end = len(self.held) - 1
                break
        line, self.held = self.held[: end + 1], self.held[end + 1 :]
        return line

    def read(self, size: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < size and (got := next(self.chunks, b"")):
            parts.append(got)
            have += len(got)
        whole = b"".join(parts)
        self.held = whole[size:]
        return whole[:size]

    def back(self, raw: bytes) -> None:
        self.held = raw + self.held


def parse(stream: _Lines) -> Iterator[dict]:
    """The records of an uncompressed WARC stream.

    After a record of broken length, or bytes that are no record, reading goes on at the next line
    that starts with WARC/ followed by a digit; what is between is no record.
    """
    while True:
        line = stream.readline()
        while line and not (line.startswith(b"WARC/") and line[5:6].isdigit()):
            line = stream.readline()
        if not line:
            return
        head = _fields(stream)
        size = head.get("content-length", "")
        if not size.isdigit():
            continue
        body = stream.read(int(size))
        after = stream.read(4)
        if len(body) < int(size) or after.strip(b"\r\n"):
            # the length doesn't fit: the next record may begin inside what was taken for this one's body
            stream.back(body + after)
            continue
        status, http, payload = None, {}, body
        if "application/http" in head.get("content-type", "") and body.startswith(b"HTTP/"):
            inner = io.BytesIO(body)
            first = inner.readline().split(None, 2)
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            http, payload = _fields(inner), inner.read()
        names = {"record_id": "warc-record-id", "url": "warc-target-uri", "date": "warc-date", "type": "warc-type", "digest": "warc-payload-digest", "profile": "warc-profile", "truncated": "warc-truncated", "refers_to": "warc-refers-to"}
        yield {k: head.get(v) for k, v in names.items()} | {"status": status, "headers": http, "payload": payload}


def _plain(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks of a file, unpacked if it is gzip, member by member; a broken member ends where it breaks, and the next one is looked for."""
    first = next(chunks, b"")
    if first[:2] != b"\x1f\x8b":
        if first:
            yield first
        yield from chunks
        return
    held, unpack = first, zlib.decompressobj(31)
    while held or (held := next(chunks, b"")):
        try:
            out = unpack.decompress(held, CHUNK)
            held = unpack.unconsumed_tail if not unpack.eof else unpack.unused_data
        except zlib.error:
            out, at = b"", held.find(MEMBER, 1)
            while at < 0 and (more := next(chunks, b"")):
                held = held[-2:] + more  # a member's start may be cut in two
                at = held.find(MEMBER)
            held, unpack = held[at:] if at >= 0 else b"", zlib.decompressobj(31)
        else:
            if unpack.eof:
                unpack, held = zlib.decompressobj(31), held.lstrip(b"\0")
        if out:
            yield out


def _fields(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _batches(chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in parse(_Lines(_plain(chunks))):
        rows.append(r | {"headers": list(r["headers"].items())})
        size += len(r["payload"])
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD_PA)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RECORD_PA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (.warc, .warc.gz), a task for each file; record_id is the WARC-Record-ID, null where a field lacks.

    A file comes to its task in chunks (Spark's binary reader splits none, and holds one file's bytes at a
    time), is unpacked chunk by chunk, and leaves in batches: beside the packed file a task holds a
    few MB, or one record. Empty files give no records; after a broken record reading goes on at
    the next one. Files of over 2 GB are beyond Spark's reader: split them between records first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                whole = raw.as_buffer()  # no copy
                yield from _batches(whole.slice(at, min(CHUNK, whole.size - at)).to_pybytes() for at in range(0, whole.size, CHUNK))

    return in_arrow(spark.read.format("binaryFile").load(path).select("content"), run, RECORD)


def crawl_log(pages: DataFrame) -> DataFrame:
    """A crawl's records made of the page table: each page is a full response, and is asked for again later.

    The page of id p is answered at second 2p as record 2p, and revisited as record 2p + 1 at second
    2p + 7 with a 304. Of every seven pages one revisit holds another ETag, one only a
    Last-Modified, one a weak ETag, and one none. The digest is the MD5 of the page.
    Pages of null page_id have no record id or date and are left out, as in the SQL.
    """
    md5, at = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.col("page_id") * 2
    name = lambda n: F.concat(F.lit(n), F.col("page_id").cast("string"))
    text, kind = lambda s: F.lit(s), F.pmod(F.col("page_id"), F.lit(7))
    response = F.create_map(text("ETag"), F.concat(text('"'), md5, text('"')), text("Last-Modified"), name("m"), text("Content-Type"), text("text/html"), text("Date"), name("d"), text("Content-Length"), F.octet_length(F.coalesce("html", text(""))).cast("string"))
    common = (text("Date"), name("r"), text("Cache-Control"), text("max-age=60"), text("Content-Length"), text("0"))
    revisit = (
        F.when(kind == 1, F.create_map(text("ETag"), text('"other"'), *common))
        .when(kind == 2, F.create_map(text("Last-Modified"), name("m"), *common))
        .when(kind == 3, F.create_map(text("ETag"), F.concat(text('W/"'), md5, text('"')), *common))
        .when(kind == 4, F.create_map(*common))
        .otherwise(F.create_map(text("ETag"), F.concat(text('"'), md5, text('"')), *common))
    )
    full = F.struct(at.alias("record_id"), at.alias("date"), F.lit("response").alias("type"), F.lit(200).alias("status"), response.alias("headers"), md5.alias("digest"))
    again = F.struct((at + 1).alias("record_id"), (at + 7).alias("date"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), revisit.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return pages.where("page_id is not null").select("page_id", "url", F.explode(F.array(full, again)).alias("r")).select("page_id", "url", "r.*")


ORACLE = r"""
with p as (select page_id, url, coalesce(html, '') as html, md5(coalesce(html, '')) as h from pages where page_id is not null),
r as (select 2 * page_id as record_id, page_id, url, 2 * page_id as date, 'response' as type, 200 as status, '"' || h || '"' as etag, 'm' || page_id as lm, h as digest, strlen(html) as len from p
  union all select 2 * page_id + 1, page_id, url, 2 * page_id + 7, 'revisit', 304,
    case page_id % 7 when 1 then '"other"' when 2 then null when 3 then 'W/"' || h || '"' when 4 then null else '"' || h || '"' end,
    case when page_id % 7 = 2 then 'm' || page_id end, null, 0 from p),
u as (select *, regexp_extract(url, '^[^:/?#]*://([^#]*)', 1) as rest from r),
c as (select *, case when contains(url, '://') then
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|ref)='))), '&'), ''), '') end as canonical from u),
w as (select *, case when type = 'revisit' and canonical is not null then last_value(case when type = 'response' then {'id': record_id, 'page': page_id, 'status': status, 'etag': etag, 'lm': lm, 'digest': digest, 'len': len} end ignore nulls)
    over (partition by canonical order by date, record_id rows between unbounded preceding and 1 preceding) end as ref from c),
o as (select *, case when type <> 'revisit' then 'full' when ref is null then 'orphan'
    when etag is not null and regexp_replace(etag, '^W/', '') <> ref.etag then 'mismatch'
    when etag is null and lm is not null and lm <> ref.lm then 'mismatch'
    when etag is null and lm is null then 'unchecked' else 'resolved' end as outcome from w)
select record_id, canonical, type, outcome, ref.id as ref_id, (case when outcome in ('resolved', 'unchecked') then ref.status else status end)::int as status,
  case when outcome in ('resolved', 'unchecked') then ref.digest else digest end as digest,
  case when outcome in ('resolved', 'unchecked') then
      'cache-control=max-age=60;content-length=' || ref.len || ';content-type=text/html;date=r' || page_id || ';etag=' || coalesce(etag, ref.etag) || ';last-modified=' || ref.lm
    when type = 'response' then 'content-length=' || len || ';content-type=text/html;date=d' || page_id || ';etag=' || etag || ';last-modified=' || lm
    else 'cache-control=max-age=60;content-length=0;date=r' || page_id || coalesce(';etag=' || etag, '') || coalesce(';last-modified=' || lm, '') end as headers
from o
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_log(table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "canonical", "type", "outcome", "ref_id", "status", "digest", text.alias("headers"))
