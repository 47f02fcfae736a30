"""Web-archive records and the resolution of not-modified revisits.

A revisit (a 304 answer) stores no body: it stands for the latest earlier full response of the same canonical URL. The
resolution is an as-of join by canonical URL and time, in DataFrame operations alone:

1. URLs are made canonical (canonical_url()).
2. Time is cut into SPANS spans of about as many records each (a bad date far away costs no more than its own span). Within (URL, span) a window finds the latest full response before each revisit; the last
   response of each (URL, span) is a pre-aggregate, and a window over at most SPANS rows of a URL carries it to later spans. So
   a URL with a third of all records is dealt over many tasks.
3. The validators decide: equal entity tags (compared weakly) if both have one, else equal Last-Modified if both have one, else
   equal payload digests if both have one; without any common validator, or if it differs, the revisit stays unresolved.
4. A resolved revisit has the response's headers, replaced by its own where a 304 may update them (all but PINNED), and the
   response's body.

Ties: of responses at one time the one of the largest id counts; a response at a revisit's own time is not earlier. Records
without URL or time resolve nothing and stay unresolved. Repeated revisits give a row each; of repeated response rows of one
id the latest gives headers and body, then the one of the greatest validators, length and hash of the body. Bodies of any length are
carried as they are.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import ship

#: Spans of time.
SPANS = 256
#: Partitions' worth of salts for unresolved revisits in the join with the bodies.
SALTS = 1024
#: Bytes of bodies in a batch of records read from files.
READ_BYTES = 8 << 20
#: Headers of the stored response that a 304 must not change (fixed values).
PINNED = (
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that do not choose the content (fixed values), as a pattern.
NOISE = "^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, noise parameters and final slash; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(bare, "^([^?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(path, "^([^/]*)", 1)), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(path, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(NOISE)))
    return F.concat(host, rest, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _tag(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^W/", ""), '^"|"$', "")


def resolve_revisits(records: DataFrame, spans: int = SPANS) -> DataFrame:
    """A row for each revisit: id, url, canonical, time, response_id, verdict, headers, body, n_bytes.

    records: id, url, time (long), revisit (boolean), etag, last_modified, digest (strings), headers (map, lower-case names),
    body. verdict: resolved, no response, no validator, changed. Unresolved rows have their own headers and no body.
    """
    rows = records.select(
        "id", "url", canonical_url(F.col("url")).alias("canonical"), F.col("time").cast("long").alias("time"), F.coalesce("revisit", F.lit(False)).alias("revisit"),
        _tag(F.col("etag")).alias("etag"), "last_modified", "digest", "headers",
    )
    at = F.array(*(F.lit(k / spans) for k in range(1, spans)))
    cuts = sorted(set(rows.agg(F.percentile_approx("time", at, 2000)).first()[0] or [])) if spans > 1 else []  # at most spans - 1 numbers
    span = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)), lambda c: c <= F.col("time"))) if cuts else F.lit(0)
    rows = rows.withColumn("span", F.when(F.col("time").isNotNull(), span))
    mark = F.struct("time", "id", "etag", "last_modified", "digest")
    usable = F.col("canonical").isNotNull() & F.col("time").isNotNull()
    full = rows.where(usable & ~F.col("revisit"))
    # within a span: the last response before each row; at one time revisits come first, then responses by id
    order = Window.partitionBy("canonical", "span").orderBy("time", F.when(F.col("revisit"), 0).otherwise(1), "id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.where(usable).withColumn("inner", F.last(F.when(~F.col("revisit"), mark), ignorenulls=True).over(order)).where("revisit")
    # between spans: the last response of each span, carried on
    last = full.groupBy("canonical", "span").agg(F.max(mark).alias("m"))
    ends = last.select("canonical", "span", "m").unionByName(near.select("canonical", "span").distinct().withColumn("m", F.lit(None).cast(last.schema["m"].dataType)))
    ends = ends.groupBy("canonical", "span").agg(F.max("m").alias("m"))
    before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("outer", F.last("m", ignorenulls=True).over(before)).select("canonical", "span", "outer")
    found = near.join(carried, ["canonical", "span"], "left").withColumn("r", F.coalesce("inner", "outer")).drop("inner", "outer")
    found = found.unionByName(rows.where(~usable & F.col("revisit")).withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))
    r = lambda name: F.col(f"r.{name}")
    verdict = (
        F.when(r("id").isNull(), "no response")
        .when(F.col("etag").isNotNull() & r("etag").isNotNull(), F.when(F.col("etag") == r("etag"), "resolved").otherwise("changed"))
        .when(F.col("last_modified").isNotNull() & r("last_modified").isNotNull(), F.when(F.col("last_modified") == r("last_modified"), "resolved").otherwise("changed"))
        .when(F.col("digest").isNotNull() & r("digest").isNotNull(), F.when(F.col("digest") == r("digest"), "resolved").otherwise("changed"))
        .otherwise("no validator")
    )
    found = found.withColumn("verdict", verdict).withColumn("response_id", F.when(F.col("verdict") == "resolved", r("id")))
    bodies = records.where(~F.coalesce("revisit", F.lit(False))).groupBy(F.col("id").alias("response_id")).agg(
        F.max_by(F.struct("headers", "body"), F.struct("time", "etag", "last_modified", "digest", F.octet_length("body"), F.xxhash64("body"))).alias("full")
    )
    bodies = bodies.select("response_id", F.lit(0).alias("salt"), F.col("full.headers").alias("stored"), "full.body")
    # a response that many revisits stand for is a hot key on the left side only, which adaptive execution splits; unresolved rows
    # meet nothing and are dealt by a salt instead of meeting in one partition
    found = found.withColumn("salt", F.when(F.col("response_id").isNull(), F.pmod(F.xxhash64("id", "url", "time"), F.lit(SALTS)).cast("int")).otherwise(0))
    out = found.join(bodies, ["response_id", "salt"], "left")
    own = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*PINNED))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(own, k))
    headers = F.when(F.col("response_id").isNotNull() & F.col("stored").isNotNull(), F.map_concat(kept, own)).otherwise(F.col("headers"))
    return out.select(
        "id", "url", "canonical", "time", "response_id", "verdict", headers.alias("headers"), "body", F.octet_length("body").cast("long").alias("n_bytes")
    )


# --- files -------------------------------------------------------------------------------------------------------------


def write_record(kind: str, url: str, date: str, headers: dict[str, str], body: bytes, status: str = "200 OK") -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def _head(f: io.BufferedIOBase) -> tuple[str, dict[str, str]]:
    first, fields = f.readline().decode("utf-8", "replace").strip(), {}
    while (line := f.readline().decode("utf-8", "replace").rstrip("\r\n")):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def parse_records(data: bytes | pa.Buffer) -> Iterator[tuple[str, str | None, str | None, int | None, dict[str, str], bytes]]:
    """(type, url, date, status, headers, body) of the response and revisit records of a file, gzipped or not, read as a stream."""
    raw = pa.BufferReader(data)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw) if bytes(memoryview(data)[:2]) == b"\x1f\x8b" else raw)
    while True:
        first, fields = _head(f)
        if not first and not fields:
            if not f.read(1):
                return
            continue
        block = f.read(int(fields.get("content-length", 0)))
        f.readline(), f.readline()
        kind = fields.get("warc-type", "")
        if kind in ("response", "revisit"):
            inner = io.BytesIO(block)
            status, headers = _head(inner)
            code = status.split(" ")[1] if status.startswith("HTTP/") and " " in status else ""
            yield kind, fields.get("warc-target-uri"), fields.get("warc-date"), int(code) if code.isdigit() else None, headers, inner.read()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: id (file and place), url, time (seconds), revisit, etag, last_modified, digest, headers, body.

    A file is one task's work: its compressed bytes (under 2 GB, as Spark reads binary files) and one batch of about READ_BYTES of
    bodies are in memory at a time.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["id", "url", "date", "revisit", "etag", "last_modified", "digest", "headers", "body"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in batches:
            for name, data in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                rows, size = [], 0
                for k, (kind, url, date, _, h, body) in enumerate(parse_records(data.as_buffer())):
                    digest = None if kind == "revisit" else hashlib.sha1(body).hexdigest()
                    rows.append((f"{name}#{k}", url, date, kind == "revisit", h.get("etag"), h.get("last-modified"), digest, list(h.items()), body))
                    size += len(body)
                    if size >= READ_BYTES or len(rows) >= 10_000:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "id string, url string, date string, revisit boolean, etag string, last_modified string, digest string, headers map<string,string>, body binary")
    return rows.withColumn("time", F.unix_timestamp(F.try_to_timestamp("date"))).drop("date")


# --- the pages table as a crawl ----------------------------------------------------------------------------------------

#: Places in the crawl after which a page is asked for again.
AGAIN = 500


def crawl(pages: DataFrame, again: int = AGAIN) -> DataFrame:
    """Records of a crawl that fetches page_id at time 2 * page_id and asks for it again `again` pages later, with its entity tag.

    The second visit is a 304: if another page of the same canonical URL came between, its validator no longer fits.
    """
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    head = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    first = pages.select(
        F.col("page_id").alias("id"), "url", (F.col("page_id") * 2).alias("time"), F.lit(False).alias("revisit"), F.concat(F.lit('"'), tag, F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        head("content-type", "text/html", "content-length", size, "cache-control", "max-age=60").alias("headers"), F.coalesce("html", F.lit("")).alias("body"),
    )
    second = pages.select(
        F.col("page_id").alias("id"), "url", (F.col("page_id") * 2 + 2 * again + 1).alias("time"), F.lit(True).alias("revisit"), F.concat(F.lit('W/"'), tag, F.lit('"')).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        head("content-length", F.lit("0"), "cache-control", "max-age=600", "age", F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(second)
