"""Not-modified revisits of a web crawl: each is resolved to the latest earlier full response for its URL.

The as-of join is a window over captures in order of time. A URL with very many captures is dealt over bins of
time: within a bin the window finds the latest response; what earlier bins leave over is one row per bin.

A revisit is `resolved` if a validator of both captures agrees (the ETag, compared weakly; without one in both, the
Last-Modified), `mismatch` if it doesn't, `unvalidated` if they have none in common, `no_response` if no full
response is earlier. A resolved one gets the response's headers, with those that a 304 may update taken from it.

Defined results: a capture with a null URL or time, or a revisit before every response, is `no_response`; a response
at the same time isn't earlier; of responses at one time the one with the greatest record_id counts; null headers
are no headers; repeated rows are resolved each on its own; an empty table gives an empty result; other columns
are not read by resolve.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BIN = 4096
#: Header fields that a 304 response may update.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning"]
#: Query parameters that don't name another document.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid|sid)(=|$)"

#: Bytes that are unpacked at a time.
STEP = 1 << 20
PROBLEM = "path string, problem string"
CAPTURE = "record_id string, kind string, url string, time long, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a closing slash, query sorted without tracking
    parameters; scheme and fragment dropped."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda q: (q != "") & ~F.lower(q).rlike(TRACKING))
    joined = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")))


def resolve(captures: DataFrame, bin_width: int = BIN) -> DataFrame:
    """captures (record_id, kind 'response' or 'revisit', url, time long, headers map with lower-case names).

    One row per revisit: record_id, canonical_url, response_id, outcome and headers (merged; its own if not resolved).
    """
    none = F.create_map().cast("map<string,string>")
    rows = captures.select(
        "record_id", (F.col("kind") == "revisit").alias("revisit"), canonical_url(F.col("url")).alias("canonical_url"), "time", F.coalesce("headers", none).alias("headers")
    ).withColumn("bin", F.floor(F.col("time") / bin_width))
    response = F.when(~F.col("revisit"), F.struct("time", "record_id", "headers"))
    known = rows.where("canonical_url is not null and time is not null")
    order = Window.partitionBy("canonical_url", "bin").orderBy("time", F.col("revisit").desc(), "record_id")
    here = known.withColumn("seen", F.last(response, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("revisit")
    left = known.where("not revisit").groupBy("canonical_url", "bin").agg(F.max_by(F.struct("time", "record_id", "headers"), F.struct("time", "record_id")).alias("left"))
    bins = known.groupBy("canonical_url", "bin").agg(F.count_if(F.col("revisit")).alias("asks")).join(left, ["canonical_url", "bin"], "left")
    carried = bins.withColumn(
        "carried", F.last("left", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    ).where("asks > 0")
    found = here.join(carried.select("canonical_url", "bin", "carried"), ["canonical_url", "bin"]).select(
        "record_id", "canonical_url", "headers", F.coalesce("seen", "carried").alias("r")
    )
    unknown = rows.where("revisit and (canonical_url is null or time is null)").select(
        "record_id", "canonical_url", "headers", F.lit(None).cast(found.schema["r"].dataType).alias("r")
    )
    weak = lambda m: F.regexp_replace(F.element_at(m, "etag"), r"^[Ww]/", "")
    mine, its = F.col("headers"), F.col("r.headers")
    modified = F.element_at(mine, "last-modified") == F.element_at(its, "last-modified")
    agree = F.coalesce(weak(mine) == weak(its), modified)
    outcome = F.when(F.col("r").isNull(), "no_response").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")
    update = F.map_filter(mine, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(its, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    return (
        found.unionByName(unknown)
        .withColumn("outcome", outcome)
        .select("record_id", "canonical_url", F.col("r.record_id").alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", merged).otherwise(mine).alias("headers"))
    )


def inflated(data: bytes) -> Iterator[bytes | str]:
    """The content of a file, plain or in gzip members, in steps of STEP bytes; a text in between tells of a broken member, behind which the next is looked for."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, end, problem = zlib.decompressobj(wbits=31), at, ""
        try:
            while not member.eof and end < len(data):
                part = view[end : end + STEP]
                end += len(part)
                rest = part
                while len(rest) and not member.eof:
                    yield member.decompress(rest, STEP)
                    rest = member.unconsumed_tail
            problem = "" if member.eof else "a gzip member ends too soon"
        except zlib.error as e:
            problem = f"a gzip member is broken: {e}"
        if problem:
            yield f"{problem} (at byte {at})"
        at = data.find(b"\x1f\x8b\x08", at + 1 if problem else end - len(member.unused_data))


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, gzip or plain: response and revisit records with their HTTP headers and payload.

    What can't be read gives a row with its problem only, and reading goes on behind it: a broken or truncated gzip member, a
    record that ends too soon or has no length. A capture whose date can't be read keeps a null time. One record and STEP bytes
    more are held at a time.
    """
    held, parts, ended = bytearray(), inflated(data), False

    def more() -> Iterator[dict]:
        nonlocal ended, held
        part = next(parts, None)
        if part is None:
            ended = True
        elif isinstance(part, str):
            left = bytes(held)
            held = bytearray()
            yield {"problem": part + ("; a record is lost with it" if left.strip() else "")}
        else:
            held += part

    while True:
        at = held.find(b"WARC/1.")
        head_end = held.find(b"\r\n\r\n", at) if at >= 0 else -1
        if head_end < 0:
            if ended:
                if at >= 0:
                    yield {"problem": "a record's head ends too soon"}
                elif held.strip():
                    yield {"problem": f"{len(held)} bytes hold no record"}
                return
            if at < 0:
                del held[: max(0, len(held) - 6)]
            yield from more()
            continue
        fields = _fields(bytes(held[at:head_end]))
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield {"problem": f"a record's length can't be read: {length[:40]!r}"}
            del held[: head_end + 4]
            continue
        stop = head_end + 4 + int(length)
        problems = []
        while len(held) < stop and not ended and not problems:
            problems = list(more())
        if len(held) < stop:
            yield from problems or [{"problem": "a record ends too soon"}]
            if not problems:
                del held[: head_end + 4]
            continue
        body = bytes(held[head_end + 4 : stop])
        del held[:stop]
        if fields.get("warc-type") in ("response", "revisit"):
            http, _, payload = body.partition(b"\r\n\r\n")
            status = http.split(b"\r\n", 1)[0].split(b" ")
            when = pd.to_datetime(fields.get("warc-date"), errors="coerce", utc=True)
            yield {
                "record_id": fields.get("warc-record-id"),
                "kind": fields["warc-type"],
                "url": fields.get("warc-target-uri"),
                "time": None if when is None or pd.isna(when) else int(when.timestamp() // 1),
                "status": int(status[1]) if len(status) > 1 and re.fullmatch(rb"[0-9]{3}", status[1]) else None,
                "headers": _fields(http),
                "payload": payload,
            }


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace").strip() for k, sep, v in pairs if sep}


def record(kind: str, record_id: str, url: str, time: int, status: int, headers: dict[str, str], payload: bytes = b"") -> bytes:
    """One WARC record, gzipped by itself as the format asks."""
    http = f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    body = http.encode() + payload
    when = pd.Timestamp(time, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {when}\r\nContent-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(wbits=31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def _read(spark: SparkSession, path: str, problems: bool) -> DataFrame:
    schema = PROBLEM if problems else CAPTURE
    names = [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("time", "status") if c in names})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                held, size = [], 0
                for r in parse(bytes(content)):
                    if ("problem" in r) == problems:
                        held.append({"path": file} | r)
                        size += len(r.get("payload", b""))
                    if size > STEP or len(held) > 1000:
                        yield frame(held)
                        held, size = [], 0
                if held:
                    yield frame(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The captures in the WARC files at path; a task reads whole files. What is broken is left out; see read_problems."""
    return _read(spark, path, False)


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """What read_warc leaves out of the files at path: path, problem."""
    return _read(spark, path, True)


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl log made from pages (page_id, url, html): a response for each, a later revisit, and for some an earlier one.

    Every seventh revisit has another ETag, every fifth only a Last-Modified, every thirteenth no validator.
    """
    page, url = F.col("page_id"), F.coalesce("url", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = F.concat(F.lit("day "), (page % 1000).cast("string"))
    full = F.map_from_arrays(
        F.array(*map(F.lit, ["etag", "last-modified", "content-type", "cache-control", "content-length"])),
        F.array(tag, modified, F.lit("text/html"), F.lit("max-age=60"), F.length(F.coalesce("html", F.lit(""))).cast("string")),
    )
    small = F.map_from_arrays(
        F.array(*map(F.lit, ["etag", "last-modified", "cache-control", "content-length"])),
        F.array(F.when(page % 7 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)), modified, F.lit("max-age=3600"), F.lit("0")),
    )
    small = F.map_filter(small, lambda k, _: ~((page % 13 == 0) & k.isin("etag", "last-modified")) & ~((page % 5 == 0) & (k == "etag")))
    row = lambda kind, n, u, time, headers: F.struct(
        (page * 3 + n).alias("record_id"), F.lit(kind).alias("kind"), u.alias("url"), time.cast("long").alias("time"), headers.alias("headers")
    )
    rows = F.array(
        row("response", 0, url, page * 10, full),
        row("revisit", 1, F.concat(url, F.lit("#again")), page * 10 + 5, small),
        row("revisit", 2, url, page * 10 - F.when(page % 11 == 0, 1).otherwise(-7), small),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, md5(coalesce(html, '')) AS tag FROM pages),
c AS (
  SELECT page_id, url, tag, regexp_replace(trim(regexp_replace(url, '#.*$', '')), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
u AS (
  SELECT page_id, tag,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid|sid)(=|$)'))) AS q
  FROM c),
k AS (SELECT page_id, tag, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM u),
r AS (SELECT page_id * 3 AS rid, canonical_url, page_id * 10 AS t, tag, page_id % 1000 AS day FROM k),
v AS (
  SELECT page_id, page_id * 3 + 1 AS record_id, canonical_url, page_id * 10 + 5 AS t, tag FROM k
  UNION ALL
  SELECT page_id, page_id * 3 + 2, canonical_url, page_id * 10 - CASE WHEN page_id % 11 = 0 THEN 1 ELSE -7 END, tag FROM k),
j AS (
  SELECT v.page_id, v.record_id, v.canonical_url, v.tag AS vtag, r.rid, r.tag AS rtag, r.day,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.t DESC, r.rid DESC) AS n
  FROM v LEFT JOIN r ON r.canonical_url = v.canonical_url AND r.t < v.t),
a AS (
  SELECT record_id, canonical_url, rid AS response_id, rtag, vtag, page_id,
    CASE WHEN page_id % 5 = 0 OR page_id % 13 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'other' ELSE vtag END AS etag,
    CASE WHEN page_id % 13 = 0 THEN NULL ELSE page_id % 1000 = day END AS same_day
  FROM j WHERE n = 1),
o AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                 WHEN coalesce(etag = rtag, same_day) IS NULL THEN 'unvalidated'
                 WHEN coalesce(etag = rtag, same_day) THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM a)
SELECT record_id, canonical_url, response_id, outcome,
  CASE WHEN etag = 'other' THEN '"other"' WHEN etag IS NOT NULL THEN 'W/"' || etag || '"' WHEN outcome = 'resolved' THEN '"' || rtag || '"' END AS etag,
  'max-age=3600' AS cache_control,
  CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type
FROM o
"""
