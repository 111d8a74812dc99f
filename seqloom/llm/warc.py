"""WARC records and not-modified revisit resolution.

A revisit record says that a page had not changed: it has headers but no body.
It is resolved by an as-of join: by canonical URL to the latest full response
captured before it. The validators (entity tag, payload digest, modification
date) that both records have must agree; then the response's headers are
merged with those that a 304 answer may update.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm._spark import attach, materialize

#: Headers that a 304 answer may update in a stored response.
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "age", "last-modified")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: The seconds at which one URL was captured are dealt to tasks by spans of so many.
SPAN = 3600
RECORD = "record_id long, kind string, url string, ts long, headers map<string,string>, digest string, body binary"
#: What parse_warc gives: record_key is the whole WARC-Record-ID without its brackets; record_id its number, if to_warc wrote it; flaw what is wrong with the record (null: nothing).
PARSED = RECORD + ", record_key string, flaw string"
#: cut: the file or its compression ends early; length, date: the field is missing or no number or date; digest: the body has another.
FLAWS = ("cut", "length", "date", "digest")
#: Bytes of records that a task holds at a time, beside one record.
BATCH = 4 << 20
#: Dates as WARC/1.0 and 1.1 write them, of any precision from the year to parts of a second.
DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[Tt ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)?(?:[Zz]|([+-])(\d\d):?(\d\d))?)?)?)?")
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
NUMBERED = re.compile(r"urn:record:(-?\d{1,19})")


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters and last slash removed; host in lower case (null: empty)."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&+", "&"), r"[?&]+$", "")
    u = F.regexp_replace(u, r"\?&", "?")
    host = F.regexp_extract(u, r"^[^/?]*", 0)
    path = F.substring(u, F.length(host) + 1, F.length(u))
    return F.concat(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r":(80|443)$", ""), F.regexp_replace(path, r"/+$", ""))


def _seconds(date: str) -> int | None:
    """Seconds since 1970 of a WARC-Date (null if it is none); a number that is no year is such seconds, as _date() writes what has no date."""
    m = DATE.fullmatch(date)
    if not m:
        return int(date) if re.fullmatch(r"-?\d{1,18}", date) else None
    year, month, day, hour, minute, second = (int(x) if x else k for x, k in zip(m.groups()[:6], (0, 1, 1, 0, 0, 0), strict=True))
    try:
        at = datetime(year, month, day, hour, minute, min(second, 59), tzinfo=UTC)
    except ValueError:
        return None
    offset = (int(m[8]) * 3600 + int(m[9]) * 60) * (-1 if m[7] == "-" else 1) if m[7] else 0
    return (at - EPOCH) // timedelta(seconds=1) + (second == 60) - offset


def _date(ts: int | None) -> str | None:
    """ISO 8601 of seconds since 1970; beyond the years 1 to 9999, the seconds themselves."""
    if ts is None:
        return None
    try:
        return (EPOCH + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ").rjust(20, "0")
    except OverflowError:
        return str(ts)


def _number(key: str) -> int | None:
    m = NUMBERED.fullmatch(key)
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def to_warc(records: DataFrame, compress: bool = True) -> DataFrame:
    """record_id, content: each record as WARC/1.1 bytes, a gzip member of its own.

    The WARC-Record-ID is record_key where the records have one, else made of record_id.
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + [c for c in ("record_key",) if c in records.columns]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                revisit = r["kind"] == "revisit"
                http = ("HTTP/1.1 304 Not Modified" if revisit else "HTTP/1.1 200 OK") + "".join(f"\r\n{k}: {v}" for k, v in r["headers"] or [] if v is not None) + "\r\n\r\n"
                block = http.encode() + (b"" if revisit else r["body"] or b"")
                named = {"WARC-Type": r["kind"], "WARC-Record-ID": f"<{r.get('record_key') or 'urn:record:' + str(r['record_id'])}>", "WARC-Target-URI": r["url"], "WARC-Date": _date(r["ts"]), "WARC-Profile": PROFILE if revisit else None, "WARC-Payload-Digest": r["digest"], "Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
                head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None) + "\r\n"
                data = head.encode() + block + b"\r\n\r\n"
                out.append(gzip.compress(data, 1, mtime=0) if compress else data)
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(out, pa.binary())], names=["record_id", "content"])

    return records.select(*names).mapInArrow(render, "record_id long, content binary")


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs if k}


def _digest_differs(digest: str | None, body: bytes) -> bool:
    """Whether a digest (algorithm:value in base32 or hexadecimal digits) of a known algorithm is not that of the body."""
    name, _, value = (digest or "").partition(":")
    if name.lower().replace("-", "") not in ("sha1", "sha256", "md5", "sha512"):
        return False
    own = hashlib.new(name.lower().replace("-", ""), body).digest()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def _records(content: bytes, bodies: bool) -> Iterator[tuple]:
    """The rows of one file, read record by record: compressed members are inflated as they are reached."""
    raw = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = [line]
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                head.append(line)
            named = _fields(b"".join(head))
            kind, key, url = named.get("warc-type"), named.get("warc-record-id", "").strip("<>"), named.get("warc-target-uri")
            if url and url[0] == "<" and url[-1] == ">":
                url = url[1:-1]
            ts, size = _seconds(named.get("warc-date", "")), named.get("content-length", "")
            row = (_number(key), kind, url, ts, [], named.get("warc-payload-digest"), None, key or None)
            if not line or not re.fullmatch(r"\d{1,18}", size):
                yield *row, "length" if line else "cut"
                continue
            block = stream.read(int(size))
            if len(block) < int(size):
                yield *row, "cut"
                return
            if kind not in ("response", "revisit"):
                continue
            http, _, body = block.partition(b"\r\n\r\n")
            flaw = "date" if ts is None else "digest" if kind == "response" and _digest_differs(row[5], body) else None
            yield *row[:4], list(_fields(http).items()), row[5], body if bodies else None, row[7], flaw
    except (EOFError, zlib.error, gzip.BadGzipFile):
        yield None, None, None, None, [], None, None, None, "cut"


def parse_warc(files: DataFrame, bodies: bool = True, flawed: bool = False) -> DataFrame:
    """The response and revisit records in files(content), such as spark.read.format("binaryFile") gives; gzip or plain.

    ts: WARC-Date as seconds since 1970. record_key: WARC-Record-ID, as
    '<urn:uuid:...>' without the brackets. A target in brackets (WARC/1.0) is
    read without them. Other kinds of record are passed over. A file is read
    record by record, so beside its content a task holds one record and some MB.
    Records with a flaw are dropped, or with flawed returned too, to be counted
    (see FLAWS): what is cut off, without a length or a date, or whose body
    does not have its digest. What follows a flaw is read if it can be. Null
    content has no records; an empty table gives no rows; repeated rows stay;
    other columns are ignored.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.string(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PARSED.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for row in _records(content.as_py() or b"", bodies):
                    if flawed or row[-1] is None:
                        rows.append(row)
                        size += 500 + len(row[6] or b"")
                    if size > BATCH:
                        yield table(rows)
                        rows, size = [], 0
        yield table(rows)

    return files.select("content").mapInArrow(parse, PARSED)


def resolve_revisits(records: DataFrame, span: int = SPAN) -> DataFrame:
    """record_id, url, ts, response_id, outcome, digest, headers, record_key, response_key for every revisit record.

    outcome: resolved, mismatch (a validator of both differs; response_id is
    kept, headers are the revisit's own) or no_response (none is earlier; of
    equal times, a response counts as earlier; of equal responses, the greater
    record_id, then record_key, which is null where the records have none). A
    null time is before all others; null URLs are one URL; repeated revisits
    stay; headers of any length stay whole; other columns are ignored; an empty
    table gives no rows. Bodies are not shuffled: fetch them by response_key, or by response_id.
    Captures of one URL and second are reduced to one row before the shuffle, so
    a window holds at most a row for each second of a span, or a row for each
    span of a URL. Revisits of a URL and second that has very many of them, such
    as those without a time, get their response by a broadcast.
    """
    key = canonical_url(F.col("url"))
    record_key = F.col("record_key") if "record_key" in records.columns else F.lit(None).cast("string").alias("record_key")
    slim = records.select(key.alias("key"), F.coalesce("ts", F.lit(-(1 << 62))).alias("at"), "record_id", record_key, "kind", "url", "ts", "digest", "headers").withColumn("bucket", F.floor(F.col("at") / span))
    # Read more than once below: the records are parsed once.
    slim = materialize(slim, "warc-captures")
    # max() of a struct with a map is not defined: the last response is found by its place.
    place = F.when(F.col("kind") == "response", F.struct("record_id", "record_key"))
    answer = F.max_by(F.struct("record_id", "record_key", "digest", "headers"), place).alias("answer")
    moments = materialize(slim.groupBy("key", "bucket", "at").agg(answer, F.count_if(F.col("kind") == "revisit").alias("n")), "warc-moments")
    inside = Window.partitionBy("key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    within = moments.withColumn("own", F.last("answer", ignorenulls=True).over(inside)).filter("n > 0").select("key", "bucket", "at", "n", "own")
    lasts = moments.groupBy("key", "bucket").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lasts.withColumn("earlier", F.last("last", ignorenulls=True).over(before)).select("key", "bucket", "earlier")
    found = within.join(earlier, ["key", "bucket"], "left").select("key", "at", "n", F.coalesce("own", "earlier").alias("r"))
    revisits = slim.filter(F.col("kind") == "revisit")
    joined = attach(revisits, materialize(found, "warc-found"), ["key", "at"], revisits.count())

    def agree(a: Column, b: Column) -> Column:
        return a.isNull() | b.isNull() | (a == b)

    def header(h: Column, name: str) -> Column:
        return F.try_element_at(h, F.lit(name))

    tests = agree(F.col("digest"), F.col("r.digest")) & agree(header(F.col("headers"), "etag"), header(F.col("r.headers"), "etag")) & agree(header(F.col("headers"), "last-modified"), header(F.col("r.headers"), "last-modified"))
    outcome = F.when(F.col("r").isNull(), "no_response").when(tests, "resolved").otherwise("mismatch")
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    newer = F.map_filter(own, lambda k, v: k.isin(*MERGED))
    kept = F.map_filter(F.col("r.headers"), lambda k, v: ~F.map_contains_key(newer, k))
    merged = F.when(outcome == "resolved", F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), newer)).otherwise(own)
    return joined.select("record_id", "url", "ts", F.col("r.record_id").alias("response_id"), outcome.alias("outcome"), F.when(outcome == "resolved", F.col("r.digest")).alias("digest"), merged.alias("headers"), "record_key", F.col("r.record_key").alias("response_key"))


def records_of_pages(pages: DataFrame, after: int = 86_400) -> DataFrame:
    """Captures of a table pages(page_id, url, html): a response at second page_id, and a revisit, with the same entity tag, so many seconds later.

    Of every seventh page only the revisit was captured.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("page_id", F.lit(0)).alias("at"))
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("html").cast("binary"), 256))
    answers = base.filter(F.col("at") % 7 != 3).select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("at").alias("ts"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("date"), F.col("at").cast("string")).alias("headers"), digest.alias("digest"), F.col("html").cast("binary").alias("body"),
    )
    again = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("at") + after).alias("ts"),
        F.create_map(F.lit("etag"), tag, F.lit("date"), (F.col("at") + after).cast("string"), F.lit("content-type"), F.lit("text/plain")).alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("binary").alias("body"),
    )
    return answers.unionByName(again)
