"""WARC files as other tools write them."""

import gzip

from seqloom.llm import warc


def record(kind, key, date, http, url="http://h.example/a", version="1.0"):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{key}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n".encode()


def answer(body):
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n{body}"


AGAIN = 'HTTP/1.1 304 Not Modified\r\nDate: x\r\n\r\n'
FILE = [
    record("warcinfo", "00000000-0000-0000-0000-000000000000", "2024-05-01T09:00:00Z", "software: x"),
    record("response", "f0000000-0000-4000-8000-000000000001", "2024-05-01T10:00:00Z", answer("old")),
    record("response", "a0000000-0000-4000-8000-000000000002", "2024-05-02T10:00:00.250Z", answer("new"), version="1.1"),
    record("revisit", "b0000000-0000-4000-8000-000000000003", "2024-05-01T12:00:00Z", AGAIN),
    record("revisit", "b0000000-0000-4000-8000-000000000004", "2024-05-03T00:00:00Z", AGAIN, url="<http://h.example/a>"),
    record("revisit", "b0000000-0000-4000-8000-000000000005", "2024-05-01T00:00:00Z", AGAIN),
]


def test_a_standard_file(spark):
    files = spark.createDataFrame([(b"".join(FILE[:3]),), (b"".join(gzip.compress(x) for x in FILE[3:]),)], "content binary")
    parsed = warc.parse_warc(files)
    by_key = {r.record_key: r for r in parsed.collect()}
    assert by_key["urn:uuid:f0000000-0000-4000-8000-000000000001"].ts == 1714557600 and len(by_key) == 5
    got = {r.record_key[-1]: r for r in warc.resolve_revisits(parsed).collect()}
    assert {k: (r.outcome, r.ts, r.response_key and by_key[r.response_key].body) for k, r in got.items()} == {"3": ("resolved", 1714564800, b"old"), "4": ("resolved", 1714694400, b"new"), "5": ("no_response", 1714521600, None)}
    again = {r.record_key: r for r in warc.parse_warc(warc.to_warc(parsed)).collect()}
    assert again == by_key


def test_dates():
    days = {"2024-05-01T10:00:00Z": 1714557600, "2024-05-01T10:00:00.999999999Z": 1714557600, "2024-05-01T12:00:00+02:00": 1714557600, "2024-05-01T10:00Z": 1714557600, "2024-05": 1714521600, "1970": 0, "1969-12-31T23:59:59Z": -1, "2016-12-31T23:59:60Z": 1483228800, "2024-13-01": None, "x": None, "": None}
    assert {d: warc._seconds(d) for d in days} == days
    assert warc._date(1714557600) == "2024-05-01T10:00:00Z"
    for ts in (0, 5, -62135596800, 253402300799, 1 << 50, -(1 << 50)):
        assert warc._seconds(warc._date(ts)) == ts


def warc_record(kind, body, **named):
    import hashlib

    http = b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\n" + body
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{hashlib.md5(body).hexdigest()}>", "WARC-Target-URI": "http://h.example/", "WARC-Date": "2024-05-01T10:00:00Z", "Content-Length": len(http)} | {k.replace("_", "-"): v for k, v in named.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + http + b"\r\n\r\n"


def test_flawed_records_are_dropped_and_counted(spark):
    import base64
    import gzip
    import hashlib
    from collections import Counter

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    good = [warc_record("response", b"one", WARC_Payload_Digest=sha1(b"one")), warc_record("revisit", b"", WARC_Payload_Digest=sha1(b"one")), warc_record("warcinfo", b"i")]
    bad = [warc_record("response", b"two", WARC_Payload_Digest=sha1(b"other")), warc_record("response", b"three", Content_Length="many"), warc_record("response", b"four", WARC_Date="soon")]
    last = warc_record("response", b"five")
    plain = b"".join(good + bad + [last])
    files = [plain, plain[:-20], b"".join(map(gzip.compress, good + bad + [last])), b"".join(map(gzip.compress, good + bad)) + gzip.compress(last)[:-30], b"", None, b"\x1f\x8bno"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "n long, content binary")
    for bodies in (True, False):
        assert Counter(r.kind for r in warc.parse_warc(df, bodies).collect()) == {"response": 6, "revisit": 4}
    flaws = Counter(r.flaw for r in warc.parse_warc(df, flawed=True).collect())
    assert flaws == {None: 10, "digest": 4, "length": 4, "date": 4, "cut": 3}
