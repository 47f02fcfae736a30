"""Revisit resolution: SQL agreement is checked by the driver; here rules, ties, round trips through files."""

import gzip

from pyspark.sql import functions as F

from barflow.llm.warc import canonical_url, parse_records, read_warc, resolve_revisits, write_record

SCHEMA = "id string, url string, time long, revisit boolean, etag string, last_modified string, digest string, headers map<string,string>, body string, extra int"


def row(i, url, time, revisit=False, etag=None, lm=None, digest=None, headers=None, body=None):
    return (i, url, time, revisit, etag, lm, digest, headers, body, 1)


def test_resolution(spark):
    u = "http://A.example/x"
    rows = [
        row("r1", u, 10, etag='"v1"', headers={"content-length": "3", "age": "5", "server": "s"}, body="one"), row("r2", "https://a.example/x/#top", 20, etag='"v2"', headers={}, body="two"),
        row("a", u, 15, True, 'W/"v1"', headers={"age": "0", "content-length": "0", "new": "y"}), row("b", u, 30, True, '"v1"'), row("c", u, 20, True, '"v2"'), row("d", u, 21, True, lm="m"),
        row("e", "http://other/", 9, True, '"v1"'), row("f", None, 9, True, '"v1"'), row("g", u, None, True, '"v1"'), row("b", u, 30, True, '"v1"'),
        row("t1", "h/t", 5, lm="x", body="p"), row("t2", "h/t", 5, lm="x", body="q"), row("t", "h/t", 6, True, lm="x"), row("z", "h/z", 1, digest="d", body="k"), row("zz", "h/z", 900, True, digest="d"),
    ]
    for spans in (1, 4, 256):
        out = resolve_revisits(spark.createDataFrame(rows, SCHEMA), spans)
        found = sorted((r["id"], r["verdict"], r["response_id"], r["body"]) for r in out.collect())
        assert found == sorted([
            ("a", "resolved", "r1", "one"), ("b", "changed", None, None), ("b", "changed", None, None), ("c", "changed", None, None), ("d", "no validator", None, None), ("e", "no response", None, None),
            ("f", "no response", None, None), ("g", "no response", None, None), ("t", "resolved", "t2", "q"), ("zz", "resolved", "z", "k"),
        ])
    headers = out.where("id = 'a'").first()["headers"]
    assert headers == {"content-length": "3", "age": "0", "server": "s", "new": "y"}
    assert resolve_revisits(spark.createDataFrame(rows, SCHEMA).where("false")).count() == 0


def test_hot_url(spark):
    rows = [row(f"r{i}", "h/x", 3 * i, etag=str(i // 2), headers={}, body=str(i)) for i in range(200)] + [row(f"v{i}", "h/x", 3 * i + 1, True, str(i // 2)) for i in range(200)]
    out = resolve_revisits(spark.createDataFrame(rows, SCHEMA), 16)
    assert {(r["id"], r["response_id"]) for r in out.collect()} == {(f"v{i}", f"r{i}") for i in range(200)}


def test_far_dates_and_unresolved_rows(spark):
    rows = [row(f"r{i}", "h/x", 1000 + i, etag="e", headers={}, body=str(i)) for i in range(300)]
    rows += [row("far", "h/y", 10**15, etag="e", headers={}, body="far"), row("early", "h/z", -(10**15), etag="e", body="early")]
    rows += [row(f"v{i}", "h/x", 1000 + i, True, "e") for i in range(1, 300)] + [row(f"n{i}", "h/none", 5, True, "e") for i in range(50)] + [row("w", "h/z", 7, True, "e")]
    got = {r["id"]: (r["response_id"], r["body"]) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), 64).collect()}
    assert got == {f"v{i}": (f"r{i - 1}", str(i - 1)) for i in range(1, 300)} | {f"n{i}": (None, None) for i in range(50)} | {"w": ("early", "early")}


def test_repeated_responses_of_one_id(spark):
    rows = [row("r", "h/x", 1, etag="e", body="old", headers={"a": "1"}), row("r", "h/x", 2, etag="e", body="new", headers={"a": "2"}), row("v", "h/x", 3, True, "e")]
    for order in (rows, rows[::-1]):
        out = resolve_revisits(spark.createDataFrame(order, SCHEMA)).first()
        assert out["body"] == "new" and out["headers"] == {"a": "2"}


def test_canonical(spark):
    urls = ["http://H.com:80/p/?b=2&utm_source=x&a=1#f", "https://h.com/p?a=1&b=2", "h.com/p/", "HTTP://h.com/p?ref=1"]
    out = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert out[0] == out[1] == "h.com/p?a=1&b=2" and out[2] == out[3] == "h.com/p"


def test_files(spark, tmp_path):
    one = write_record("response", "http://h/x", "2024-01-01T00:00:00Z", {"ETag": '"v"', "Content-Type": "text/html"}, b"<p>\r\n\r\nhi")
    two = write_record("revisit", "http://h/x", "2024-01-02T00:00:00Z", {"ETag": 'W/"v"'}, b"", "304 Not Modified")
    assert [(k, s, b) for k, _, _, s, _, b in parse_records(one + two)] == [("response", 200, b"<p>\r\n\r\nhi"), ("revisit", 304, b"")]
    assert list(parse_records(gzip.decompress(one) + gzip.decompress(two))) == list(parse_records(one + two))
    many = b"".join(write_record("response", f"http://h/{i}", "2024-01-01T00:00:00Z", {}, bytes(1 << 20)) for i in range(20))
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "b.warc.gz").write_bytes(many)
    (tmp_path / "many" / "none.warc").write_bytes(b"")
    big = read_warc(spark, str(tmp_path / "many"))
    assert big.selectExpr("count(*)", "count(DISTINCT id)", "sum(octet_length(body))").first()[:] == (20, 20, 20 << 20)
    (tmp_path / "a.warc.gz").write_bytes(one + two)
    out = resolve_revisits(read_warc(spark, str(tmp_path / "*.warc.gz"))).first()
    assert out["verdict"] == "resolved" and bytes(out["body"]) == b"<p>\r\n\r\nhi" and out["headers"]["content-type"] == "text/html"
