import base64
import gzip
import hashlib
import re

from pyspark.sql import functions as F

from tallycast.llm import warc as W
from tallycast.session import scratch_path

PAGES = [
    (1, "http://www.b.example.com:80/x y?q=1#frag", "<p>one"), (2, "https://user@a.example.com", "<p>two"), (3, "http://b.example.com/x%20y?q=1", "<p>one"),
    (4, None, None), (5, "", ""), (6, "ftp://z.org/\r\nInjected: yes", "a\r\n\r\nb"), (7, "not a url é", "é" * 5000), (3, "http://b.example.com/x%20y?q=1", "<p>one"),
    (None, "http://n.example/", "<p>two"), (None, "http://n.example/", "only null"), (None, "http://n.example/", "only null"), (9, "http://n.example/", "x" * 300_000),
]


def expected(pages):
    rows = []
    for page, _, html in pages:
        data = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        first = min(ids) if len([1 for _, _, h in pages if (h or "") == (html or "")]) > 1 and ids else None
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows.append((str(page), len(data), digest, "revisit" if revisit else "response", str(first if revisit else None)))
    return sorted(rows)


def read(spark, folder):
    return sorted((str(r.page), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in W.read_captures(spark, folder).collect())


def test_round_trip_with_odd_rows(spark, monkeypatch):
    folder = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, key string").repartition(3)
    blocks = W.write_archives(df, folder)
    assert blocks.agg(F.sum("records")).first()[0] == len(PAGES)
    assert read(spark, folder) == expected(PAGES)


def test_archives_are_plain_warc_and_sorted(spark):
    import glob

    folder = scratch_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(folder.removeprefix("file://") + "/*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES) and b"\r\nInjected: yes" not in raw
    keys = [k for f in sorted(glob.glob(folder.removeprefix("file://") + "/*.cdx.gz")) for k in re.findall(r"^\S+", gzip.open(f).read().decode(), re.M)]
    assert keys == sorted(keys)


def test_lookup_finds_all_captures_over_blocks_and_files(spark):
    folder = scratch_path(spark, "warc-test")
    pages = [(i, f"http://h{i % 7}.example.com/p{i % 50}", f"<p>{i % 90}") for i in range(3000)] + [(5000 + i, "http://hot.example.com/", "same") for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        W.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    urls = ["http://hot.example.com/", "https://www.h3.example.com/p10#x", "http://none.example.com/"]
    got = W.lookup(spark.createDataFrame([(u,) for u in urls], "url string"), folder).collect()
    hot = [r for r in got if r.url == urls[0]]
    assert len(hot) == 1500 and sum(r.record_type == "response" for r in hot) == 1 and {r.refers_to for r in hot} == {None, "5000"}
    assert sorted(int(r.page) for r in got if r.url == urls[1]) == [i for i in range(3000) if i % 7 == 3 and i % 50 == 10]
    assert not [r for r in got if r.url == urls[2]]
    assert all(r.html == f"<p>{int(r.page) % 90}" for r in got if r.url == urls[1] and r.record_type == "response")


def test_small_payloads_and_empty_table(spark):
    folder = scratch_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), folder, least_bytes=3)
    assert [r[3] for r in read(spark, folder)] == ["response", "response"]
    folder = scratch_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read(spark, folder) == []


def test_capture_keys(spark):
    df = spark.createDataFrame([("http://www2.A.b.com:8080/P?q#f",), ("https://x.org",), ("x.org/a",), (None,)], "url string")
    assert [r[0] for r in df.select(W.capture_key(F.col("url"))).collect()] == ["com,b,a)/P?q", "org,x)/", ")/x.org/a", ")/"]
