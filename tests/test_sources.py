import json

from pyspark.sql import functions as F

from siteloom.operators import access, content
from siteloom.sources import fetch, seeds


def test_recordings_are_dealt_by_host_and_bounded(spark):
    rows = [{"url": f"https://h{i % 3}.com/{i}", "status": 200, "content": "x" * 600_000} for i in range(6)] + [{"url": "https://h0.com/t", "status": "timeout"}, {"url": "https://h1.com/r", "status": 200, "redirects": 11}]
    d = fetch.recorded_fetches(spark, rows)
    assert d.rdd.getNumPartitions() == 3
    got = {r.url: r for r in d.collect()}
    assert len(got["https://h0.com/0"].content) == fetch.BODY_LIMIT
    assert (got["https://h0.com/t"].status, got["https://h0.com/t"].state) == (None, "timeout")
    assert got["https://h1.com/r"].state == "too_many_redirects"


def test_lines_that_are_no_signals_are_kept_apart(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"site":"a","signal":"noindex","value":"true"}\n{broken\n{"site":"b"}\n')
    good, bad = fetch.signals_from_json(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in good.collect()] == [("a", "noindex", "true")]
    assert bad.count() == 2


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1 /StructTreeRoot")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1 " + b"z" * 100)
    (tmp_path / "c.txt").write_bytes(b"%PDF-1")
    d = fetch.pdf_files(spark, str(tmp_path), limit=50).withColumn("p", content.pdf_text_layer("data", "truncated"))
    got = {r.path.rsplit("/", 1)[-1]: (r.has_text, r.truncated) for r in d.select("path", "p.has_text", "truncated").collect()}
    assert got == {"a.pdf": (True, False), "b.pdf": (None, True)}


def test_bodies(spark):
    raw = [(1, bytearray(access.gzipped("ä" * 1000)), ""), (2, bytearray(access.gzipped("abc" * 9999)[:-12]), "gzip"), (3, bytearray(b"\x1f\x8b??"), "gzip"), (4, None, None)]
    d = spark.createDataFrame(raw, "n int, raw binary, encoding string").withColumn("d", access.decoded_body("raw", "encoding"))
    got = {r.n: (len(r.text) if r.text is not None else None, r.note) for r in d.select("n", "d.text", "d.note").collect()}
    assert got[1] == (1000, None) and got[3] == (0, "undecodable body") and got[4] == (None, None)
    assert got[2][1] == "partial stream" and got[2][0] > 0


def test_lookups(spark):
    assert seeds.lookup(spark, "crawlers").count() == 20
    assert json.loads(seeds.lookup(spark, "verify_codes").where(F.col("code") == 10).toJSON().first())["kind"] == "expired"
