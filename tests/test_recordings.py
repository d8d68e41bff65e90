"""Recordings as a stream that is stopped and started again, the table function, and bodies of several members."""

import gzip
import json
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.operators import access, html_events
from siteloom.plans.catalog import QUERIES
from siteloom.streaming import recordings


def lines(path, rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.mark.parametrize("files", [2, 9])
def test_no_recording_comes_twice(spark, tmp_path, files):
    rows = [[{"url": f"https://h/{k}/{i}", "status": "200" if i % 2 else "timeout", "content": "x" * i} for i in range(5)] for k in range(files)]
    folder, out, marks = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    for k, batch in enumerate(rows):
        lines(folder / f"{k}.json", batch)
        if k % 2 == 0:  # every other file meets a stopped stream
            recordings.into_table(spark, f"file://{folder}", out, marks, files_at_once=1)
    recordings.into_table(spark, f"file://{folder}", out, marks, files_at_once=1)
    recordings.into_table(spark, f"file://{folder}", out, marks)
    got = sorted((r.url, r.status, r.state, len(r.content)) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["url"], 200 if r["status"] == "200" else None, None if r["status"] == "200" else "timeout", len(r["content"])) for b in rows for r in b)


def test_typed(spark, tmp_path):
    lines(tmp_path / "in" / "a.json", [{"url": "u", "redirects": 11, "status": "200"}, {"url": "v", "content": "x" * 600_000, "headers": {"A": "b"}}, {"status": "200"}])
    got = {r.url: r for r in recordings.read(spark, f"file://{tmp_path}/in").collect()}
    assert set(got) == {"u", "v"} and (got["u"].status, got["u"].state, got["u"].identity, got["u"].content) == (None, "too_many_redirects", "browser", "")
    assert len(got["v"].content) == recordings.BODY_LIMIT and got["v"].headers == {"A": "b"} and got["v"].status is None and got["v"].state is None


def test_events_as_a_table_function(spark):
    html_events.register(spark)
    pages = spark.createDataFrame([(1, '<p class="a">x<b>y</b><script>"</p>"</script>'), (2, None), (3, "")], "page_id long, html string")
    columns = ["page_id", "seq", "el", "kind", "tag", "attrs", "text", "unshown", "chrome", "hidden"]
    got = spark.sql("select p.page_id, e.* from {pages} p, lateral html_events(p.html) e", pages=pages)
    assert got.columns == columns
    assert sorted(map(str, got.collect())) == sorted(map(str, html_events.events(pages).select(*columns).collect()))
    starts = spark.sql("select e.tag from {pages} p, lateral html_events(p.html, 'start') e", pages=pages)
    assert sorted(r.tag for r in starts.collect()) == ["b", "p", "script"]
    with pytest.raises(Exception, match="kind is"):
        spark.sql("select * from {pages} p, lateral html_events(p.html, 'other') e", pages=pages).collect()


def test_bodies_of_several_members(spark):
    two = gzip.compress(b"first member ") + gzip.compress("zweites Glied é".encode())
    rows = [("two", two, ""), ("padded", two + b"\0\0\0", "gzip"), ("rest", two + b"junk", "gzip"), ("cut", two[:-9], "gzip"), ("deflate", zlib.compress(b"d"), "deflate"), ("br", b"\x8b\x02", "br")]
    d = spark.createDataFrame([(n, bytearray(b), e) for n, b, e in rows], "n string, raw binary, encoding string").select("n", access.decoded_body(F.col("raw"), F.col("encoding")).alias("d"))
    got = {r.n: (r.d.text, r.d.note) for r in d.collect()}
    whole = "first member zweites Glied é"
    assert got["two"] == (whole, None) and got["padded"] == (whole, None) and got["deflate"] == ("d", None)
    assert got["rest"] == (whole, "undecodable rest") and got["br"] == ("", "no decoder for br")
    assert got["cut"][0].startswith("first member ") and got["cut"][1] == "partial stream"


def test_texts_of_many_bodies_are_not_held_at_once(spark):
    """Findings, round 3, F6: a task held the texts of a whole Arrow batch, 10,000 bodies, however much they hold."""
    n, text = 400, b"x" * 300_000
    batch = pa.RecordBatch.from_arrays([pa.array([gzip.compress(text)] * n, pa.binary()), pa.array(["gzip"] * n), pa.array(range(n))], names=["raw", "encoding", "id"])
    seen = []
    for piece in access._pieces(iter([batch, batch.slice(0, 0), batch]), access._decoded, 2, [2], [pa.string(), pa.string()], ["id", "text", "note"]):
        assert len(piece.column(1)[0].as_py()) == len(text) and len(piece) * len(text) < access.HELD + access.INFLATED
        seen += piece.column(0).to_pylist()
    assert seen == [*range(n)] * 2
    for plan in (QUERIES["decoded_body"](spark, "/root/testdata/sf0.001"), spark.range(1).select(access.decoded_body(F.lit(b"x"), F.lit("")))):
        assert "ArrowEvalPython" not in plan._jdf.queryExecution().executedPlan().toString()


def test_bodies_of_a_table_are_those_of_the_column(spark, monkeypatch):
    monkeypatch.setattr(access, "HELD", 50)
    bodies = [None, b"", b"plain", gzip.compress(b"a" * 99), gzip.compress(b"b" * 10)[:-5], b"\x1f\x8b??", "\u00e9\u4e16".encode(), b"\xff\xfe"]
    rows = [(i, bodies[i % len(bodies)], (None, "gzip", "deflate", "br")[i % 4 if i % 3 else 0], f"k{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "n int, raw binary, encoding string, k string").coalesce(1)
    got = [tuple(r) for r in access.decoded_bodies(df).select("n", "k", "text", "note").collect()]
    assert got == [tuple(r) for r in df.select("n", "k", access.decoded_body("raw", "encoding").alias("d")).select("n", "k", "d.text", "d.note").collect()]
    assert len(got) == 100 and got[0] == (0, "k0", None, None) and got[3][2:] == ("a" * 99, None)
    html = spark.createDataFrame([(1, "\u00e9" * 50, "gzip"), (2, "b", "two members"), (3, "", "deflate"), (4, "d", "plain")], "page_id int, html string, packed string")
    sent = access.packed_bodies(html).withColumn("encoding", F.when(F.col("packed") == "deflate", "deflate"))
    assert {(r.page_id, r.packed, r.text, r.note) for r in access.decoded_bodies(sent).collect()} == {(1, "gzip", "\u00e9" * 50, None), (2, "two members", "bb", None), (3, "deflate", "", None), (4, "plain", "d", None)}
