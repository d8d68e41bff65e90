"""Reports are written whole or not at all, and a site that fails costs its own report only."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siteloom.sources import reports


def lines(path):
    read = [json.loads(x) for f in sorted(os.listdir(path)) if not f.startswith("_") for x in open(f"{path}/{f}")]
    return [{"site": x["site"], **json.loads(x["report"])} for x in read]


def some(spark, n):
    return spark.range(n, numPartitions=6).select(F.concat(F.lit("s"), "id").alias("site"), F.concat(F.lit('{"findings":['), F.col("id"), F.lit("]}")).alias("report"))


def test_written_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/r"
    reports.write(some(spark, 20), path)
    assert sorted(x["site"] for x in lines(path)) == sorted(f"s{i}" for i in range(20))
    reports.write(some(spark, 3), path)
    assert len(lines(path)) == 23
    reports.write(some(spark, 4), f"file://{path}", mode="overwrite")
    assert sorted((x["site"], x["findings"]) for x in lines(path)) == [(f"s{i}", [i]) for i in range(4)]
    assert not [f for f in os.listdir(path) if f.startswith("_staged")]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/r"
    bad = some(spark, 40).withColumn("report", F.when(F.col("site") == "s33", F.raise_error(F.lit("broken"))).otherwise(F.col("report")))
    with pytest.raises(Exception, match="broken"):
        reports.write(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_reports_that_are_no_json_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([("a", "{}"), ("b", "{no"), ("c", None)], "site string, report string")
    reports.write(df, f"{tmp_path}/r")
    got = {x["site"]: "error" in x for x in lines(f"{tmp_path}/r")}
    assert got == {"a": False, "b": True, "c": True}


@pytest.mark.parametrize("bad", [[], ["s7"], ["s0", "s29", "s30"]])
def test_sites_that_fail_cost_their_own_reports_only(spark, tmp_path, bad):
    whole = some(spark, 31)

    def make(part):
        own = part.join(whole, "site")
        return own.withColumn("report", F.when(F.col("site").isin(bad), F.raise_error(F.lit("broken site"))).otherwise(F.col("report"))) if bad else own

    done = reports.write_isolated(whole.select("site"), make, f"{tmp_path}/r")
    got = lines(f"{tmp_path}/r")
    assert sorted(x["site"] for x in got) == sorted(f"s{i}" for i in range(31))
    assert sorted(x["site"] for x in got if "error" in x) == sorted(bad) and done["fallbacks"] == len(bad)
    assert all("broken site" in x["error"] for x in got if "error" in x)
    assert reports.write_isolated(whole.select("site").where("false"), make, f"{tmp_path}/none") == {"jobs": 1, "fallbacks": 0}
