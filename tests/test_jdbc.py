"""Tables in a database, through the embedded one in Spark's jars."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from folioscope.sources import books

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


@pytest.fixture(scope="module")
def stored(spark, url):
    start = dt.datetime(2026, 1, 1)
    rows = [(f"t{k}", f"u{k % 3}", f"title {k}", "f.txt", bytearray(f"text {k}".encode()), "txt", start + dt.timedelta(hours=k) if k % 10 else None) for k in range(200)]
    df = spark.createDataFrame(rows, books.TEXTS).repartition(3)
    books.write_jdbc(df, url, "texts", driver=DRIVER, createTableColumnTypes="text_id VARCHAR(64), user_id VARCHAR(64)")
    return sorted(map(tuple, df.collect()))


def test_round_trip_in_partitions(spark, url, stored):
    got = books.read_jdbc(spark, url, "texts", books.TEXTS, by="created_at", partitions=5, driver=DRIVER)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, got.collect())) == stored
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) < 100


def test_filters_and_columns_reach_the_database(spark, url, stored):
    got = books.read_jdbc(spark, url, "texts", books.TEXTS, by="created_at", partitions=4, driver=DRIVER).where("user_id = 'u1'").select("text_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo" in plan.replace("*", "") and "u1" in plan
    assert "CONTENT" not in plan.upper().split("READSCHEMA")[-1]
    assert {r.text_id for r in got.collect()} == {r[0] for r in stored if r[1] == "u1"}


def test_conditions_for_the_database_and_odd_bounds(spark, url, stored):
    read = lambda **x: books.read_jdbc(spark, url, "texts", books.TEXTS, driver=DRIVER, **x)
    one = read(by="created_at", partitions=4, where="\"text_id\" = 't7'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    assert read(by="created_at", partitions=4, where="\"text_id\" = 'none'").count() == 0
    assert read(partitions=1).count() == 200
    with pytest.raises(ValueError, match="column to divide by"):
        read(partitions=2)


def test_absent_columns_are_null(spark, url):
    books.write_jdbc(spark.createDataFrame([("r1", "j1")], "result_id string, job_id string"), url, "results", driver=DRIVER)
    got = books.read_jdbc(spark, url, "results", books.RESULTS, partitions=1, driver=DRIVER)
    assert [tuple(r) for r in got.collect()] == [("r1", None, "j1", None, None)]
