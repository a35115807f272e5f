"""Row numbers that hold for ranges drawn from a sample, and spans that round as SQL does."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.operators import relational as op
from graphloom.plans import catalog


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_ids_beside_columns_that_are_not_counted(spark, adaptive):
    settings = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 5).select(F.xxhash64("id").alias("k"), F.col("id").alias("more"))
        got = op.dense_ids(rows, ["k"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.k for r in sorted(got, key=lambda r: r["row"])] == sorted(r.k for r in got)
    assert sorted(r["row"] for r in got) == list(range(60_000))


def test_containment_rounds_halves_to_even(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    made = [(0.6, 2.5), (1.4, 2.5), (1.5, 2.0), (2.5, 1.0), (3.49, 3.5), (599.7, 1.5), (600.5, 0.5), (1201.0, 0.5), (2.0, 4.5)]
    rows = [(i, t + datetime.timedelta(seconds=a), i % 2, v) for i, (a, v) in enumerate(made * 2)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalog.QUERIES["containment_join"](spark, str(tmp_path)).select("user_id", "id", "outer_id").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == set(con.execute(catalog.ORACLES["containment_join"]).fetchall())
