"""Queries that take whole tables, held against plain counts."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.plans.workload import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stream_counts_every_event_of_many_files(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(40).write.parquet(f"{tmp_path}/events.parquet")
    want = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    found = QUERIES["ext_streaming_windows"](spark, str(tmp_path)).withColumn("total", F.round("total", 4))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_studies_take_all_orders_and_the_operators_defaults(spark, monkeypatch):
    from tessera.plans import analysis

    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    years = dict(orders.groupBy(F.year("o_orderdate")).agg(F.count_distinct("o_custkey")).collect())
    ridge = {r.fold: r.n_test for r in QUERIES["walk_forward_ridge"](spark, SMALL).collect()}
    assert ridge and ridge == {y: years[y] for y in ridge} and len(ridge) >= len(years) - 1
    assert QUERIES["permutation"](spark, SMALL).first().n == 200
    monkeypatch.setattr(analysis.mo, "walk_forward_trees", lambda frame, *_, **settings: (frame.count(), settings))
    assert QUERIES["walk_forward_trees"](spark, SMALL) == (sum(years.values()), {})


def test_every_order_has_facts(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert QUERIES["selected_facts"](spark, SMALL).select("accession").distinct().count() == orders


def test_every_run_of_five_documents_is_sectionised(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = docs.groupBy("source").agg(F.ceil(F.count("*") / 5).alias("n")).agg(F.sum("n")).first()[0]
    found = QUERIES["sectionise"](spark, SMALL).select("accession").distinct().count()
    assert found == want > docs.select("source").distinct().count()
