"""Queries on tables as they come at larger sizes: in many files, with larger keys."""

import duckdb
from lodestone import queries as core
from pyspark.sql import functions as F

from .conftest import SF


def _same(spark, where, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet/*.parquet'")
    got = core.queries()[name](spark, where)
    cur = con.execute(core.oracle_sql()[name])
    order = [got.columns.index(c[0]) for c in cur.description]
    assert sorted(tuple(r[k] for k in order) for r in got.collect()) == sorted(cur.fetchall())


def test_a_table_of_many_files_is_one_segment(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    _same(spark, str(tmp_path), "r14_counts", "documents")


def test_texts_of_users_beyond_four_hex_digits(spark, tmp_path):
    rows = [(e, u) for u in (0, 1, 65_535, 65_536, 90_000, 1_048_576) for e in (0, 1, 65_536, 70_000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    events.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    _same(spark, str(tmp_path), "x05_ip_text", "events")
