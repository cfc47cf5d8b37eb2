"""Queries on tables larger than the test data's, or with other keys, against their SQL."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyspark
import pytest
from pyspark.sql import functions as F
from test_queries import plain

from floodplain import model, queries_flow
from floodplain.functions import locations
from floodplain.operators.log import furthest
from floodplain.queries import QUERIES, SQL
from floodplain.sources import tables
from floodplain.sources.merged import Change, MergedTable
from floodplain.streaming.runner import Replication, Task


def differs(spark, folder, name, **tables) -> list[str]:
    """Rows of a query over these tables that its SQL lacks, or has more of."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    own = sorted(str([plain(r[c]) for c in names]) for r in got.collect())
    want = sorted(str([plain(v) for v in r]) for r in found.fetchall())
    assert want
    return [x for x, y in zip(own, want, strict=False) if x != y] + ["other number of rows"] * (len(own) != len(want))


def test_diff_buckets_keeps_its_64_buckets_on_more_rows(spark, tmp_path):
    orders = spark.range(300_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 77).alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
    assert not differs(spark, tmp_path, "diff_buckets", orders=orders)


def test_file_order_goes_on_after_the_last_number(spark, tmp_path):
    ids = spark.range(1_999_000, 2_001_500).union(spark.range(3_999_990, 4_000_010)).union(spark.range(1500))
    assert not differs(spark, tmp_path, "file_order", events=ids.select(F.col("id").alias("event_id"), F.lit("view").alias("event_type")).repartition(5))


def test_long_numbers_stay_whole_in_names_with_an_epoch(spark):
    assert spark.range(1).select(locations.with_epoch(F.lit("b"), F.lit(2), F.lit(1_000_000))).first()[0] == "b|000002.1000000"


def test_another_database_with_odd_rows(spark, tmp_path):
    rows = [(0, 'a, "b"', 1), (2, " x ", None), (4, None, 3), (6, "", 4), (8, "two\nlines", 5), (9, "odd", 6), (None, "no key", 7), (10, "ä\\b", 8), (-4, "below", 9)]
    customer = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int")
    assert not differs(spark, tmp_path, "jdbc_chunks", customer=customer)


ACROSS = """
from pyspark.sql import SparkSession
from floodplain.queries import QUERIES
spark = SparkSession.builder.config("spark.checkpoint.dir", "file://{0}/shared").getOrCreate()
assert QUERIES["jdbc_chunks"](spark, "/root/testdata/sf0.001").count() == 75
spark.stop()
"""


def test_another_database_is_seen_by_other_processes(tmp_path):
    home = tmp_path / "home"  # workers keep their files below it
    home.mkdir()
    for part in ("bin", "jars"):
        (home / part).symlink_to(Path(pyspark.__file__).parent / part)
    place = {"TMPDIR": str(tmp_path), "SPARK_LOCAL_DIRS": str(tmp_path), "SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable}
    own = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    command = "--master local-cluster[2,1,1024] --driver-memory 1g --conf spark.ui.enabled=false --conf spark.driver.host=127.0.0.1 pyspark-shell"
    done = subprocess.run([sys.executable, "-c", ACROSS.format(tmp_path)], env=own | place | {"PYSPARK_SUBMIT_ARGS": command}, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_stored_log_has_files_by_its_rows(spark, tmp_path):
    rows = model.from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    for part in ("seq < 6000", "seq >= 6000"):
        tables.append_log(rows.where(part), str(tmp_path / "log"))
    log = tables.read_log(spark, str(tmp_path / "log"))
    assert len(log.inputFiles()) <= 2 * 4 < rows.select("file_seq").distinct().count()
    assert sorted(r.seq for r in log.collect()) == sorted(r.seq for r in rows.collect())
    late = tables.read_log(spark, str(tmp_path / "log"), 1, 8)
    assert sorted(r.seq for r in late.collect()) == sorted(r.seq for r in rows.where("file_seq >= 8").collect())


@pytest.mark.parametrize("name", ["streamed_group_waiting", "streamed_statements", "streamed_filters"])
def test_a_streamed_batch_is_dealt_out(spark, tmp_path, monkeypatch, name):
    """A batch lies in several files, and is joined with its sources and members without gathering their rows in one task."""
    staged, files, stage, stream = [], [], Change.stage, tables.stream_log
    monkeypatch.setattr(queries_flow, "FILE_ROWS", 1000)
    monkeypatch.setattr(Change, "stage", lambda self, rows: staged.append((self.batch, rows._jdf.queryExecution().sparkPlan().toString())) or stage(self, rows))  # noqa: SLF001
    monkeypatch.setattr(tables, "stream_log", lambda spark, path, schema, n: files.append((n, len(spark.read.parquet(path).inputFiles()))) or stream(spark, path, schema, n))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
        assert not differs(spark, tmp_path, name, events=events)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert files == [(5, 10)] and {batch for batch, _ in staged} == {0, 1}
    assert not any("SortMergeJoin" in plan and "src_id" in plan.split("SortMergeJoin")[1].split("\n")[0] for _, plan in staged)


def test_locations_are_found_in_generated_code(spark, tmp_path, monkeypatch):
    """A batch's rows are neither sorted for the last location of each table and source, nor looked at one by one for statements before them."""
    plans, stage, side = [], Change.stage, Change.side
    plan_of = lambda rows: plans.append(rows._jdf.queryExecution().sparkPlan().toString())  # noqa: E731, SLF001
    monkeypatch.setattr(Change, "stage", lambda self, rows: (plan_of(rows), stage(self, rows))[1])
    monkeypatch.setattr(Change, "side", lambda self, name, rows: (plan_of(rows) if name == "points" else None, side(self, name, rows))[1])
    assert not differs(spark, tmp_path, "streamed_group", events=spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    found = [p for p in plans if "max(struct(epoch" in p]
    assert len(found) >= 4 and all("partial_max(pos" in p for p in found)
    assert not any("lambda" in p for p in plans)


def test_the_last_location_of_a_group(spark):
    rows = [("a", 1, 9, 9, 0), ("a", 2, 1, 5, 7), ("a", 2, 1, 6, 0), ("a", 2, 1, 6, 3), ("a", 2, 1, None, 9), ("b", None, 3, 1, 0), ("b", 0, 1, None, None), (None, 1, 1, 1, 1)]
    log = spark.createDataFrame(rows, "src_id string, epoch int, file_seq long, pos long, row_idx int").repartition(3)
    assert sorted(map(str, furthest(log, ["src_id"]).collect())) == sorted(map(str, log.groupBy("src_id").agg(F.max(model.location()).alias("point")).collect()))


def test_rows_at_and_around_statements_of_a_group(spark):
    """A row at a statement's own place stands before it; a member without statements, and another table, have none."""
    run = Replication(Task(["id"]), MergedTable(spark, "/tmp/none", ["id"], "id int"))
    rows = spark.createDataFrame([("s", "d", t, 1, f, p, 0) for t in ("t", "u", "v") for f, p in ((1, 9), (2, 1), (2, 2), (3, 1))], "src_id string, src_schema string, src_table string, epoch int, file_seq long, pos long, row_idx int")
    got = run._spanned(rows.withColumn("ddl_epoch", F.lit(None).cast("long")), {"s|d|t": 2, "s|d|u": 1}, [("s", "d", "t", 1, 2, 1, 0), ("s", "d", "t", 1, 2, 2, 0)])  # noqa: SLF001
    assert sorted((r.src_table, r.file_seq, r.pos, r._epoch) for r in got.collect()) == [("t", 1, 9, 2), ("t", 2, 1, 2), ("t", 2, 2, 3), ("t", 3, 1, 4), *[("u", f, p, 1) for f, p in ((1, 9), (2, 1), (2, 2), (3, 1))], *[("v", f, p, None) for f, p in ((1, 9), (2, 1), (2, 2), (3, 1))]]  # noqa: SLF001
