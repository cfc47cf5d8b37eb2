"""The stream runner: restarts, batches that come twice, and held shard rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from floodplain import model
from floodplain.operators.changes import RowFilter, apply_keyed, compact, filter_rows
from floodplain.operators.rules import AllowList, Route
from floodplain.plans.history import SafeMode
from floodplain.sources.merged import MergedTable
from floodplain.sources.tables import append_log, log_events, read_log, stream_log
from floodplain.streaming.runner import Replication, Task, first_of, load_then_follow, supervised, windowed_counts

EMPTY = "user_id long, value double, event_type string"
TASK = Task(["user_id"], AllowList(do_dbs=("app",)), filters=(RowFilter(insert="value < 5"),), routes=(Route("app", "events_*", "m", "events"),))


def changelog(spark):
    return model.from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))


def expected(spark, rows):
    delta = compact(filter_rows(rows, TASK.filters), ["user_id"], ["seq"])
    return sorted(map(tuple, apply_keyed(spark.createDataFrame([], EMPTY), delta, ["user_id"]).collect()))


def test_stream_equals_batch_with_restart_and_replay(spark, tmp_path):
    rows = changelog(spark).drop("seq")
    rows = rows.withColumn("is_commit", F.col("is_commit") | (F.col("pos") == rows.agg(F.max("pos")).first()[0]))
    log, target = str(tmp_path / "log"), MergedTable(spark, str(tmp_path / "t"), ["user_id"], EMPTY, 4)
    calls = []
    task = Task(TASK.key, TASK.allow, filters=TASK.filters, routes=TASK.routes, after_batch=(lambda df, i: calls.append(i),))
    run = Replication(task, target)
    first, second = rows.where("file_seq = 1 and pos < 5000"), rows.where("not (file_seq = 1 and pos < 5000)")
    append_log(first, log)
    schema = read_log(spark, log).schema
    for part in (None, second):
        if part is not None:
            append_log(part, log)
        run.start(stream_log(spark, log, schema), str(tmp_path / "c")).awaitTermination()
    last = rows.where("is_commit").agg(F.max(model.location())).first()[0]
    exp = expected(spark, changelog(spark).where(model.location() <= F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(model.LOCATION, last)])))
    assert sorted(map(tuple, target.read().collect())) == exp
    done = target.committed()
    run.batch(second, done)
    assert target.committed() == done and sorted(map(tuple, target.read().collect())) == exp and calls == list(range(done + 1))
    points = {r.src_table: r.point for r in target.side("points").collect()}
    assert max(points.values()) == last
    target.vacuum(1)
    assert sorted(map(tuple, target.read().collect())) == exp


def test_load_then_follow(spark, tmp_path):
    rows = changelog(spark).drop("seq").withColumn("is_commit", F.lit(True))
    log = str(tmp_path / "log")
    append_log(rows, log)
    target = MergedTable(spark, str(tmp_path / "t"), ["user_id"], EMPTY, 4)
    snapshot = spark.createDataFrame([(-1, 1.0, "only in the snapshot")], EMPTY)
    load_then_follow(Replication(TASK, target), snapshot, stream_log(spark, log, read_log(spark, log).schema), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, target.read().collect())) == sorted([(-1, 1.0, "only in the snapshot"), *expected(spark, changelog(spark))])


IMAGE = "struct<id: int, a: string, b: int, c: string>"
HEAD = "src_id string, src_schema string, src_table string, epoch int, file_seq long, pos long, row_idx int, txn_id string, is_commit boolean, ts timestamp_ntz, op string"
NOW = datetime.datetime(2024, 1, 1)


def log_of(spark, *events):
    """Log rows from (source, table, pos, commit, op or None, before, after, statement); images are (id, a, b, c)."""
    rows = [(s, "app", t, 1, 1, pos, 0, str(pos), commit, NOW, op, before, after, text) for s, t, pos, commit, op, before, after, text in events]
    return spark.createDataFrame(rows, f"{HEAD}, before {IMAGE}, after {IMAGE}, ddl string")


def files(target):
    return {b: x["path"] for b, x in target.manifest()["files"].items()}


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    target = MergedTable(spark, str(tmp_path / "t"), ["id"], "id int, a string, b int", 16)
    run = Replication(Task(["id"]), target)
    run.batch(log_of(spark, *[("s", "t", i, True, "I", None, (i, f"v{i}", i, None), None) for i in range(100)]), 0)
    before = files(target)
    run.batch(log_of(spark, ("s", "t", 200, True, "U", (7, "v7", 7, None), (7, "new", 7, None), None), ("s", "t", 201, True, "D", (8, "v8", 8, None), None, None)), 1)
    after = files(target)
    touched = {b for b in before if after.get(b) != before[b]}
    assert 1 <= len(touched) <= 2 and len(before) > 10
    assert sorted(map(tuple, target.read().collect())) == [(i, "new" if i == 7 else f"v{i}", i) for i in range(100) if i != 8]
    broken = target.change(2)
    broken.merge(run.task.delta(log_of(spark, ("s", "t", 300, True, "D", (9, "v9", 9, None), None, None)).drop("ddl")))  # breaks off before its commit
    assert target.committed() == 1 and target.read().count() == 99
    run.batch(log_of(spark, ("s", "t", 300, True, "D", (9, "v9", 9, None), None, None)), 2)
    assert target.read().count() == 98


def test_rows_wait_for_their_transaction(spark, tmp_path):
    target = MergedTable(spark, str(tmp_path / "t"), ["id"], "id int, a string", 2)
    run = Replication(Task(["id"]), target)
    run.batch(log_of(spark, ("s", "t", 1, True, "I", None, (1, "x", 0, None), None), ("s", "t", 2, False, "I", None, (2, "x", 0, None), None)), 0)
    assert [r.id for r in target.read().collect()] == [1] and target.side("points").first().point.pos == 1
    run.batch(log_of(spark, ("s", "t", 3, True, "D", (1, "x", 0, None), None, None)), 1)
    assert [r.id for r in target.read().collect()] == [2] and target.side("waiting") is None


def test_statements_in_the_log_change_the_target(spark, tmp_path):
    target = MergedTable(spark, str(tmp_path / "t"), ["id"], "id int, a string", 4)
    run = Replication(Task(["id"]), target)
    said = lambda pos, text: ("s", "t", pos, True, None, None, None, text)
    run.batch(log_of(
        spark, ("s", "t", 1, True, "I", None, (1, "x", None, None), None), said(2, "ALTER TABLE app.t ADD COLUMN b int NOT NULL DEFAULT 5"), said(3, "FLUSH TABLES"), ("s", "t", 4, True, "I", None, (2, "y", 6, None), None),
        said(5, "ALTER TABLE app.t ADD COLUMN b int"), said(6, "ALTER TABLE app.t DROP COLUMN a, ADD COLUMN c varchar(9) DEFAULT 'it''s'"), ("s", "t", 7, True, "I", None, (3, None, 7, "z"), None),
    ), 0)
    assert target.read().dtypes == [("id", "int"), ("b", "int"), ("c", "string")]
    assert sorted(map(tuple, target.read().collect())) == [(1, 5, "it's"), (2, 6, "it's"), (3, 7, "z")]
    old = files(target)
    run.batch(log_of(spark, said(8, "ALTER TABLE app.t MODIFY COLUMN b bigint, CHANGE COLUMN c a varchar(20)"), said(9, "ALTER TABLE app.t RENAME COLUMN a TO d")), 1)
    assert files(target) == old and target.read().dtypes == [("id", "int"), ("b", "bigint"), ("d", "string")]
    assert sorted(map(tuple, target.read().collect())) == [(1, 5, "it's"), (2, 6, "it's"), (3, 7, "z")]
    with pytest.raises(ValueError, match="key column"):
        run.batch(log_of(spark, said(10, "ALTER TABLE app.t DROP COLUMN id")), 2)
    run.batch(log_of(spark, said(10, "TRUNCATE TABLE app.t")), 2)
    assert target.read().count() == 0


def test_a_shard_group_waits_for_all_members(spark, tmp_path):
    members = [("s1", "app", "t0"), ("s2", "app", "t1")]
    target = MergedTable(spark, str(tmp_path / "t"), ["id"], "id int, a string", 4)
    safe = SafeMode()
    run = Replication(Task(["id"]), target, members, safe, lambda: 1e9)
    add = lambda t: f"ALTER TABLE app.{t} ADD COLUMN b int"
    run.batch(log_of(spark, ("s1", "t0", 1, True, "I", None, (1, "x", None, None), None), ("s1", "t0", 2, True, None, None, None, add("t0")), ("s1", "t0", 3, True, "I", None, (2, "x", 8, None), None), ("s2", "t1", 1, True, "I", None, (3, "x", None, None), None)), 0)
    assert sorted(r.id for r in target.read().collect()) == [1, 3] and "b" not in target.read().columns and safe.on((), 1e9)
    assert target.side("waiting").count() == 1 and target.manifest()["members"] == {"s1|app|t0": 1, "s2|app|t1": 0}
    run = Replication(Task(["id"]), target, members, safe, lambda: 1e9)  # restarted
    run.batch(log_of(spark, ("s1", "t0", 4, True, "U", (2, "x", 8, None), (2, "y", 9, None), None), ("s2", "t1", 2, True, None, None, None, add("t1")), ("s2", "t1", 3, True, "I", None, (4, "x", 7, None), None)), 1)
    assert sorted(map(tuple, target.read().collect()), key=str) == [(1, "x", None), (2, "y", 9), (3, "x", None), (4, "x", 7)]
    assert target.side("waiting") is None and not safe.on((), 1e9)
    with pytest.raises(ValueError, match="statement 1"):
        run.batch(log_of(spark, ("s1", "t0", 5, True, None, None, None, "ALTER TABLE app.t0 DROP COLUMN a"), ("s2", "t1", 5, True, None, None, None, "ALTER TABLE app.t1 DROP COLUMN b")), 2)


def test_safe_mode_deletes_old_rows_first(spark, tmp_path):
    """After a start in the middle of the log, an update whose old row is another one at the target."""
    log = log_of(spark, ("s", "t", 1, True, "U", (1, "x", 0, None), (1, "y", 0, None), None))
    assert [r.op for r in Task(["id"]).delta(log.drop("ddl"), True).collect()] == ["U"]
    for safe, asked in ((SafeMode(always=True), True), (SafeMode(exit_point=(1, 1, 5, 0)), True), (SafeMode(started=100.0), True), (SafeMode(), False)):
        seen = []
        task = Task(["id"])
        own = task.delta
        task.delta = lambda rows, on, own=own, seen=seen: (seen.append(on), own(rows, on))[1]
        Replication(task, MergedTable(spark, str(tmp_path / f"t{id(safe)}"), ["id"], "id int, a string", 2), safe=safe, clock=lambda: 120.0).batch(log, 0)
        assert seen == [asked]


def test_windowed_counts(spark):
    assert windowed_counts(changelog(spark)).agg(F.sum("n")).first()[0] == changelog(spark).count()


def test_log_events_have_holes():
    events = log_events(200)
    assert any(b["start_pos"] > a["end_pos"] for a, b in zip(events, events[1:]) if a["file_seq"] == b["file_seq"])


def test_rules_change_between_batches(spark, tmp_path):
    target = MergedTable(spark, str(tmp_path / "t"), ["id"], "id int, a string", 2)
    run = Replication(Task(["id"]), target)
    run.batch(log_of(spark, ("s", "t", 1, True, "I", None, (1, "x", 0, None), None)), 0)
    run.update(Task(["id"], filters=[RowFilter(insert="id > 1")]))
    run.batch(log_of(spark, ("s", "t", 2, True, "I", None, (2, "x", 0, None), None)), 1)
    assert [r.id for r in target.read().collect()] == [1]
    with pytest.raises(ValueError, match="key"):
        run.update(Task(["a"]))


def test_passing_errors_are_tried_again():
    class Query:
        def __init__(self, error):
            self.error = error

        def awaitTermination(self):  # noqa: N802
            if self.error:
                raise self.error

    waits = []
    left = [RuntimeError("Connection reset by peer"), RuntimeError("read timed out"), None]
    assert supervised(lambda: Query(left.pop(0)), sleep=waits.append) == 3 and waits == [1.0, 2.0]
    with pytest.raises(ValueError, match="wrong"):
        supervised(lambda: Query(ValueError("wrong statement")), sleep=waits.append)
    with pytest.raises(RuntimeError, match="timeout"):
        supervised(lambda: Query(RuntimeError("timeout")), tries=2, sleep=waits.append)


def test_the_first_source_that_can_be_read(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(3).write.parquet(path)
    assert first_of([lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.read.parquet(path)]).count() == 3
    with pytest.raises(Exception, match="none"):
        first_of([lambda: spark.read.parquet(str(tmp_path / "none"))])
