"""Schema history, safe mode, catalog DDL, configured tasks, and file loads that happen once."""

from __future__ import annotations

import pytest

from floodplain.plans import checks, ddl, history, task
from floodplain.queries import TASK
from floodplain.operators.rules import EventRule, Route, route
from floodplain.sources.merged import MergedTable, load_files
from floodplain.sources.tables import jdbc_snapshot

T = ("db", "t")


def test_history_follows_statements(spark):
    h = history.History()
    h.track("CREATE TABLE t (id int PRIMARY KEY, KEY k (id)); ", (1, 4), "db")
    h.track("ALTER TABLE t ADD a int", (1, 9), "db")
    h.track("flush privileges", (1, 10), "db")
    h.track("RENAME TABLE t TO u", (2, 4), "db")
    assert h.get(T) is None and [c.name for c in h.get(("db", "u")).columns] == ["id", "a"] and h.single_column_keys(("db", "u"), "ID") == ["PRIMARY", "k"]
    h.track("CREATE TABLE v LIKE u", (3, 1), "db")
    assert history.History.of(h.table(spark).collect()).get(("db", "v")) == h.get(("db", "v"))
    h.track("DROP DATABASE db", (4, 1))
    assert not h.versions


def test_history_by_location_and_fallbacks(spark):
    h = history.History()
    h.track("CREATE TABLE t (id int)", (1, 4), "db")
    h.track("ALTER TABLE t ADD a int", (1, 9), "db")
    assert len(h.get(T, (1, 8)).columns) == 1 and len(h.get(T, (1, 9)).columns) == 2 and h.get(T, (1, 1)) is None
    target = spark.createDataFrame([], "id int, name string, at timestamp_ntz, d decimal(9,2)")
    other = ("db", "other")
    found = h.resolve(other, (5, 5), target=target)
    assert [(c.name, c.type) for c in found.columns] == [("id", "int"), ("name", "longtext"), ("at", "datetime"), ("d", "decimal(9,2)")]
    assert h.put_first(other, ddl.Schema()) == found and history.loads(history.dumps(found)) == found
    assert h.resolve(("db", "none"), (1, 1)) is None and h.resolve(("db", "w"), (1, 1), flushed=history.dumps(found)) == found


def test_spark_types():
    s = ddl.create_schema("CREATE TABLE t (a bigint unsigned, b mediumint unsigned, c decimal(65,2), d decimal(7,2), e enum('x','y'), f datetime(3), g time, h varbinary(3), i tinyint(1), j json)")
    st = history.struct_type(s)
    assert [f.dataType.simpleString() for f in st] == ["decimal(20,0)", "int", "string", "decimal(7,2)", "int", "timestamp_ntz", "interval day to second", "binary", "tinyint", "string"]
    assert st["e"].metadata == {"labels": ["x", "y"]}
    assert history.sql_modes((1 << 2) | (1 << 24)) == ["ANSI_QUOTES", "NO_ZERO_DATE"]
    assert history.sql_mode_of(b"\x00\x00\x00\x00\x00\x01" + (5).to_bytes(8, "little")) == 5 and history.sql_mode_of(b"\x02") is None


def test_safe_mode():
    m = history.SafeMode(exit_point=(2, 4), started=100.0)
    assert m.on((1, 9), 1000.0) and m.on((2, 4), 1000.0) and not m.on((2, 5), 1000.0) and m.on((3, 1), 159.0)
    m.add(1)
    assert m.on((3, 1), 1000.0)
    m.add(-1)
    assert not m.on((3, 1), 1000.0) and history.SafeMode(always=True).on((), 1e9)


def test_catalog_statements_are_repeatable(spark):
    run = history.Statements(spark).run
    spark.sql("DROP DATABASE IF EXISTS fp CASCADE")
    assert run("CREATE DATABASE fp") and not run("CREATE DATABASE fp")
    assert run("CREATE TABLE fp.t (id bigint NOT NULL, c varchar(9))") and not run("CREATE TABLE fp.t (id bigint)")
    assert run("ALTER TABLE fp.t ADD COLUMN d int") and not run("ALTER TABLE fp.t ADD COLUMN d int")
    assert run("CREATE TABLE fp.u LIKE fp.t") and spark.table("fp.u").columns == ["id", "c", "d"]
    assert run("RENAME TABLE fp.u TO fp.w") and run("DROP TABLE fp.w") and not run("DROP TABLE fp.w")
    assert run("DROP DATABASE fp") and not run("DROP DATABASE fp")


def test_configuration():
    assert task.config(TASK).problems() == [] and task.config(TASK).unused() == {}
    built = task.build(TASK, "s1", ["user_id"])
    assert built.allow.do_dbs == ("app",) and built.events[0].action == "ignore" and built.routes[1].target_table == "events" and built.filters[0].insert == "value < 5"
    bad = TASK | {"mysql-instances": [{"source-id": "s1", "route-rules": ["nope"]}], "task-mode": "incremental", "shard-mode": "x"}
    assert len(task.config(bad).problems()) == 3
    assert isinstance(checks.shard_schemas({"a": ddl.create_schema("CREATE TABLE t (a int)")}), checks.Result)


def test_alterations_reach_the_catalog(spark):
    run = history.Statements(spark).run
    run("CREATE DATABASE d_alter")
    run("CREATE TABLE d_alter.t (id int primary key, a varchar(9), b int)")
    spark.sql("INSERT INTO d_alter.t VALUES (1, '7', 5)")
    table = lambda: spark.table("d_alter.t")
    try:
        assert run("ALTER TABLE d_alter.t ADD COLUMN c int NOT NULL DEFAULT 3, ADD COLUMN d varchar(4)") and not run("ALTER TABLE d_alter.t ADD COLUMN c int")
        assert table().columns == ["id", "a", "b", "c", "d"] and tuple(table().first()) == (1, "7", 5, 3, None)
        assert run("ALTER TABLE d_alter.t DROP COLUMN b, MODIFY COLUMN a bigint") and not run("ALTER TABLE d_alter.t DROP COLUMN b")
        assert table().dtypes[:2] == [("id", "int"), ("a", "bigint")] and tuple(table().first()) == (1, 7, 3, None)
        assert run("ALTER TABLE d_alter.t CHANGE COLUMN a e varchar(20)") and run("ALTER TABLE d_alter.t RENAME COLUMN d TO f")
        assert table().dtypes == [("id", "int"), ("e", "string"), ("c", "int"), ("f", "string")] and table().first().e == "7"
        assert not run("ALTER TABLE d_alter.t ADD INDEX x (c)") and table().count() == 1
    finally:
        run("DROP DATABASE d_alter")


def test_snapshot_by_key_ranges_over_jdbc(spark):
    url = "jdbc:derby:memory:floodplain;create=true"
    rows = spark.range(1000).selectExpr("case when id % 100 = 99 then null else id - 50 end as ID", "concat('v', id) as V")
    rows.write.jdbc(url, "T", mode="overwrite")
    for n in (1, 500_000, 1_000_000):
        got = jdbc_snapshot(spark, url, "T", "ID", 0, 900, n)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and got.rdd.getNumPartitions() >= max(1, n // 200_000)
    assert jdbc_snapshot(spark, url, "T", "ID", 0, 900, 10, where="V like 'v1%'").count() == rows.where("V like 'v1%'").count()


def test_a_table_with_several_routes_is_an_error(spark):
    names = spark.createDataFrame([("a", "t1"), ("b", "t1")], "src_schema string, src_table string")
    ways = [Route("a*", "t*", "x", "t"), Route("*", "t1", "y", "t")]
    with pytest.raises(Exception, match="several routes"):
        route(names, ways).collect()
    assert route(names.where("src_schema = 'b'"), ways).first().target_schema == "y"
    assert route(names, [Route("a", "", "x"), Route("a", "t*", "z", "u"), Route("b", "t*", "z", "u"), Route("*", "t1", "z", "u")]).select("target_schema", "target_table").distinct().count() == 1


def test_the_finest_event_rule():
    order = [EventRule("~^app.*$", "t"), EventRule("a[bcdefgh]", "t"), EventRule("app*", "t"), EventRule("app", "t")]
    assert sorted(order[::-1], key=EventRule.fineness) == order


def test_files_load_once(spark, tmp_path):
    target = MergedTable(spark, str(tmp_path / "t"), ["id"], "id int, v string", 4)
    files = spark.createDataFrame([("a", 10), ("b", 20)], "filename string, end_pos long")
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x"), ("c", 4, "x")], "_file string, id int, v string")
    assert load_files(target, files.where("filename = 'a'"), rows) and not load_files(target, files.where("filename = 'a'"), rows)
    assert load_files(target, files, rows) and not load_files(target, files, rows)
    assert sorted(r.id for r in target.read().collect()) == [1, 2, 3] and target.side("files").count() == 2


@pytest.mark.parametrize("name", ["check_images"])
def test_missing_images_fail(spark, name):
    from floodplain.operators import changes

    df = spark.createDataFrame([("U", None, (1,))], "op string, before struct<id:int>, after struct<id:int>")
    with pytest.raises(Exception, match="image"):
        getattr(changes, name)(df).collect()
