"""Apply and compaction against a serial replay; filters, keys and nulls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from floodplain import model
from floodplain.model import Key, Table, parse_table_id, table_id
from floodplain.operators import changes, rules, verify
from floodplain.operators.changes import RowFilter
from floodplain.operators.rules import AllowList, OnlineChange

IMAGE = "struct<id:int,v:string>"
LOG = f"seq int, op string, before {IMAGE}, after {IMAGE}"


def history(seed, keys=60, n=600):
    """A random well-formed history over keys of which half exist, with key changes and re-inserts; and both states."""
    rng = random.Random(seed)
    base = {k: f"base{k}" for k in range(0, keys, 2)}
    now, log = dict(base), []
    for seq in range(n):
        k = rng.randrange(keys)
        if k not in now:
            now[k] = f"v{seq}"
            log.append((seq, "I", None, (k, now[k])))
        elif rng.random() < 0.25:
            log.append((seq, "D", (k, now.pop(k)), None))
        else:
            new = rng.randrange(keys) if rng.random() < 0.2 else k
            if new != k and new in now:
                new = k
            old = now.pop(k)
            now[new] = f"v{seq}"
            log.append((seq, "U", (k, old), (new, now[new])))
    return base, log, now


@pytest.mark.parametrize("seed", range(4))
def test_apply_equals_serial_replay(spark, seed):
    base, log, now = history(seed)
    target = spark.createDataFrame(list(base.items()), "id int, v string")
    delta = changes.compact(changes.split_key_changes(spark.createDataFrame(log, LOG), ["id"]), ["id"], ["seq", "part_idx"])
    once = changes.apply_keyed(target, delta, ["id"])
    assert dict(map(tuple, once.collect())) == now
    assert dict(map(tuple, changes.apply_keyed(once, delta, ["id"]).collect())) == now
    safe = changes.compact(changes.safe_mode(spark.createDataFrame(log, LOG)), ["id"], ["seq", "part_idx"])
    assert dict(map(tuple, changes.apply_keyed(target, safe, ["id"]).collect())) == now
    assert verify.equal(once, spark.createDataFrame(list(now.items()), "id int, v string"), ["id"])


@pytest.mark.parametrize(("ops", "exp"), [("IU", "I"), ("ID", "D"), ("UU", "U"), ("UD", "D"), ("DI", "U"), ("IDI", "U"), ("I", "I")])
def test_compaction_table(spark, ops, exp):
    log = [(i, o, None if o == "I" else (1, "x"), None if o == "D" else (1, f"v{i}")) for i, o in enumerate(ops)]
    (row,) = changes.compact(spark.createDataFrame(log, LOG), ["id"], ["seq"]).collect()
    assert row.op == exp and row.n_changes == len(ops)
    assert row.after == (None if ops[-1] == "D" else (1, f"v{len(ops) - 1}"))


def test_keyless_bag(spark):
    t = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "b")], "id int, v string")
    log = spark.createDataFrame([(0, "D", (1, None), None), (1, "U", (2, "b"), (1, None)), (2, "D", (1, None), None)], LOG)
    assert sorted(map(tuple, changes.apply_keyless(t, log).collect())) == [(1, None), (1, None)]
    assert changes.delete_one(t, spark.createDataFrame([(1, None)], "id int, v string")).count() == 3


def test_very_many_equal_rows(spark):
    t = spark.range(10_000).select(F.lit(7).alias("id"), F.lit(None).cast("string").alias("v"))
    assert changes.delete_one(t, t.limit(100)).groupBy("id", "v").count().first()["count"] == 9_900


def test_target_wider_than_source(spark):
    target = spark.createDataFrame([(1, "a", 9)], "id int, v string, extra int")
    delta = changes.compact(spark.createDataFrame([(0, "U", (1, "a"), (1, "b")), (1, "I", None, (2, "c"))], LOG), ["id"], ["seq"])
    assert sorted(map(tuple, changes.apply_keyed(target, delta, ["id"]).collect())) == [(1, "b", 9), (2, "c", None)]


def test_filters_and_nulls(spark):
    log = spark.createDataFrame([(0, "I", None, (1, None)), (1, "I", None, (2, "x")), (2, "U", (2, "x"), (2, "y")), (3, "D", (2, "y"), None)], LOG)
    keep = lambda *f: [r.seq for r in changes.filter_rows(log, f).orderBy("seq").collect()]
    assert keep(RowFilter(insert="v = 'x'")) == [0, 2, 3]
    assert keep(RowFilter(insert="v is null")) == [1, 2, 3]
    assert keep(RowFilter(update_old="v = 'x'", update_new="v = 'z'")) == [0, 1, 2, 3]
    assert keep(RowFilter(update_new="v = 'y'")) == [0, 1, 3]
    assert keep(RowFilter(delete="missing = 'y'")) == [0, 1, 2, 3]
    assert keep(RowFilter(delete="V = 'missing' or v like 'y%'")) == [0, 1, 2]


def test_identity_and_ids():
    assert Table(("a", "b"), frozenset("a"), (Key(("a",)), Key(("b",)))).identity() == ("b",)
    assert Table(("a", "b"), frozenset("ab"), (Key(("a",)),)).identity() == ("a", "b")
    assert Table(("a",), keys=(Key(("x",)), Key(("a",), True))).identity() == ("a",)
    assert parse_table_id(table_id("a`b", "c.d")) == ("a`b", "c.d") and parse_table_id(table_id("x")) == ("x",)


def test_key_texts(spark):
    df = spark.createDataFrame([(1, None, True, 1.5e20, 0.25), (1, "x", False, -1.0e-5, 12345678.5), (None, None, None, None, None)], "a int, b string, c boolean, d double, e double")
    t = Table(("a", "b", "c", "d", "e"), keys=(Key(("a", "b")), Key(("b",)), Key(("c", "d", "e"))))
    rows = [r.k for r in df.select(changes.row_keys(df, t).alias("k")).collect()]
    assert rows == [["1.a", "1.c.150000000000000000000.d.0.25.e"], ["1.a.x.b", "x.b", "0.c.-0.00001.d.12345678.5.e"], []]


def test_causality_stream():
    assert changes.causality([("i", ["1", "a"]), ("i", ["2", "b"]), ("u", ["1", "2"])]) == ["i", "i", "conflict", "u"]


@pytest.mark.parametrize(
    ("rule", "kept"),
    [
        (AllowList(), {"a.t", "a.u", "b.t"}),
        (AllowList(do_dbs=("a",)), {"a.t", "a.u"}),
        (AllowList(ignore_dbs=("~^a$",)), {"b.t"}),
        (AllowList(do_tables=(("a", "t"), ("b", "*"))), {"a.t", "b.t"}),
        (AllowList(ignore_tables=(("*", "t"),)), {"a.u"}),
        (AllowList(do_dbs=("A",), case_sensitive=True), set()),
    ],
)
def test_allow_lists(spark, rule, kept):
    names = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "t"), ("mysql", "user"), ("INFORMATION_SCHEMA", "x")], "src_schema string, src_table string")
    assert {f"{r.src_schema}.{r.src_table}" for r in rules.allow(names, rule).collect()} == kept


def test_statement_form_changes_fail(spark):
    df = spark.createDataFrame([("a", "t", "insert"), ("b", "t", "statement")], "src_schema string, src_table string, event string")
    assert rules.only_row_events(df, "event", AllowList(do_dbs=("a",))).count() == 1
    with pytest.raises(Exception, match="statement form"):
        rules.only_row_events(df, "event", AllowList()).collect()


def test_online_rules_need_one_group():
    with pytest.raises(ValueError, match="one group"):
        OnlineChange(shadow=("_x",)).checked()
    assert OnlineChange(shadow=("_(.+)_s",)).checked().shadow == ("^_(.+)_s$",)


def test_events_changelog_is_well_formed(spark):
    rows = model.from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    assert {r.op: r["count"] for r in rows.groupBy("op").count().collect()} == {"D": 1580, "I": 1700, "U": 6286}
    assert rows.where((F.col("op") == "I") != F.col("before").isNull()).isEmpty() and rows.where((F.col("op") == "D") != F.col("after").isNull()).isEmpty()
