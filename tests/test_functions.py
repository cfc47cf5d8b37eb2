"""GTID sets against sets of numbers; values against Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from floodplain.functions import locations, values


def numbers(text):
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        server, *spans = part.split(":")
        for s in spans:
            lo, _, hi = s.partition("-")
            out.setdefault(server, set()).update(range(int(lo), int(hi or lo) + 1))
    return out


def random_set(rng):
    spans = lambda: ":".join(f"{a}-{a + rng.randrange(1, 6)}" if rng.random() < 0.7 else str(a) for a in (rng.randrange(1, 30) for _ in range(rng.randrange(1, 5))))
    return ",".join(f"{s}:{spans()}" for s in rng.sample("abc", rng.randrange(1, 4)))


def test_gtid_algebra(spark):
    rng = random.Random(1)
    rows = [(i, random_set(rng), random_set(rng)) for i in range(150)]
    s = lambda c: locations.gtid_normal(locations.gtid_set(F.col(c)))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    out = df.select("i", locations.gtid_contains(s("a"), s("b")).alias("c"), locations.gtid_equal(s("a"), s("b")).alias("e"), locations.gtid_text(s("a")).alias("n"), locations.gtid_text(locations.gtid_truncated(s("a"), s("b"))).alias("t"), locations.gtid_text(locations.gtid_replaced(s("a"), s("b"))).alias("r"))
    for row in out.collect():
        a, b = numbers(rows[row.i][1]), numbers(rows[row.i][2])
        assert row.c == all(v <= a.get(k, set()) for k, v in b.items()) and row.e == (a == b)
        assert numbers(row.n) == a and numbers(row.r) == a | b
        cut = {k: {x for x in v if k not in b or x <= max(b[k])} for k, v in a.items()}
        assert numbers(row.t) == {k: v for k, v in cut.items() if v}


def test_values(spark):
    df = spark.createDataFrame([(-1, None, "t_12", "a%2Fb+c", 0), (None, 5, "t_", None, 3)], "x int, big long, t string, n string, m int")
    (one, two) = df.select(
        values.unsigned(F.col("x"), "tinyint").alias("u8"), values.unsigned(F.col("x"), "int").alias("u32"), values.unsigned(F.col("x").cast("long"), "bigint").alias("u64"), values.partition_id(F.lit(7), 0, F.lit("s"), "s", F.col("t"), "t_").alias("p"),
        values.unescape_name(F.col("n")).alias("n"), values.enum_label(F.col("m"), ["a"]).alias("e"), values.set_labels(F.col("m"), ["a", "b"]).alias("s"), values.percent(F.lit(1), F.col("m")).alias("pc"), values.zero_date(F.lit("2020-00-01")).alias("z"),
        values.quote_name(F.lit("a`b")).alias("q"), values.trim_controls(F.lit("a\x00b\n")).alias("tc"), values.short_hash(F.lit("x")).alias("h"),
    ).collect()
    assert (one.u8, one.u32, int(one.u64), one.p, one.n, one.e, one.s, one.pc) == (255, 2**32 - 1, 2**64 - 1, 12 << 44 | 7, "a/b+c", "", "", 100.0)
    assert (two.u8, two.u64, two.p, two.n, two.e, two.s, two.pc) == (None, None, 7, None, None, "a,b", 33.33)
    assert (one.z, one.q, one.tc, one.h) == (True, "`a``b`", "ab", "11f6ad")


def test_positions_and_names(spark):
    df = spark.createDataFrame([("b.000009", 4), ("b.1000000", 4), ("b|000001.000003", 9), ("b|000002.000001", 1)], "f string, p int")
    order = [r.f for r in df.orderBy(locations.ordered(F.col("f"), F.col("p"))).collect()]
    assert order == ["b.000009", "b.1000000", "b|000001.000003", "b|000002.000001"]
    row = df.select(locations.with_epoch(F.lit("b"), F.lit(2), F.lit(7)).alias("e"), locations.file_name(F.lit("b"), F.lit(1234567)).alias("n"), locations.file_name(F.lit("b"), F.lit(12)).alias("m")).first()
    assert tuple(row) == ("b|000002.000007", "b.1234567", "b.000012")


@pytest.mark.parametrize(("instance", "schema", "table", "id_"), [(1, "s_1", "t_300", 7), (1, "s_1", "t_0", (1 << 44) + 7), (1, "s_x", "t_1", 7), (1, "other", "t_1", 7), (1, "s_128", "t_1", 7), (1, "s_1", "t_1", -1), (16, "s_1", "t_1", 7), (-1, "s_1", "t_1", 7)])
def test_ids_without_room_are_errors(spark, instance, schema, table, id_):
    row = spark.createDataFrame([(schema, table, id_)], "s string, t string, i long")
    with pytest.raises(Exception, match="has no room|is not"):
        row.select(values.partition_id(F.col("i"), instance, F.col("s"), "s_", F.col("t"), "t_")).collect()


def test_the_largest_ids(spark):
    rows = spark.createDataFrame([("s+127", "t.255", (1 << 44) - 1), ("s+", "t.", None), ("s+1", "t.2", 10)], "s string, t string, i long")
    got = [r[0] for r in rows.select(values.partition_id(F.col("i"), 15, F.col("s"), "s+", F.col("t"), "t.")).collect()]
    assert got == [(1 << 63) - 1, None, 15 << 59 | 1 << 52 | 2 << 44 | 10]
    assert rows.select(values.partition_id(F.col("i"), 1, F.col("s"), "", F.col("t"), "")).collect()[2][0] == 1 << 59 | 10
