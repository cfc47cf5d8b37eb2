"""Log file names, positions and GTID sets as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = r"^(.*?)(\|\d+)?\.(\d+)$"


def file_seq(name: Column) -> Column:
    """The number of a log file; `x.1000000` comes after `x.999999`."""
    return F.regexp_extract(name, r"\.(\d+)$", 1).try_cast("long")


def file_base(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, NAME, 1), F.lit(""))


def file_epoch(name: Column) -> Column:
    """The server epoch in a name like `base|000002.000003`; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"\|(\d+)\.\d+$", 1).try_cast("int"), F.lit(0))


def _six(number: Column) -> Column:
    """At least six digits; lpad alone would cut longer numbers."""
    text = number.cast("string")
    return F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))


def with_epoch(base: Column, epoch: Column, seq: Column) -> Column:
    return F.concat(base, F.lit("|"), _six(epoch), F.lit("."), _six(seq))


def file_name(base: Column, seq: Column) -> Column:
    return F.concat(base, F.lit("."), _six(seq))


def position(text: Column) -> Column:
    """struct(file, pos) from `file:pos` or `(file, pos)`; null if it is neither."""
    p = r"^\(?\s*([^:,()]+?)\s*[:,]\s*(\d+)\s*\)?$"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("file"), F.regexp_extract(text, p, 2).cast("long").alias("pos")))


def ordered(name: Column, pos: Column, suffix: Column | None = None) -> Column:
    """A struct that orders positions across server epochs."""
    return F.struct(file_epoch(name).alias("epoch"), file_seq(name).alias("seq"), pos.cast("long").alias("pos"), (F.lit(0) if suffix is None else suffix).alias("suffix"))


# ---------------------------------------------------------------- GTID sets: map<server, array<struct<lo, hi>>>


def gtid_set(text: Column) -> Column:
    """A set from `uuid:1-5:7,uuid2:3`; domains of the other flavour, `domain-server-seq`, become 1 to seq of the domain."""
    part = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    interval = lambda s: F.struct(F.split(s, "-")[0].cast("long").alias("lo"), F.element_at(F.split(s, "-"), -1).cast("long").alias("hi"))

    def entry(s: Column) -> Column:
        maria = s.rlike(r"^\d+-\d+-\d+$")
        bits = F.split(s, ":")
        mine = F.array_sort(F.transform(F.slice(bits, F.lit(2), F.greatest(F.size(bits) - 1, F.lit(0))), interval))
        other = F.array(F.struct(F.lit(1).cast("long").alias("lo"), F.element_at(F.split(s, "-"), -1).cast("long").alias("hi")))
        return F.struct(F.when(maria, F.split(s, "-")[0]).otherwise(F.lower(bits[0])).alias("key"), F.when(maria, other).otherwise(mine).alias("value"))

    return F.map_from_entries(F.transform(part, entry))


def gtid_contains(whole: Column, part: Column) -> Column:
    """Every interval of `part` lies in one of `whole` (touching intervals are merged by gtid_normal first)."""
    inside = lambda server, spans: F.forall(spans, lambda s: F.exists(F.coalesce(F.try_element_at(whole, server), F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda w: (w["lo"] <= s["lo"]) & (s["hi"] <= w["hi"])))
    return F.forall(F.map_entries(part), lambda e: inside(e["key"], e["value"]))


def gtid_normal(set_: Column) -> Column:
    """Intervals sorted, with touching and overlapping ones merged."""

    def merged(spans: Column) -> Column:
        start = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

        def step(done: Column, s: Column) -> Column:
            last = F.element_at(done, -1)
            joined = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
            touches = s["lo"] <= last["hi"] + 1
            return F.when(F.size(done) == 0, F.array(s)).when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

        return F.aggregate(F.array_sort(spans), start, step)

    return F.transform_values(set_, lambda _, spans: merged(spans))


def gtid_equal(a: Column, b: Column) -> Column:
    return gtid_contains(a, b) & gtid_contains(b, a)


def gtid_truncated(set_: Column, end: Column) -> Column:
    """Each server's intervals cut at the end that `end` (another set) has for it; servers that it doesn't have stay, those without intervals go."""

    def cut(server: Column, spans: Column) -> Column:
        limit = F.array_max(F.transform(F.try_element_at(end, server), lambda s: s["hi"]))
        short = F.filter(F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), F.least(s["hi"], limit).alias("hi"))), lambda s: s["lo"] <= s["hi"])
        return F.when(limit.isNull(), spans).otherwise(short)

    return F.map_filter(F.transform_values(set_, cut), lambda _, spans: F.size(spans) > 0)


def gtid_replaced(set_: Column, other: Column) -> Column:
    """`set_` with the servers that `other` has as they are there."""
    return F.map_concat(F.map_filter(set_, lambda k, _: ~F.map_contains_key(other, k)), other)


def gtid_text(set_: Column) -> Column:
    """`server:lo-hi:...` by server."""
    span = lambda s: F.when(s["lo"] == s["hi"], s["lo"].cast("string")).otherwise(F.concat_ws("-", s["lo"].cast("string"), s["hi"].cast("string")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(set_)), lambda e: F.concat_ws(":", e["key"], F.array_join(F.transform(e["value"], span), ":"))), ",")


def later(a: Column, a_gtid: Column, b: Column, b_gtid: Column) -> Column:
    """-1, 0 or 1: GTID containment decides where the sets are comparable, else the position structs do."""
    covers, covered = gtid_contains(a_gtid, b_gtid), gtid_contains(b_gtid, a_gtid)
    by_place = F.when(a < b, -1).when(a > b, 1).otherwise(0)
    usable = a_gtid.isNotNull() & b_gtid.isNotNull() & (F.size(a_gtid) > 0) & (F.size(b_gtid) > 0)
    return F.when(usable & covers & covered, F.when(a["suffix"] < b["suffix"], -1).when(a["suffix"] > b["suffix"], 1).otherwise(0)).when(usable & covers, 1).when(usable & covered, -1).otherwise(by_place)
