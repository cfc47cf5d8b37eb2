"""The stored log: offsets, duplicates, holes, transactions, retention, and versions of schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import locations
from ..model import LOCATION, location


def not_applied(changes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Changes at or after their table's point (src_table, point struct); tables without one have all changes. One row a table: broadcast by size."""
    points = checkpoints.select("src_table", F.col("point").alias("_point"))
    return changes.join(points, "src_table", "left").where(F.col("_point").isNull() | (location() >= F.col("_point"))).drop("_point")


def ddl_not_applied(ddls: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """DDL at its table's point has been applied already."""
    points = checkpoints.select("src_table", F.col("point").alias("_point"))
    return ddls.join(points, "src_table", "left").where(F.col("_point").isNull() | (location() > F.col("_point"))).drop("_point")


def without_replays(changes: DataFrame) -> DataFrame:
    """One copy of each event, however often it was read."""
    return changes.dropDuplicates(["src_id", *LOCATION])


def furthest(changes: DataFrame, by: Sequence[str], name: str = "point", **latest: Column) -> DataFrame:
    """(by, name, latest): the last location of each group, and the largest of some other values.

    A struct has no room in a hash aggregate, so by itself it would sort all rows. Positions of a file are numbers and have, so
    only one row a file and row number goes on to the struct.
    """
    parts = [c for c in LOCATION if c != "pos"]
    files = changes.groupBy(*by, *parts).agg(F.max("pos").alias("pos"), *[F.max(v).alias(k) for k, v in latest.items()])
    return files.groupBy(*by).agg(F.max(location()).alias(name), *[F.max(k).alias(k) for k in latest])


def by_file(changes: DataFrame, **sums: Column) -> DataFrame:
    """(src_id, epoch, file_seq) with, for each sum, its total over the source's earlier files.

    Running sums over a source's log are made file by file from these: one row a file is little, and no
    task ever holds a source's whole log.
    """
    files = changes.groupBy("src_id", "epoch", "file_seq").agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.partitionBy("src_id").orderBy("epoch", "file_seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("src_id", "epoch", "file_seq", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in sums])


def places(rows: DataFrame, name: Column, pos: Column, files: int = 4096) -> DataFrame:
    """rows with `place`, their number from 1 in the order of epoch, file and position.

    Rows are numbered within slices of some files, after the sums of the slices before: one row a slice goes
    through a window over all, and no task orders the whole log.
    """
    at = locations.ordered(name, pos)
    sliced = rows.withColumn("_at", at).withColumn("_slice", F.struct(F.col("_at.epoch").alias("epoch"), F.floor(F.col("_at.seq") / files).alias("seq")))
    over_all = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sliced.groupBy(F.col("_slice").alias("_key")).agg(F.count("*").alias("_n")).select("_key", F.coalesce(F.sum("_n").over(over_all), F.lit(0)).alias("_before"))
    numbered = sliced.join(earlier, F.col("_slice").eqNullSafe(F.col("_key")))
    own = F.row_number().over(Window.partitionBy("_slice").orderBy("_at"))
    return numbered.withColumn("place", F.col("_before") + own).drop("_at", "_slice", "_key", "_before")


def in_file() -> WindowSpec:
    return Window.partitionBy("src_id", "epoch", "file_seq").orderBy("pos", "row_idx")


def skip_rows(changes: DataFrame, consumed: DataFrame) -> DataFrame:
    """Without the first `n` row events of each (src_id), which an earlier run has consumed."""
    before = by_file(changes, _before=F.count("*")).join(consumed.select("src_id", F.col("n").alias("_skip")), "src_id", "left")
    rows = changes.join(before, ["src_id", "epoch", "file_seq"])
    return rows.withColumn("_n", F.row_number().over(in_file())).where(F.col("_before") + F.col("_n") > F.coalesce("_skip", F.lit(0))).drop("_n", "_before", "_skip")


def committed(changes: DataFrame) -> DataFrame:
    """Up to each source's last commit; later rows belong to a transaction that isn't whole."""
    last = changes.where("is_commit").groupBy("src_id").agg(F.max(location()).alias("_last"))
    return changes.join(last, "src_id").where(location() <= F.col("_last")).drop("_last")


def holes(events: DataFrame) -> DataFrame:
    """(file_seq, hole_start, hole_end): bytes between one event's end and the next one's start in a file."""
    w = Window.partitionBy("file_seq").orderBy("start_pos")
    rows = events.withColumn("_end", F.lag("end_pos").over(w))
    return rows.where("start_pos > _end").select("file_seq", F.col("_end").alias("hole_start"), F.col("start_pos").alias("hole_end"))


def filled(events: DataFrame) -> DataFrame:
    """events (file_seq, start_pos, end_pos, event_type, ...) with a `dummy` event in every hole, so that a file can be read from end to end; other columns are null there."""
    own = holes(events).select("file_seq", F.col("hole_start").alias("start_pos"), F.col("hole_end").alias("end_pos"), F.lit("dummy").alias("event_type"))
    return events.unionByName(own, allowMissingColumns=True)


def before_file(epoch: int, seq: int) -> Column:
    """A purge rule: files before a named one."""
    return F.struct("epoch", "seq") < F.struct(F.lit(epoch).cast("int").alias("epoch"), F.lit(seq).cast("long").alias("seq"))


def before_time(time: Column, modified: str = "modified") -> Column:
    """A purge rule: files that were last written before a time."""
    return F.col(modified) < time


def inactive(seconds: int, now: Column, modified: str = "modified") -> Column:
    """A purge rule: files that nothing has been written to for so long."""
    return F.unix_timestamp(now) - F.unix_timestamp(F.col(modified)) >= seconds


def purgeable(files: DataFrame, readers: DataFrame, rule: Column) -> DataFrame:
    """Files (epoch, seq, ...) that a rule lets go, before the earliest active reader's file."""
    earliest = readers.agg(F.min(F.struct("epoch", "seq")).alias("first")).scalar()
    return files.where(earliest.isNull() | (F.struct("epoch", "seq") < earliest)).where(rule)


def purge_rule(free_bytes: Column, keep_bytes: int, modified: Column, now: Column, expire_seconds: int) -> Column:
    """Why a file goes: space first, then age; null if it stays."""
    return F.when(free_bytes < keep_bytes, "space").when(F.unix_timestamp(now) - F.unix_timestamp(modified) > expire_seconds, "expired")


def valid_events(events: DataFrame) -> DataFrame:
    """Without heartbeats and events that were made up by the reader (no position or no time)."""
    return events.where("event_type <> 'heartbeat' and not artificial and pos > 0")


def first_file_with(index: DataFrame, gtid: Column, contains) -> DataFrame:
    """Of an index (seq, previous set), the last file whose previous events the wanted set holds already."""
    return index.where(contains(gtid, F.col("previous"))).agg(F.max("seq").alias("seq"))


def running_gtid(changes: DataFrame) -> DataFrame:
    """(src_id, location, last_gtid): how far each source's numbers go at each event."""
    number = F.col("txn_id").cast("long")
    files = changes.groupBy("src_id", "epoch", "file_seq").agg(F.max(number).alias("_top"))
    earlier = Window.partitionBy("src_id").orderBy("epoch", "file_seq").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("src_id", "epoch", "file_seq", F.max("_top").over(earlier).alias("_top"))
    upto = F.max(number).over(in_file().rowsBetween(Window.unboundedPreceding, 0))
    return changes.join(before, ["src_id", "epoch", "file_seq"]).select("src_id", *LOCATION, F.greatest(upto, F.col("_top")).alias("last_gtid"))


def schema_as_of(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """changes with `version`: the last one of their table at or before their location. versions: (src_table, location, version).

    A version's rows are few beside the changes: they join as a sorted array by table, not as a range join.
    """
    history = versions.groupBy("src_table").agg(F.array_sort(F.collect_list(F.struct(F.struct(*LOCATION).alias("at"), "version"))).alias("_history"))
    found = F.element_at(F.filter("_history", lambda h: h["at"] <= location()), -1)["version"]
    return changes.join(history, "src_table", "left").withColumn("version", F.when(F.size(F.filter("_history", lambda h: h["at"] <= location())) > 0, found)).drop("_history")


def new_epochs(events: DataFrame, server: str = "server_uuid") -> DataFrame:
    """events with `new_epoch`, how often the server of their source has changed up to them (from 1)."""
    files = events.groupBy("src_id", "epoch", "file_seq").agg(F.max_by(server, F.struct("pos", "row_idx")).alias("_last"))
    in_order = Window.partitionBy("src_id").orderBy("epoch", "file_seq")
    previous = files.select("src_id", "epoch", "file_seq", F.lag("_last").over(in_order).alias("_previous"))
    rows = events.join(previous, ["src_id", "epoch", "file_seq"]).withColumn("_was", F.coalesce(F.lag(server).over(in_file()), F.col("_previous")))
    rows = rows.withColumn("_c", F.coalesce((F.col("_was") != F.col(server)).cast("int"), F.lit(1))).drop("_was", "_previous")
    before = by_file(rows, _before=F.sum("_c"))
    out = rows.join(before, ["src_id", "epoch", "file_seq"])
    return out.withColumn("new_epoch", F.col("_before") + F.sum("_c").over(in_file().rowsBetween(Window.unboundedPreceding, 0))).drop("_c", "_before")


def barrier_epochs(changes: DataFrame, ddls: DataFrame) -> DataFrame:
    """changes with `ddl_epoch`, the number of their table's DDLs before them: rows of one epoch have one schema.

    In a group of shards, epoch k of the target can start when every member has had k DDLs.
    """
    marks = ddls.groupBy("src_table").agg(F.array_sort(F.collect_list(F.struct(*LOCATION))).alias("_ddls"))
    count = F.size(F.filter("_ddls", lambda d: d < location()))
    return changes.join(marks, "src_table", "left").withColumn("ddl_epoch", F.coalesce(F.when(F.col("_ddls").isNotNull(), count), F.lit(0))).drop("_ddls")


def without_gtids(changes: DataFrame, gtid: str, executed: Column, contains) -> DataFrame:
    """Without the transactions that a set holds already (`gtid` is a column of set text); their heartbeat stays in the offsets."""
    from ..functions.locations import gtid_set

    return changes.where(~F.coalesce(contains(executed, gtid_set(F.col(gtid))), F.lit(False)))


def gtid_at(changes: DataFrame, file_seq: int, pos: int) -> DataFrame:
    """(src_id, last_gtid): how far each source's numbers go in a file up to a position, purged ones before it included."""
    upto = (F.col("file_seq") < file_seq) | ((F.col("file_seq") == file_seq) & (F.col("pos") <= pos))
    return changes.where(upto).groupBy("src_id").agg(F.max(F.col("txn_id").cast("long")).alias("last_gtid"))


def drop_points(points: DataFrame, dropped: DataFrame) -> DataFrame:
    """Table points without those of dropped tables; a dropped row without table drops its whole schema."""
    whole = dropped.where("src_table is null").select("src_schema")
    return points.join(whole, "src_schema", "left_anti").join(dropped.where("src_table is not null"), ["src_schema", "src_table"], "left_anti")


def register_readers(readers: DataFrame, new: DataFrame) -> DataFrame:
    """The oldest file that each task still needs: (task, epoch, seq), a later report replaces an earlier one."""
    both = readers.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy("task").agg(F.max_by(F.struct("epoch", "seq"), "_new").alias("at"))
    return last.select("task", "at.epoch", "at.seq")


def saved_points(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points that never go back: (src_table, point), the later of both."""
    return points.unionByName(new).groupBy("src_table").agg(F.max("point").alias("point"))


def flush_due(seconds_since: Column, interval: int) -> Column:
    return seconds_since >= interval


def log_lists_equal(a: Column, b: Column) -> Column:
    """Lists without repeats that hold the same values."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def prefix_of(part: Column, whole: Column) -> Column:
    """Whether a list starts another one."""
    return F.slice(whole, F.lit(1), F.size(part)) == part
