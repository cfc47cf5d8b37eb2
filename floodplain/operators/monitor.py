"""Status of running work: counts, lag, rates, progress, and the locations that bound it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import percent
from .changes import apply_buckets


def job_counts(changes: DataFrame, key: Column, workers: int = 16) -> DataFrame:
    """(queue, op, target_table, n)."""
    return changes.groupBy(apply_buckets(changes, key, workers).alias("queue"), "op", F.col("src_table").alias("target_table")).agg(F.count("*").alias("n"))


def lag_seconds(in_flight: DataFrame, now: Column, offset: int = 0) -> DataFrame:
    """(lag): now less the clock offset less the earliest first event that a worker still holds."""
    first = in_flight.groupBy("worker").agg(F.min("ts").alias("ts"))
    return first.agg((F.unix_timestamp(now) - offset - F.unix_timestamp(F.min("ts"))).alias("lag"))


def rates(changes: DataFrame, seconds: int) -> DataFrame:
    """(start, n, tps, total_tps) of each span of `seconds`: changes a second in it, and from the first span to its end."""
    start = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("long")
    spans = changes.groupBy(start.alias("start")).agg(F.count("*").alias("n"))
    w = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # a row a span: as many as the log has, not its rows
    total = F.sum("n").over(w) / (F.col("start") - F.min("start").over(w) + seconds)
    return spans.select("start", "n", F.round(F.col("n") / seconds, 6).alias("tps"), F.round(total, 6).alias("total_tps"))


def remaining_bytes(files: DataFrame, file_seq: int, pos: int) -> DataFrame:
    """(remaining): bytes of the log after a position; files are (seq, size)."""
    size = F.when(F.col("seq") > file_seq, F.col("size")).when(F.col("seq") == file_seq, F.greatest(F.col("size") - pos, F.lit(0))).otherwise(0)
    return files.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("remaining"))


def eta_seconds(remaining: Column, recent_bytes: Column, seconds: Column) -> Column:
    """Time to catch up at the recent rate; null without one."""
    return F.when(recent_bytes > 0, F.ceil(remaining * seconds / recent_bytes))


def load_progress(files: DataFrame) -> DataFrame:
    """(src_table, finished_bytes, total_bytes, percent, finished) from (src_table, filename, offset, end_pos)."""
    out = files.groupBy("src_table").agg(F.sum("offset").cast("long").alias("finished_bytes"), F.sum("end_pos").cast("long").alias("total_bytes"), F.bool_and(F.col("offset") == F.col("end_pos")).alias("finished"))
    return out.withColumn("percent", percent(F.col("finished_bytes"), F.col("total_bytes")))


def tables_finished(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(src_table, finished): all expected files are there, each read to its end."""
    have = files.groupBy("src_table").agg(F.count_distinct("filename").alias("n"), F.bool_and(F.col("offset") == F.col("end_pos")).alias("ended"))
    return expected.join(have, "src_table", "left").select("src_table", (F.coalesce("n", F.lit(0)) == F.col("files")).alias("complete"), F.coalesce(F.col("ended") & (F.col("n") == F.col("files")), F.lit(False)).alias("finished"))


def lowest_unresolved(groups: DataFrame, by: list[str]) -> DataFrame:
    """The least first location of unresolved groups (resolved boolean, first struct)."""
    return groups.where("not resolved").groupBy(*by).agg(F.min("first").alias("lowest"))


def clamped(location: Column, lowest: Column) -> Column:
    """A global location held back by an unresolved group."""
    return F.when(lowest.isNull(), location).otherwise(F.least(location, lowest))


def unresolved_groups(members: DataFrame) -> DataFrame:
    """(target, synced, unsynced): sorted members by state, of groups with any that aren't synced."""
    out = members.groupBy("target").agg(F.array_sort(F.collect_set(F.when(F.col("synced"), F.col("member")))).alias("synced"), F.array_sort(F.collect_set(F.when(~F.col("synced"), F.col("member")))).alias("unsynced"))
    return out.where(F.size("unsynced") > 0)


def check_summary(results: DataFrame) -> DataFrame:
    """(total, passed, failed, warned, ok) from (state)."""
    state = lambda s: F.count_if(F.col("state") == s)
    return results.agg(F.count("*").alias("total"), state("success").alias("passed"), state("fail").alias("failed"), state("warn").alias("warned"), (state("fail") == 0).alias("ok"))


def synced(flushed: Column, master: Column, flushed_gtid: Column | None = None, master_gtid: Column | None = None) -> Column:
    """Caught up: the GTID texts are equal, or else the positions."""
    same = flushed == master
    return same if flushed_gtid is None or master_gtid is None else F.coalesce(flushed_gtid == master_gtid, F.lit(False)) | same
