"""Source against target: checksums by bucket, then rows of the buckets that differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x00null"
#: Rows in a bucket, and how many buckets' numbers (8 bytes each) are broadcast.
BUCKET_ROWS, LEAST_BUCKETS, BROADCAST_BUCKETS = 4096, 64, 100_000


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """The first 60 bits of the MD5 of all columns, nulls told from texts."""
    text = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit(MARK)) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def _bucket(key: Sequence[str], buckets: int) -> Column:
    text = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit(MARK)) for c in key])
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % buckets).cast("int")


def buckets_for(df: DataFrame) -> int:
    """So many buckets that few equal rows share one with a row that differs."""
    return max(LEAST_BUCKETS, df.count() // BUCKET_ROWS)


def bucket_sums(df: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, n, checksum); one shuffle of `buckets` rows for each task."""
    return df.select(_bucket(key, buckets).alias("bucket"), row_digest(df, columns).alias("d")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("d").alias("checksum"))


def diff_buckets(source: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, ignore: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(bucket, source_n, target_n) of the buckets whose checksums differ."""
    buckets = buckets or buckets_for(source)
    columns = [c for c in (columns or source.columns) if c not in ignore]
    a = bucket_sums(source, key, columns, buckets).toDF("bucket", "source_n", "source_sum")
    b = bucket_sums(target, key, columns, buckets).toDF("bucket", "target_n", "target_sum")
    both = a.join(b, "bucket", "full_outer")
    return both.where(~(F.col("source_n").eqNullSafe(F.col("target_n")) & F.col("source_sum").eqNullSafe(F.col("target_sum")))).select("bucket", F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("target_n", F.lit(0)).alias("target_n"))


def diff_rows(source: DataFrame, target: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, ignore: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(key, state): keys that are missing, extra or different at the target. Only rows of differing buckets are joined."""
    buckets = buckets or buckets_for(source)
    columns = [c for c in (columns or source.columns) if c not in ignore]
    wrong = diff_buckets(source, target, key, columns, (), buckets).select(F.col("bucket").alias("_b"))
    wrong = F.broadcast(wrong) if buckets <= BROADCAST_BUCKETS else wrong
    side = lambda df, name: df.select(*key, row_digest(df, columns).alias(name), _bucket(key, buckets).alias("_b")).join(wrong, "_b", "left_semi").drop("_b")
    both = side(source, "_s").join(side(target, "_t"), list(key), "full_outer")
    state = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").when(F.col("_s") != F.col("_t"), "different")
    return both.select(*key, state.alias("state")).where("state is not null")


def equal(source: DataFrame, target: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()) -> bool:
    return diff_buckets(source, target, key, ignore=ignore).isEmpty()
