"""Snapshots, unions of shards, the stored changelog, and connector messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 200_000


def snapshot(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Rows of a table; the condition and the columns reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def jdbc_snapshot(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, rows: int, where: str | None = None, **options: str) -> DataFrame:
    """A table read by key ranges of about CHUNK_ROWS rows."""
    chunks = max(1, -(-rows // CHUNK_ROWS))
    step = max(1, -(-(high - low + 1) // chunks))
    ranges = [f"{key} >= {a} and {key} < {a + step}" for a in range(low, high + 1, step)]
    ranges[0] = f"({ranges[0]} or {key} is null or {key} < {low})"
    ranges.append(f"{key} >= {low + step * len(ranges)}")
    return spark.read.jdbc(url, table, predicates=[f"({r}) and ({where})" if where else r for r in ranges], properties=dict(options))


def union_shards(shards: Mapping[object, DataFrame], member: str | None = None) -> DataFrame:
    """All rows of shards of one table, none dropped. A column that a shard lacks is null there; a column of several numeric types gets the widest.

    Columns match by name in any case; other differences of type are an error. `member` names a column for the shard's own name.
    """
    out, kinds = None, {}
    for name, df in shards.items():
        for f in df.schema:
            kinds.setdefault(f.name.lower(), set()).add(f.dataType)
        df = df.withColumn(member, F.lit(name)) if member else df
        if out is None:
            out = df
            continue
        known = {c.lower(): c for c in out.columns}
        out = out.unionByName(df.withColumnsRenamed({c: known.get(c.lower(), c) for c in df.columns}), allowMissingColumns=True)
    mixed = {c: sorted(t.simpleString() for t in ts) for c, ts in kinds.items() if len(ts) > 1 and not all(isinstance(t, T.NumericType) for t in ts)}
    if mixed:
        raise ValueError(f"shards differ in the types of {mixed}")
    return out


#: About how many changes a file of the stored log has.
LOG_ROWS = 500_000


def append_log(changes: DataFrame, path: str) -> None:
    """Adds changes to a stored log, partitioned by epoch; each file holds a range of the log's files, in the log's order.

    So there are as many files as rows ask for, not a folder for each log file with a file of each task, and a log file of any size is no single task's work.
    """
    ranged = changes.repartitionByRange("epoch", "file_seq", "pos", "row_idx").sortWithinPartitions("epoch", "file_seq", "pos", "row_idx")
    ranged.write.mode("append").option("maxRecordsPerFile", LOG_ROWS).partitionBy("epoch").parquet(path)


def read_log(spark: SparkSession, path: str, from_epoch: int = 0, from_seq: int = 0) -> DataFrame:
    """The stored log from a file on; earlier epochs are pruned by partition, earlier files by the ranges that stored files have."""
    df = spark.read.parquet(path)
    return df.where((F.col("epoch") > from_epoch) | ((F.col("epoch") == from_epoch) & (F.col("file_seq") >= from_seq)))


def stream_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("latestFirst", "false").parquet(path)


ENVELOPE_OPS = {"c": "I", "r": "I", "u": "U", "d": "D"}


def from_envelope(messages: DataFrame, image: str, value: str = "value") -> DataFrame:
    """The canonical changelog from messages of a log-reading connector: JSON with op, before, after, source and ts_ms.

    Works on a stream as on a table. Messages without an op (heartbeats, tombstones) are left out.
    """
    source = "struct<name:string,db:string,table:string,file:string,pos:bigint,row:int,gtid:string>"
    body = F.from_json(F.col(value), f"op string, before struct<{image}>, after struct<{image}>, source {source}, ts_ms bigint")
    rows = messages.select(body.alias("m")).where("m.op is not null")
    op = F.create_map(*[F.lit(x) for pair in ENVELOPE_OPS.items() for x in pair])
    return rows.select(
        F.col("m.source.name").alias("src_id"), F.col("m.source.db").alias("src_schema"), F.col("m.source.table").alias("src_table"), F.coalesce(F.regexp_extract("m.source.file", r"\|(\d+)\.", 1).try_cast("int"), F.lit(0)).alias("epoch"),
        F.regexp_extract("m.source.file", r"\.(\d+)$", 1).try_cast("long").alias("file_seq"), F.col("m.source.pos").alias("pos"), F.col("m.source.row").alias("row_idx"), F.col("m.source.gtid").alias("txn_id"), F.lit(True).alias("is_commit"),
        F.timestamp_millis("m.ts_ms").cast("timestamp_ntz").alias("ts"), op[F.col("m.op")].alias("op"), F.col("m.before").alias("before"), F.col("m.after").alias("after"),
    )


def stream_topic(spark: SparkSession, servers: str, topic: str, image: str) -> DataFrame:
    """Such messages from a topic; needs the connector's package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return from_envelope(raw.select(F.col("value").cast("string").alias("value")), image)


def log_events(n: int, rows_per_event: int = 2, seed: int = 1) -> list[dict]:
    """Made-up raw log events for tests: format, gtid, table map, rows, commit, in files with positions, and some holes."""
    import random

    rng, pos, out = random.Random(seed), 4, []
    for i in range(n):
        for kind in ("gtid", "query", "table_map", "rows", "xid"):
            size = rng.randrange(20, 60)
            start = pos + (100 if kind == "gtid" and rng.random() < 0.1 else 0)
            out.append({"file_seq": 1 + i // 50, "start_pos": start, "end_pos": start + size, "event_type": kind, "txn": i, "rows": rows_per_event if kind == "rows" else 0})
            pos = start + size
        if i % 50 == 49:
            pos = 4
    return out
