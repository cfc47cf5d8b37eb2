"""Named queries through stored logs, streams and targets that batches change."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import changes, log, monitor, rules
from .operators.changes import RowFilter
from .operators.rules import AllowList, EventRule, Route
from .plans.history import SafeMode
from .queries import LOG, changelog, query, read
from .sources import dumpdir, merged, tables
from .storage import discard, scratch
from .streaming.runner import Replication, Task, load_then_follow, windowed_counts

ROW = "user_id long, value double, event_type string"
LAST = f"""WITH {LOG}, last AS (SELECT user_id, arg_max(op, seq) AS op, arg_max(value, seq) AS value, arg_max(event_type, seq) AS event_type, max(seq) AS seq FROM log {{where}} GROUP BY user_id)
SELECT {{columns}} FROM last WHERE op <> 'D'"""


#: About how many rows a file of a stored log has.
FILE_ROWS = 500_000


def stored(spark: SparkSession, rows: DataFrame, batches: int = 2) -> DataFrame:
    """rows as a stored log, and read as a stream of some batches in the log's order.

    The rows are made once. A batch is written after the one before, in as many files as each other batch, so that the stream, which takes
    files by their time, has whole batches; no task holds one. Rows are dealt by their places: dealt in turn, they would be sorted first.
    """
    path, made, place = scratch(spark, "flow-log"), scratch(spark, "flow-rows"), F.col("file_seq") * 100_000 + F.col("pos")
    rows.withColumn("_place", place.cast("double")).write.parquet(made)
    log_ = spark.read.parquet(made)
    bounds = log_.approxQuantile("_place", [k / batches for k in range(1, batches)], 0.001) or [float("inf")] * (batches - 1)
    files = max(1, -(-log_.count() // (batches * FILE_ROWS)))
    for k, (low, high) in enumerate(zip([float("-inf"), *bounds], [*bounds, float("inf")], strict=True), 1):
        log_.where((F.col("_place") > low) & (F.col("_place") <= high)).drop("_place").repartition(files, *model.LOCATION).write.mode("append").parquet(path)
        if files > 1 and len(spark.read.schema(rows.schema).parquet(path).inputFiles()) != k * files:
            raise RuntimeError(f"{path}: batch {k} isn't {files} files")
    discard(spark, made)
    return tables.stream_log(spark, path, rows.schema, files)


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog(spark, sf_dir).withColumn("is_commit", F.lit(True))


def followed(spark: SparkSession, rows: DataFrame, target: merged.MergedTable, **options) -> merged.MergedTable:
    """The target after a stream of rows, batch after batch."""
    Replication(Task(["user_id"], AllowList(do_dbs=("app",)), routes=(Route("app", "events_*", "m", "events"),)), target, **options).start(stored(spark, rows.drop("seq")), scratch(spark, "flow-checkpoint")).awaitTermination()
    return target


def target_of(spark: SparkSession, schema: str = ROW, key: str = "user_id") -> merged.MergedTable:
    return merged.MergedTable(spark, scratch(spark, "flow-target"), [key], schema, 8)


@query(LAST.format(where="", columns="user_id, value, event_type"))
def streamed_target(spark, sf_dir):
    """The changelog as a stream of batches into buckets."""
    return followed(spark, whole_log(spark, sf_dir), target_of(spark)).read()


@query(LAST.format(where="", columns="user_id, value, event_type"))
def streamed_safe(spark, sf_dir):
    """The same in safe mode throughout."""
    return followed(spark, whole_log(spark, sf_dir), target_of(spark), safe=SafeMode(always=True)).read()


@query(LAST.format(where="WHERE seq <= (SELECT max(seq) FROM log WHERE is_commit)", columns="user_id, value, event_type"))
def streamed_transactions(spark, sf_dir):
    """Only whole transactions: rows after the last commit wait."""
    return followed(spark, changelog(spark, sf_dir), target_of(spark)).read()


@query(f"WITH {LOG} SELECT src_table, max(file_seq * 100000 + pos)::BIGINT AS place, floor(epoch(max(ts)))::BIGINT AS last FROM log GROUP BY src_table")
def streamed_points(spark, sf_dir):
    """How far each table's log has been read, committed with the rows."""
    points = followed(spark, whole_log(spark, sf_dir), target_of(spark)).side("points")
    return points.select("src_table", (F.col("point.file_seq") * 100000 + F.col("point.pos")).alias("place"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("last"))


def _with_statements(rows: DataFrame, said: list[tuple[str, int, str]]) -> DataFrame:
    """rows, with a further image column `note`, and statements (table, after which seq, text)."""
    image = lambda side: F.when(F.col(side).isNotNull(), F.struct(f"{side}.user_id", f"{side}.value", f"{side}.event_type", F.col(f"{side}.user_id").cast("int").alias("note")))
    rows = rows.withColumns({side: image(side) for side in ("before", "after")}).withColumn("ddl", F.lit(None).cast("string"))
    one = rows.sparkSession.createDataFrame(said, "t string, s long, text string").select(
        F.lit("s1").alias("src_id"), F.lit("app").alias("src_schema"), F.col("t").alias("src_table"), F.lit(1).alias("epoch"), (F.floor(F.col("s") / 1000) + 1).cast("long").alias("file_seq"), (F.col("s") % 1000 * 10 + 8).cast("long").alias("pos"),
        F.lit(0).alias("row_idx"), F.lit("ddl").alias("txn_id"), F.lit(True).alias("is_commit"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("op"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("before", "after")], F.lit(None).cast("long").alias("seq"), F.col("text").alias("ddl"),
    )
    return rows.unionByName(one)


@query(LAST.format(where="", columns="user_id, event_type, (CASE WHEN seq > 400 THEN user_id ELSE 7 END)::BIGINT AS remark"))
def streamed_statements(spark, sf_dir):
    """Columns come, go, and get other names and types in the log: the target follows where they stand."""
    said = [("events_0", 400, "ALTER TABLE app.events_0 ADD COLUMN note int NOT NULL DEFAULT 7"), ("events_0", 600, "ALTER TABLE app.events_0 DROP COLUMN value"), ("events_1", 601, "ANALYZE TABLE app.events_1"), ("events_0", 50_000_000, "ALTER TABLE app.events_0 CHANGE COLUMN note remark bigint")]
    return followed(spark, _with_statements(whole_log(spark, sf_dir), said), target_of(spark)).read()


_GROUP = [("events_0", 100), ("events_1", 300), ("events_2", 200), ("events_3", 500)]
_HELD = " OR ".join(f"(src_table = '{t}' AND seq <= {s})" for t, s in _GROUP[:3]) + " OR src_table = 'events_3'"


def _group(spark: SparkSession, sf_dir: str, reached: int) -> merged.MergedTable:
    said = [(t, s, f"ALTER TABLE app.{t} DROP COLUMN value") for t, s in _GROUP[:reached]]
    return followed(spark, _with_statements(whole_log(spark, sf_dir), said), target_of(spark), members=[("s1", "app", t) for t, _ in _GROUP])


@query(LAST.format(where="", columns="user_id, event_type"))
def streamed_group(spark, sf_dir):
    """A shard group whose members have all reached the statement: it ran once, and no row waits."""
    return _group(spark, sf_dir, 4).read()


@query(LAST.format(where=f"WHERE {_HELD}", columns="user_id, value, event_type"))
def streamed_group_waits(spark, sf_dir):
    """A group with one member that hasn't reached the statement: rows after it wait, the rest is applied."""
    return _group(spark, sf_dir, 3).read()


@query(f"WITH {LOG} SELECT src_table, count(*) AS waiting FROM log WHERE NOT ({_HELD}) GROUP BY src_table")
def streamed_group_waiting(spark, sf_dir):
    return _group(spark, sf_dir, 3).side("waiting").groupBy("src_table").agg(F.count("*").alias("waiting"))


@query(f"""WITH {LOG}, last AS (SELECT user_id, arg_max(op, seq) AS op, arg_max(value, seq) AS value, arg_max(event_type, seq) AS event_type FROM log GROUP BY user_id)
SELECT user_id, value, event_type FROM last WHERE op <> 'D' UNION ALL SELECT -c_custkey - 1, c_acctbal, c_mktsegment FROM customer""")
def loaded_then_followed(spark, sf_dir):
    """A full load, then the stream."""
    snapshot = read(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("user_id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("event_type"))
    run = Replication(Task(["user_id"]), target_of(spark))
    load_then_follow(run, snapshot, stored(spark, whole_log(spark, sf_dir).drop("seq")), scratch(spark, "flow-checkpoint")).awaitTermination()
    return run.target.read()


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 < 3")
def loaded_files(spark, sf_dir):
    """Files of rows, some of them offered twice: each is loaded once."""
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey") % 5).alias("_file"), "c_custkey", "c_name")
    target = target_of(spark, "c_custkey long, c_name string", "c_custkey")
    for names in (["f0", "f1"], ["f1"], ["f0", "f1", "f2"]):
        merged.load_files(target, spark.createDataFrame([(n, 10) for n in names], "filename string, end_pos long"), rows)
    return target.read()


@query(f"WITH {LOG} SELECT seq, file_seq, op, user_id FROM log WHERE file_seq >= 2")
def stored_log(spark, sf_dir):
    """A stored log from a file on."""
    path = scratch(spark, "flow-log")
    tables.append_log(changelog(spark, sf_dir), path)
    return tables.read_log(spark, path, 1, 2).select("seq", "file_seq", "op", F.coalesce("after.user_id", "before.user_id").alias("user_id"))


DERBY = {"bigint": "BIGINT", "int": "INTEGER", "string": "CLOB"}


def archived(spark: SparkSession, rows: DataFrame, table: str) -> str:
    """The URL of a Derby database, archived in the shared folder, with rows as a table.

    One process at a time may write such a database, and one in memory is seen by its own process only. So executors write text, the
    driver's process loads it, and the archive is read only: any executor may open it. Derby reads local paths, so the folder must be mounted.
    """
    path = scratch(spark, "flow-derby")
    if urlparse(path).scheme not in ("", "file"):
        raise ValueError(f"{path}: the shared folder must be mounted for a Derby database")
    local, text = Path(urlparse(path).path), f"{path}/text"
    quoted = lambda c, kind: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else F.col(c).cast("string")
    rows.select(F.concat_ws(",", *[F.coalesce(quoted(c, kind), F.lit("")) for c, kind in rows.dtypes])).write.text(text)
    manager = spark.sparkContext._jvm.java.sql.DriverManager
    with tempfile.TemporaryDirectory(prefix="floodplain-") as folder:
        url = f"jdbc:derby:{folder}/db"
        connection = manager.getConnection(f"{url};create=true")
        try:
            connection.createStatement().execute(f"CREATE TABLE {table} ({', '.join(f'{c} {DERBY[kind]}' for c, kind in rows.dtypes)})")
            load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
            load.setString(1, table)
            for file in sorted((local / "text").glob("part-*")):
                load.setString(2, str(file))
                load.execute()
        finally:
            connection.close()
            try:
                manager.getConnection(f"{url};shutdown=true")
            except Py4JJavaError as error:  # how Derby tells that it has shut down
                if error.java_exception.getSQLState() != "08006":
                    raise
        with zipfile.ZipFile(local / "db.jar", "w", zipfile.ZIP_STORED) as archive:  # without compression pages are found by skipping
            for file in sorted(Path(folder).rglob("*")):
                archive.write(file, file.relative_to(folder))
    discard(spark, text)
    return f"jdbc:derby:jar:({local}/db.jar)db"


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0")
def jdbc_chunks(spark, sf_dir):
    """A table of another database, read by key ranges with a condition."""
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey as ID", "c_name as NAME", "c_nationkey as NATION")
    high = rows.agg(F.max("ID")).first()[0] or 0
    return tables.jdbc_snapshot(spark, archived(spark, rows, "CUSTOMER"), "CUSTOMER", "ID", 0, high, 5 * tables.CHUNK_ROWS, where="MOD(ID, 2) = 0").toDF("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def dump_directory(spark, sf_dir):
    """A dump directory: its files found by name, and the rows of one table's data files."""
    path = scratch(spark, "flow-dump")
    row = F.format_string("(%d,'%s')", F.col("c_custkey"), F.col("c_name"))
    text = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 3).alias("k")).agg(F.concat(F.lit("INSERT INTO `customer` (`id`,`name`) VALUES "), F.array_join(F.sort_array(F.collect_list(row)), ",\n"), F.lit(";")).alias("value"))
    text.select("value").repartition(3).write.text(path)
    names = dumpdir.files(spark.createDataFrame([("shop.customer.0001.sql",), ("shop.customer-schema.sql",)], "name string")).where("kind = 'data'")
    statements = dumpdir.statements(spark, path).crossJoin(names.select("db")) if names.count() != 1 else dumpdir.statements(spark, path)
    return dumpdir.rows(statements, "CREATE TABLE customer (id bigint PRIMARY KEY, name varchar(40), g int AS (id + 1))").drop("_file")


@query("""SELECT event_id, event_type FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'rotate' ELSE 'rows' END AS event_type, event_id % 8 = 1 AS artificial, CASE WHEN event_id % 16 = 2 THEN 0 ELSE event_id + 4 END AS pos FROM events)
WHERE event_type <> 'heartbeat' AND NOT artificial AND pos > 0""")
def valid_events(spark, sf_dir):
    """Without heartbeats and events that the reader made up."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "heartbeat").when(k % 4 == 1, "rotate").otherwise("rows").alias("event_type"), (k % 8 == 1).alias("artificial"), F.when(k % 16 == 2, 0).otherwise(k + 4).alias("pos"))
    return log.valid_events(rows).select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ignore' WHEN event_id % 3 = 1 AND event_type = 'view' THEN 'ignore' ELSE 'do' END AS action FROM events")
def statement_filter(spark, sf_dir):
    """Statements by pattern, in any case, by schema and table."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, "Drop  Table x").when(k == 1, F.concat(F.lit("alter table "), F.col("event_type"), F.lit(" add index i (c)"))).otherwise("ALTER TABLE t ADD COLUMN c int")
    rows = read(spark, sf_dir, "events").select("event_id", F.lit("app").alias("src_schema"), F.col("event_type").alias("src_table"), text.alias("statement"))
    wanted = (EventRule("app", "", (), (r"^drop\s+table",)), EventRule("app", "view", (), (r"add\s+index", r"^drop\s+table")))
    return rows.select("event_id", rules.event_action(wanted, event=None, statement="statement").alias("action"))


@query(f"WITH {LOG} SELECT seq FROM log WHERE src_table <> 'events_3'")
def only_row_events(spark, sf_dir):
    """Changes in statement form are let be only where their table isn't wanted."""
    rows = changelog(spark, sf_dir).withColumn("event", F.when(F.col("src_table") == "events_3", "query").otherwise(rules.row_event()))
    return rules.only_row_events(rows, "event", AllowList(ignore_tables=(("app", "events_3"),))).select("seq")


@query("SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS o_custkey, o_orderstatus FROM orders")
def apply_wider_target(spark, sf_dir):
    """A target with a column that the images lack keeps it."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    some = orders.where("o_orderkey % 2 = 0")
    log_ = some.select(F.lit("U").alias("op"), F.col("o_orderkey").alias("seq"), F.struct("o_orderkey", "o_custkey").alias("before"), F.struct("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey")).alias("after"))
    return changes.apply_keyed(orders, changes.compact(log_, ["o_orderkey"], ["seq"]), ["o_orderkey"])


@query(f"WITH {LOG} SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, op, count(*) AS n FROM log GROUP BY ALL")
def windowed_changes(spark, sf_dir):
    """Changes by op in event-time windows of an hour."""
    return windowed_counts(changelog(spark, sf_dir)).select(F.unix_timestamp("window.start").alias("start"), "op", "n")


@query("SELECT o_orderkey, o_custkey = 7 OR o_orderkey % 10 = 3 AS synced, o_custkey >= 30 AS flush FROM orders")
def caught_up(spark, sf_dir):
    """Caught up by position or by set, and whether points are due to be written."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = monitor.synced(c, F.lit(7).cast("long"), F.concat(F.lit("a:1-"), k % 10), F.lit("a:1-3"))
    return read(spark, sf_dir, "orders").select("o_orderkey", own.alias("synced"), log.flush_due(c, 30).alias("flush"))


@query("SELECT c_custkey, c_custkey % 4 IN (0, 1) AS equal, c_custkey % 4 IN (0, 2) AS starts FROM customer")
def list_tests(spark, sf_dir):
    """Statement lists of each row against a fixed one: equal in any order, and a start of it."""
    k = F.col("c_custkey") % 4
    held, lit = F.array(F.lit("A"), F.lit("B")), lambda *x: F.array(*map(F.lit, x))
    own = F.when(k == 0, lit("A", "B")).when(k == 1, lit("B", "A")).when(k == 2, lit("A")).otherwise(lit("C", "A"))
    return read(spark, sf_dir, "customer").select("c_custkey", log.log_lists_equal(own, held).alias("equal"), log.prefix_of(own, held).alias("starts"))


@query("""SELECT n_nationkey, '`' || replace(n_name || CASE WHEN n_nationkey % 2 = 0 THEN '`x' ELSE '' END, '`', '``') || '`' AS quoted, n_name || '.x y+z' AS plain, substr(sha1(n_name), 1, 6) AS short, n_name || 'ab' AS trimmed FROM nation""")
def names(spark, sf_dir):
    """Quoted, unescaped, hashed and trimmed names."""
    from .functions import values

    n = F.col("n_name")
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", values.quote_name(F.concat(n, F.when(F.col("n_nationkey") % 2 == 0, "`x").otherwise(""))).alias("quoted"), values.unescape_name(F.concat(n, F.lit("%2Ex%20y+z"))).alias("plain"),
        values.short_hash(n).alias("short"), values.trim_controls(F.concat(n, F.lit("\x00a\n\x7fb"))).alias("trimmed"),
    )


@query(f"WITH {LOG} SELECT count(*) FILTER (WHERE op = 'I') AS inserts, count(*) FILTER (WHERE op = 'U') AS updates, count(*) FILTER (WHERE op = 'D') AS deletes, floor(epoch(max(ts)))::BIGINT AS last_ts FROM log")
def observed_counts(spark, sf_dir):
    """Counters that a run reports at no extra pass, as a table."""
    from pyspark.sql import Observation

    seen = Observation("ops")
    rows = changelog(spark, sf_dir)
    counted = rows.observe(seen, *[F.count_if(F.col("op") == op).alias(label) for op, label in ((model.INSERT, "inserts"), (model.UPDATE, "updates"), (model.DELETE, "deletes"))], F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last_ts"))
    counted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(seen.get[c] for c in ("inserts", "updates", "deletes", "last_ts"))], "inserts long, updates long, deletes long, last_ts long")


@query(LAST.format(where="WHERE NOT (op = 'I' AND value < 5)", columns="user_id, value, event_type"))
def streamed_filters(spark, sf_dir):
    """Rules that change between two batches keep their key; here the filter is there from the start."""
    run = Replication(Task(["user_id"]), target_of(spark))
    run.update(Task(["user_id"], filters=(RowFilter(insert="value < 5"),)))
    run.start(stored(spark, whole_log(spark, sf_dir).drop("seq")), scratch(spark, "flow-checkpoint")).awaitTermination()
    return run.target.read()
