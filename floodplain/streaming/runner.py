"""The same operators on a stream: rules, statements, compaction and apply in foreachBatch, with commits by batch id."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..model import LOCATION, location
from ..operators.changes import RowFilter, compact, filter_rows, safe_mode, split_key_changes
from ..operators.log import furthest, without_replays
from ..operators.rules import AllowList, EventRule, Route, allow, event_action, route, row_event, skipped_statement
from ..plans import ddl
from ..plans.history import SafeMode
from ..sources.merged import Change, MergedTable


@dataclass
class Task:
    """What happens to the changes of a batch between log and target."""

    key: Sequence[str]
    allow: AllowList = field(default_factory=AllowList)
    events: Sequence[EventRule] = ()
    filters: Sequence[RowFilter] = ()
    routes: Sequence[Route] = ()
    mapping: Callable[[DataFrame], DataFrame] | None = None
    after_batch: Sequence[Callable[[DataFrame, int], None]] = ()

    def changes(self, log: DataFrame, once: bool = True) -> DataFrame:
        """In the order of the row path: names, events, column mapping, expressions, target names. `once` takes one copy of each event."""
        rows = allow(log, self.allow)
        rows = without_replays(rows) if once else rows
        if self.events:
            rows = rows.withColumn("event", row_event()).where(event_action(self.events) == "do").drop("event")
        rows = self.mapping(rows) if self.mapping else rows
        rows = filter_rows(rows, self.filters) if self.filters else rows
        return route(rows, self.routes)

    def delta(self, log: DataFrame, safe: bool = False) -> DataFrame:
        """The compacted changes. Compaction takes a repeated event as it takes one, so no shuffle is spent on telling them apart.

        In safe mode every update deletes its old row first, so changes can come again from any point on.
        """
        rows = self.changes(log, once=False)
        rows = safe_mode(rows) if safe else split_key_changes(rows, self.key)
        return compact(rows, self.key, [*LOCATION, "part_idx"])


MEMBER = ("src_id", "src_schema", "src_table")
EPOCH = "ddl_epoch"


class Replication:
    """Applies a changelog stream to a merged table; a batch that comes twice is applied once.

    A batch is one commit: the rows of the buckets that it touches, how far every table's log has been read, rows that must wait, and the
    statements followed. Only whole transactions are applied; rows after a source's last commit wait for the next batch.

    Statements come in the log as rows with `ddl` (a column that logs without statements may lack). Without `members`, each is followed where
    it stands in its source's log. With `members`, the tables (src_id, src_schema, src_table) of one shard group, a statement is followed once
    all members have reached it, and a member's rows after it wait until then; the k-th statement of every member must be the same.
    """

    def __init__(self, task: Task, target: MergedTable, members: Sequence[tuple[str, str, str]] | None = None, safe: SafeMode | None = None, clock: Callable[[], float] = time.time):
        self.task, self.target, self.members, self.safe, self.clock = task, target, members, safe, clock

    def batch(self, log: DataFrame, batch_id: int) -> None:
        change = self.target.change(batch_id)
        if not change.open:
            return
        waiting = self.target.side("waiting") if self.target.committed() >= 0 else None
        rows = log if "ddl" in log.columns else log.withColumn("ddl", F.lit(None).cast("string"))
        rows = rows.withColumn(EPOCH, F.lit(None).cast("long"))
        rows = rows if waiting is None else waiting.unionByName(rows)
        last = furthest(rows.where("is_commit"), ["src_id"], "_last")
        marked = change.stage(rows.join(F.broadcast(last), "src_id", "left").withColumn("_whole", F.col(EPOCH).isNotNull() | F.coalesce(location() <= F.col("_last"), F.lit(False))).drop("_last"))
        seen = marked.agg(F.count_if(~F.col("_whole")).alias("open"), F.count_if(F.col("_whole") & F.col("ddl").isNotNull()).alias("statements"), F.max(F.when(F.col("_whole"), location())).alias("at")).first()
        whole, rest = marked.where("_whole").drop("_whole"), marked.where("not _whole").drop("_whole")
        safe = self.safe is not None and seen["at"] is not None and self.safe.on(tuple(seen["at"]), self.clock())
        statements = self._statements(whole) if seen["statements"] else []
        held = self._followed(change, whole, statements, safe) if self.members is None else self._grouped(change, whole, statements, safe)
        keep = rest if held is None else rest.unionByName(held)
        change.side("waiting", keep if seen["open"] or held is not None else None)
        change.side("points", self.points(whole))
        change.commit()
        for callback in self.task.after_batch:
            callback(log, batch_id)

    def _apply(self, change: Change, rows: DataFrame, safe: bool) -> None:
        change.merge(self.task.delta(rows.where("ddl is null").drop("ddl", EPOCH), safe))

    def _statements(self, rows: DataFrame) -> list:
        """The new statements of a batch in the order of their logs: few rows beside the changes. Those of tables that aren't wanted, and those that are always skipped, are left out."""
        wanted = allow(rows.where(F.col("ddl").isNotNull() & F.col(EPOCH).isNull()), self.task.allow).where(~skipped_statement(F.col("ddl")))
        return wanted.select(*MEMBER, *LOCATION, "ddl", EPOCH).dropDuplicates([*MEMBER, *LOCATION]).orderBy(*MEMBER, *LOCATION).collect()

    def _followed(self, change: Change, rows: DataFrame, statements: list, safe: bool) -> None:
        """Rows and statements as they stand in each source's log."""
        seen: dict[str, tuple] = {}
        here = lambda at: F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(LOCATION, at, strict=True)])
        after = lambda: reduce(lambda x, s: x & ((F.col("src_id") != s) | (location() > here(seen[s]))), sorted(seen), F.lit(True))
        for d in sorted(statements, key=lambda r: (r.src_id, *(r[c] for c in LOCATION))):
            at = tuple(d[c] for c in LOCATION)
            self._apply(change, rows.where((F.col("src_id") == d.src_id) & (location() < here(at)) & after()), safe)
            change.alter(d.ddl)
            seen[d.src_id] = at
        self._apply(change, rows.where(after()), safe)

    def _grouped(self, change: Change, rows: DataFrame, said: list, safe: bool) -> DataFrame | None:
        """Applies what all members have reached; returns the rows that wait, if a member waits. Rows are dealt by member, and only the statements meet by target."""
        names = ["|".join(m) for m in self.members]
        counts, statements = dict.fromkeys(names, 0) | change.state["members"], change.state["statements"]
        marks = []
        for d in said:
            name = "|".join(d[c] for c in MEMBER)
            if name not in counts:
                raise ValueError(f"{name} is no member of the group")
            k, text = counts[name], ddl.renamed(d.ddl, {(d.src_schema, d.src_table): ("group", "table")}, d.src_schema)
            if k < len(statements) and statements[k] != text:
                raise ValueError(f"statement {k} of {name} is {text!r}, and of others {statements[k]!r}")
            statements += [text] * (k == len(statements))
            counts[name] = k + 1
            marks.append(tuple(d[c] for c in (*MEMBER, *LOCATION)))
        before = change.state["members"] or dict.fromkeys(names, 0)
        done, now = min((before.get(n, 0) for n in names), default=0), min(counts.values())
        own = F.coalesce(EPOCH, "_epoch", F.lit(0).cast("long"))
        numbered = self._spanned(rows, before, marks).withColumn(EPOCH, own).where("ddl is null").select(*rows.columns)
        for k in range(done, now + 1):
            self._apply(change, numbered.where(F.col(EPOCH) == k) if k > done else numbered.where(F.col(EPOCH) <= k), safe)
            if k < now:
                change.alter(statements[k])
        change.state["members"], change.state["statements"] = counts, statements
        if self.safe:
            self.safe.holders = int(now < max(counts.values()))
        return numbered.where(F.col(EPOCH) > now) if now < max(counts.values()) else None

    def _spanned(self, rows: DataFrame, before: dict[str, int], marks: list[tuple]) -> DataFrame:
        """rows with `_epoch`, how many statements of its member stand before a row: those of earlier batches, and those of marks (MEMBER, LOCATION).

        Each member's log is spans between statements, and a row meets the one that it lies in; so rows are looked at in generated code.
        """
        ends: dict[tuple, list] = {tuple(n.split("|")): [] for n in before}
        for m in marks:  # in the order of their logs
            ends.setdefault(m[: len(MEMBER)], []).append(m[len(MEMBER) :])
        spans = [(*m, low, high, before.get("|".join(m), 0) + k) for m, at in ends.items() for k, (low, high) in enumerate(zip([None, *at], [*at, None], strict=True))]
        place, names = rows.select(location()).schema[0].dataType.simpleString(), [f"_{c}" for c in MEMBER]
        table = self.target.spark.createDataFrame(spans, f"{', '.join(f'{c} string' for c in names)}, _low {place}, _high {place}, _epoch long")
        inside = (F.col("_low").isNull() | (location() > F.col("_low"))) & (F.col("_high").isNull() | (location() <= F.col("_high")))
        same = reduce(lambda x, y: x & y, [rows[c] == table[n] for c, n in zip(MEMBER, names, strict=True)])
        return rows.join(F.broadcast(table), same & inside, "left").drop(*names, "_low", "_high")

    def points(self, rows: DataFrame) -> DataFrame:
        """(MEMBER, point, ts): how far each table's log has been read, never backwards. Rows that rules drop count too."""
        new = furthest(rows, MEMBER, ts=F.col("ts"))
        old = self.target.side("points") if self.target.committed() >= 0 else None
        return new if old is None else old.unionByName(new).groupBy(*MEMBER).agg(F.max("point").alias("point"), F.max("ts").alias("ts"))

    def update(self, task: Task) -> None:
        """Other rules from the next batch on. The key stays, as the target lies in its buckets."""
        if list(task.key) != list(self.task.key):
            raise ValueError(f"the key {list(self.task.key)} can't become {list(task.key)}")
        self.task = task

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def load_then_follow(replication: Replication, snapshot: DataFrame, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """A full load as the first commit, then the log from the snapshot's location on; log rows before it find their result there already.

    The load is batch 0, so the stream's batch n is commit n + 1.
    """
    change = replication.target.change(0)
    if change.open:
        change.load(snapshot)
        change.commit()
    writer = stream.writeStream.foreachBatch(lambda df, i: replication.batch(df, i + 1)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


#: Texts in errors that another try may mend.
PASSING = ("connection", "timed out", "timeout", "temporarily", "reset by peer", "unavailable")


def supervised(start: Callable[[], StreamingQuery], tries: int = 5, wait: float = 1.0, longest: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a query to its end, and again after a passing error, with waits that double; returns how often it was started. Any other error, and the last one, is raised.

    The query goes on from its checkpoint, and batches that were committed are skipped, so a restart repeats nothing.
    """
    for n in range(1, tries + 1):
        try:
            start().awaitTermination()
            return n
        except Exception as error:
            if n == tries or not any(x in str(error).lower() for x in PASSING):
                raise
            sleep(min(longest, wait * 2 ** (n - 1)))
    return tries


def first_of(sources: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first of several sources of one log (the stored one, then the remote one) that can be read; the last one's error is raised."""
    for i, source in enumerate(sources):
        try:
            return source()
        except Exception:
            if i == len(sources) - 1:
                raise
    raise ValueError("no sources")


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """An extra: changes by op in event-time windows."""
    w = F.window("event_time", width)
    return stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late).groupBy(w, "op").agg(F.count("*").alias("n"))
