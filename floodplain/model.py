"""The changelog: one row for each row event, ordered by location within its source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE = "I", "U", "D"
#: Total order of a source's events: server epoch, file number, position, row in the event.
LOCATION = ("epoch", "file_seq", "pos", "row_idx")


def changelog_schema(image: T.StructType) -> T.StructType:
    """The canonical schema for tables with this row image."""
    head = "src_id string, src_schema string, src_table string, epoch int, file_seq long, pos long, row_idx int, txn_id string, is_commit boolean, ts timestamp_ntz, op string"
    fields = T._parse_datatype_string(head).fields  # noqa: SLF001
    return T.StructType([*fields, T.StructField("before", image), T.StructField("after", image)])


def location() -> Column:
    """A struct that orders as locations do; file numbers compare as numbers, not as text."""
    return F.struct(*LOCATION)


@dataclass(frozen=True)
class Key:
    """One unique key of a table."""

    columns: tuple[str, ...]
    primary: bool = False


@dataclass(frozen=True)
class Table:
    """Key metadata of a table: column names, those that may be null, and its keys in declared order."""

    columns: tuple[str, ...]
    nullable: frozenset[str] = frozenset()
    keys: tuple[Key, ...] = ()
    generated: frozenset[str] = frozenset()

    def identity(self) -> tuple[str, ...]:
        """The columns that find a row: the primary key, else a unique key without nullable columns, else all columns."""
        for key in sorted(self.keys, key=lambda k: not k.primary):
            if key.primary or not set(key.columns) & self.nullable:
                return key.columns
        return self.columns

    @property
    def has_identity(self) -> bool:
        return any(k.primary or not set(k.columns) & self.nullable for k in self.keys)


def table_id(schema: str, table: str | None = None) -> str:
    """The printable id of a table (or schema), with backquotes doubled."""
    quote = lambda s: "`" + s.replace("`", "``") + "`"
    return quote(schema) if table is None else f"{quote(schema)}.{quote(table)}"


def parse_table_id(text: str) -> tuple[str, ...]:
    parts, at = [], 0
    while at < len(text):
        if text[at] != "`":
            raise ValueError(f"not a table id: {text}")
        at, part = at + 1, ""
        while text[at] != "`" or text[at : at + 2] == "``":
            part += text[at]
            at += 2 if text[at] == "`" else 1
        parts.append(part)
        at += 1
        if at < len(text) and text[at] != ".":
            raise ValueError(f"not a table id: {text}")
        at += 1
    return tuple(parts)


def image_of(df: DataFrame, column: str) -> list[str]:
    """Field names of a row image."""
    return df.schema[column].dataType.names


def from_events(events: DataFrame, shards: int = 4) -> DataFrame:
    """A well-formed changelog from the `events` table, of rows keyed by user_id.

    With pt the user's previous event_type: an `error` after none or another `error` is no event;
    any other `error` deletes, an event after none or `error` inserts, others update.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    pt, error = F.lag("event_type").over(w), F.col("event_type") == "error"
    rows = events.withColumn("pt", pt).where(~(error & (F.col("pt").isNull() | (F.col("pt") == "error"))))
    image = F.struct("user_id", "value", "event_type")
    previous = F.lag(image).over(w)
    op = F.when(error, DELETE).when(F.col("pt").isNull() | (F.col("pt") == "error"), INSERT).otherwise(UPDATE)
    return rows.withColumn("op", op).select(
        F.lit("s1").alias("src_id"), F.lit("app").alias("src_schema"), F.concat(F.lit("events_"), (F.col("user_id") % shards).cast("string")).alias("src_table"),
        F.lit(1).alias("epoch"), (F.floor(F.col("event_id") / 1000) + 1).cast("long").alias("file_seq"), (F.col("event_id") % 1000 * 10 + 4).cast("long").alias("pos"), F.lit(0).alias("row_idx"),
        F.floor(F.col("event_id") / 3).cast("string").alias("txn_id"), (F.col("event_id") % 3 == 2).alias("is_commit"), "ts", "op",
        F.when(F.col("op") != INSERT, previous).alias("before"), F.when(F.col("op") != DELETE, image).alias("after"), F.col("event_id").alias("seq"),
    )


def same_row(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Null-safe equality of all columns."""
    out = F.lit(True)
    for c in columns:
        out &= left[c].eqNullSafe(right[c])
    return out
