"""Row changes: expression filters, compaction, and idempotent apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DELETE, INSERT, UPDATE, Table, image_of
from .expressions import condition

# ---------------------------------------------------------------- expression filters


@dataclass(frozen=True)
class RowFilter:
    """Drops rows of one table. For updates, the old and the new expression must both hold; a missing one holds."""

    insert: str | None = None
    update_old: str | None = None
    update_new: str | None = None
    delete: str | None = None


def dropped(filters: Sequence[RowFilter], image: T.StructType, op: str = "op", before: str = "before", after: str = "after") -> Column:
    """Whether a change is dropped: by any of the filters of its kind. An expression that is null, or names an unknown column, drops nothing."""
    out = F.lit(False)
    holds = lambda text, side: F.lit(True) if text is None else condition(text, side, image)
    for f in filters:
        if f.insert is not None:
            out |= (F.col(op) == INSERT) & holds(f.insert, after)
        if f.delete is not None:
            out |= (F.col(op) == DELETE) & holds(f.delete, before)
        if f.update_old is not None or f.update_new is not None:
            out |= (F.col(op) == UPDATE) & holds(f.update_old, before) & holds(f.update_new, after)
    return out


def filter_rows(changes: DataFrame, filters: Sequence[RowFilter]) -> DataFrame:
    return changes.where(~dropped(filters, changes.schema["after"].dataType))


def dropped_counts(changes: DataFrame, filters: Sequence[RowFilter]) -> DataFrame:
    """(op, dropped, kept)."""
    gone = dropped(filters, changes.schema["after"].dataType)
    return changes.groupBy("op").agg(F.count_if(gone).alias("dropped"), F.count_if(~gone).alias("kept"))


# ---------------------------------------------------------------- compaction


def split_key_changes(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """An update that changes the key becomes a delete of the old key and, after it, an insert of the new one."""
    moved = (F.col("op") == UPDATE) & ~_all_equal("before", "after", key)
    null = lambda c: F.lit(None).cast(changes.schema[c].dataType)
    parts = F.when(moved, F.array(_change(DELETE, F.col("before"), null("after"), 0), _change(INSERT, null("before"), F.col("after"), 1))).otherwise(F.array(_change(F.col("op"), F.col("before"), F.col("after"), 0)))
    rest = [c for c in changes.columns if c not in ("op", "before", "after")]
    return changes.select(*rest, F.explode(parts).alias("part")).select(*rest, "part.op", "part.before", "part.after", "part.part_idx")


def _all_equal(a: str, b: str, key: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _change(op: str | Column, before: Column, after: Column, part: int) -> Column:
    return F.struct((F.lit(op) if isinstance(op, str) else op).alias("op"), before.alias("before"), after.alias("after"), F.lit(part).alias("part_idx"))


def safe_mode(changes: DataFrame) -> DataFrame:
    """Every update as a delete of the old row, then an upsert of the new one; inserts are upserts."""
    null = lambda c: F.lit(None).cast(changes.schema[c].dataType)
    parts = F.when(F.col("op") == UPDATE, F.array(_change(DELETE, F.col("before"), null("after"), 0), _change(INSERT, null("before"), F.col("after"), 1))).otherwise(F.array(_change(F.col("op"), F.col("before"), F.col("after"), 0)))
    rest = [c for c in changes.columns if c not in ("op", "before", "after")]
    return changes.select(*rest, F.explode(parts).alias("part")).select(*rest, "part.op", "part.before", "part.after", "part.part_idx")


def compact(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One change for each key: (key, op, after, n_changes, last order columns).

    The op is D if the last one is; else U if any was D; else the first one. An aggregation with
    partial sums, so a key with very many changes is no burden to one task.
    """
    seq = F.struct(*order)
    keyed = changes.select(*[F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in key], "op", "after", seq.alias("_seq"))
    folded = keyed.groupBy(*key).agg(F.min_by("op", "_seq").alias("_first"), F.max_by(F.struct("op", "after", "_seq"), "_seq").alias("_last"), F.bool_or(F.col("op") == DELETE).alias("_any"), F.count("*").alias("n_changes"))
    op = F.when(F.col("_last.op") == DELETE, DELETE).when(F.col("_any"), UPDATE).otherwise(F.col("_first"))
    return folded.select(*key, op.alias("op"), F.col("_last.after").alias("after"), "n_changes", *[F.col(f"_last._seq.{c}").alias(c) for c in order])


# ---------------------------------------------------------------- apply


def apply_keyed(target: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """`target` after a compacted delta: rows whose op is D go, images of its I and U come. Applying it twice is applying it once.

    One full outer join, so the delta is computed once, and its aggregation's partitioning serves the join.
    Columns that the images lack keep the target's values, and are null in new rows.
    """
    fields = set(image_of(delta, "after"))
    new = delta.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)], F.col("op").alias("_op"), F.col("after").alias("_after"))
    condition = F.lit(True)
    for i, k in enumerate(key):
        condition &= target[k] == new[f"_key_{i}"]
    both = target.join(new, condition, "full_outer").where("_op is null or _op <> 'D'")
    return both.select(*[F.when(F.col("_op").isNull(), target[c]).otherwise(F.col(f"_after.{c}")).alias(c) if c in fields else target[c].alias(c) for c in target.columns])


def apply_keyless(target: DataFrame, changes: DataFrame) -> DataFrame:
    """`target`, a table without a key, after changes: a delete takes one of the equal rows, not all of them.

    Row counts by whole-row value are enough: deletes and inserts of one value commute as long as
    every delete finds its row, so the sum of counts is the result; nothing falls below zero.
    """
    columns = target.columns
    gone = changes.where(F.col("op").isin(DELETE, UPDATE)).select(*[F.col(f"before.{c}").alias(c) for c in columns], F.lit(-1).cast("long").alias("_n"))
    came = changes.where(F.col("op").isin(INSERT, UPDATE)).select(*[F.col(f"after.{c}").alias(c) for c in columns], F.lit(1).cast("long").alias("_n"))
    return _counted(target.withColumn("_n", F.lit(1).cast("long")).unionByName(came).unionByName(gone), columns)


def delete_one(target: DataFrame, deletes: DataFrame) -> DataFrame:
    """`target` without one of its equal rows for each row of deletes (same columns)."""
    gone = deletes.select(*target.columns, F.lit(-1).cast("long").alias("_n"))
    return _counted(target.withColumn("_n", F.lit(1).cast("long")).unionByName(gone), target.columns)


def _counted(rows: DataFrame, columns: Sequence[str], at_once: int = 4096) -> DataFrame:
    """Each value as often as its counts add up to. Counts add up before the shuffle; a value with very many copies is dealt out in pieces."""
    summed = rows.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n > 0")
    pieces = summed.select(*columns, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / at_once))).alias("_piece"))
    size = F.least(F.col("_n") - F.col("_piece") * at_once, F.lit(at_once))
    few = pieces.where(f"_n <= {at_once}").select(*columns, size.alias("_size"))
    many = pieces.where(f"_n > {at_once}").select(*columns, size.alias("_size"), "_piece").repartition("_piece", *columns).drop("_piece")
    return few.unionByName(many).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_size")).alias("_i")).drop("_i")


def unique_violations(target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values of a unique key that several rows have; rows with a null in it don't count."""
    whole = F.lit(True)
    for k in key:
        whole &= F.col(k).isNotNull()
    return target.where(whole).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


# ---------------------------------------------------------------- keys as text


def key_text(column: Column, kind: str) -> Column:
    """A value in a key's text: booleans as 1 and 0, floats without exponent in their shortest form."""
    if kind == "boolean":
        return column.cast("int").cast("string")
    if kind in ("double", "float"):
        text = column.cast("string")
        part = lambda i: F.regexp_extract(text, r"^(-?)(\d)\.(\d+?)0*E(-?\d+)$", i)
        digits, power = F.concat(part(2), part(3)), part(4).try_cast("int")
        large = F.when(power >= F.length(digits) - 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat_ws(".", F.substr(digits, F.lit(1), power + 1), F.substr(digits, power + 2)))
        small = F.regexp_replace(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits), "0+$", "")
        return F.when(text.contains("E"), F.concat(part(1), F.when(power < 0, small).otherwise(large))).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return column.cast("string")


def row_keys(df: DataFrame, table: Table, prefix: str = "", table_name: Column | None = None) -> Column:
    """The texts of all unique keys of a row; null parts are left out, and a key of nulls alone gives none.

    A table without keys, or whose keys all gave none, is known by the whole row.
    """
    kinds = dict(df.select(*[F.col(prefix + c).alias(c) for c in table.columns]).dtypes)
    name = F.lit("") if table_name is None else table_name

    def text(columns: Sequence[str]) -> Column:
        parts = [F.when(F.col(prefix + c).isNotNull(), F.concat(key_text(F.col(prefix + c), kinds[c]), F.lit("."), F.lit(c))) for c in columns]
        joined = F.concat_ws(".", *parts)
        return F.when(joined != "", F.concat_ws(".", joined, F.nullif(name, F.lit(""))))

    keys = F.array_compact(F.array(*[text(k.columns) for k in table.keys])) if table.keys else F.array().cast("array<string>")
    return F.when(F.size(keys) > 0, keys).otherwise(F.array_compact(F.array(text(table.columns))))


def causality(changes: Sequence[tuple[str, Sequence[str]]]) -> list[str]:
    """The order-safe job list of (op, keys): a `conflict` barrier stands before a change whose keys belong to several relations.

    For tests and small control streams; set-based apply needs no such order.
    """
    relation: dict[str, str] = {}
    out = []
    for op, keys in changes:
        found = {relation[k] for k in keys if k in relation}
        if len(found) > 1:
            out.append("conflict")
            relation, found = {}, set()
        head = next(iter(found), keys[0] if keys else "")
        relation |= dict.fromkeys(keys, head)
        out.append(op)
    return out


def apply_buckets(df: DataFrame, key: Column, workers: int) -> Column:
    """The worker of a key: its CRC-32 modulo the number of workers."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(workers)).cast("int")


def check_images(changes: DataFrame) -> DataFrame:
    """Fails on a change without the images of its kind: rows need them whole."""
    need_old, need_new = F.col("op").isin(UPDATE, DELETE), F.col("op").isin(UPDATE, INSERT)
    bad = (need_old & F.col("before").isNull()) | (need_new & F.col("after").isNull()) | ~F.coalesce(F.col("op").isin(INSERT, UPDATE, DELETE), F.lit(False))
    return changes.where(F.when(bad, F.raise_error(F.lit("a row image is missing"))).isNull())


def without_columns(changes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Both images without some columns, such as generated ones."""
    return changes.withColumns({image: F.when(F.col(image).isNotNull(), F.col(image).dropFields(*names)) for image in ("before", "after")})


def observed(changes: DataFrame, name: str) -> DataFrame:
    """changes with counters by op that a query's progress reports, at no extra pass."""
    return changes.observe(name, *[F.count_if(F.col("op") == op).alias(label) for op, label in ((INSERT, "inserts"), (UPDATE, "updates"), (DELETE, "deletes"))], F.max("ts").alias("last_ts"))
