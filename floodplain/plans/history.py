"""Schemas over time, and the small decisions around a running task: safe mode, readers, statements at the target."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ddl import Column, Schema, altered, create_schema, default_of, kind, moved, references, split

#: Bits of the server's sql_mode.
SQL_MODES = {
    "REAL_AS_FLOAT": 1 << 0, "PIPES_AS_CONCAT": 1 << 1, "ANSI_QUOTES": 1 << 2, "IGNORE_SPACE": 1 << 3, "ONLY_FULL_GROUP_BY": 1 << 5, "NO_UNSIGNED_SUBTRACTION": 1 << 6,
    "NO_DIR_IN_CREATE": 1 << 7, "ANSI": 1 << 18, "NO_AUTO_VALUE_ON_ZERO": 1 << 19, "NO_BACKSLASH_ESCAPES": 1 << 20, "STRICT_TRANS_TABLES": 1 << 21, "STRICT_ALL_TABLES": 1 << 22,
    "NO_ZERO_IN_DATE": 1 << 23, "NO_ZERO_DATE": 1 << 24, "ALLOW_INVALID_DATES": 1 << 25, "ERROR_FOR_DIVISION_BY_ZERO": 1 << 26, "TRADITIONAL": 1 << 27, "HIGH_NOT_PRECEDENCE": 1 << 29, "NO_ENGINE_SUBSTITUTION": 1 << 30, "PAD_CHAR_TO_FULL_LENGTH": 1 << 31,
}


def sql_modes(bits: int) -> list[str]:
    return [name for name, bit in SQL_MODES.items() if bits & bit]


def sql_mode_of(status: bytes) -> int | None:
    """The sql_mode in a statement's status variables: code 1, eight bytes, after code 0 with four."""
    at = 5 if status[:1] == b"\x00" else 0
    return int.from_bytes(status[at + 1 : at + 9], "little") if status[at : at + 1] == b"\x01" else None


#: Source types as Spark types, by name without size.
SPARK_TYPES = {
    "tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "bit": "bigint", "date": "date", "datetime": "timestamp_ntz",
    "timestamp": "timestamp", "time": "interval day to second", "year": "int", "enum": "int", "set": "bigint", "binary": "binary", "varbinary": "binary", "tinyblob": "binary", "blob": "binary", "mediumblob": "binary", "longblob": "binary",
}
UNSIGNED_TYPES = {"tinyint": "smallint", "smallint": "int", "mediumint": "int", "int": "bigint", "bigint": "decimal(20,0)"}


def spark_type(c: Column) -> str:
    head, _, size = c.type.partition("(")
    if c.unsigned and head in UNSIGNED_TYPES:
        return UNSIGNED_TYPES[head]
    if head == "decimal":
        digits = int(size.rstrip(")").split(",")[0]) if size else 10
        return "string" if digits > 38 else "decimal(10,0)" if not size else f"decimal({size}"
    return SPARK_TYPES.get(head, "string")


def struct_type(s: Schema) -> T.StructType:
    """A tracked schema as a Spark schema; enum and set labels go to the fields' metadata."""
    out = T.StructType()
    for c in s.columns:
        labels = [x.strip().strip("'") for x in c.type[c.type.index("(") + 1 : -1].split(",")] if c.type.startswith(("enum(", "set(")) else []
        out.add(c.name, T._parse_datatype_string(spark_type(c)), c.nullable, {"labels": labels} if labels else None)  # noqa: SLF001
    return out


def schema_of(df: DataFrame) -> Schema:
    """A target's columns as a first tracked schema."""
    names = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "datetime", "binary": "longblob"}
    return Schema(tuple(Column(f.name, names.get(t := f.dataType.simpleString(), t if t.startswith("decimal") else "longtext"), f.nullable) for f in df.schema.fields))


def dumps(s: Schema) -> str:
    return json.dumps(asdict(s))


def loads(text: str) -> Schema:
    raw = json.loads(text)
    return Schema(tuple(Column(**c) for c in raw["columns"]), tuple((n, tuple(cs), u) for n, cs, u in raw["keys"]))


@dataclass
class History:
    """Versions of source schemas, each from a location on."""

    versions: dict[tuple[str, str], list[tuple[tuple, Schema]]] = field(default_factory=dict)

    def put(self, table: tuple[str, str], at: tuple, schema: Schema) -> None:
        self.versions.setdefault(table, []).append((at, schema))
        self.versions[table].sort(key=lambda v: v[0])

    def put_first(self, table: tuple[str, str], schema: Schema) -> Schema:
        """The first schema, unless there is one."""
        if table not in self.versions:
            self.put(table, (), schema)
        return self.versions[table][0][1]

    def get(self, table: tuple[str, str], at: tuple | None = None) -> Schema | None:
        found = [s for loc, s in self.versions.get(table, []) if at is None or loc <= at]
        return found[-1] if found else None

    def remove(self, table: tuple[str, str]) -> None:
        self.versions.pop(table, None)

    def track(self, statement: str, at: tuple, schema: str = "") -> None:
        """Follows a statement, also one that is skipped at the target; foreign keys and unknown statements change nothing."""
        for ddl in split(statement, schema):
            refs = [(r.schema, r.table) for r in references(ddl, schema)]
            what = kind(ddl)
            if what == "CREATE TABLE":
                self.put(refs[0], at, self.get(refs[1], at) if len(refs) > 1 else create_schema(ddl))
            elif what == "ALTER TABLE" and (now := self.get(refs[0], at)) is not None:
                self.put(refs[0], at, altered(now, ddl))
            elif what == "RENAME TABLE" and (now := self.get(refs[0], at)) is not None:
                self.remove(refs[0])
                self.put(refs[1], at, now)
            elif what == "DROP TABLE":
                self.remove(refs[0])
            elif what == "DROP DATABASE":
                for t in [t for t in self.versions if t[0] == refs[0][0]]:
                    self.remove(t)

    def resolve(self, table: tuple[str, str], at: tuple, flushed: str | None = None, first: Schema | None = None, target: DataFrame | None = None) -> Schema | None:
        """A row's schema: tracked, else from the flushed point, else the group's first one, else the target's; kept from then on."""
        found = self.get(table, at)
        if found is None:
            found = loads(flushed) if flushed else first if first is not None else schema_of(target) if target is not None else None
            if found is not None:
                self.put(table, (), found)
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(s, t, list(map(int, at)), dumps(v)) for (s, t), versions in sorted(self.versions.items()) for at, v in versions]
        return spark.createDataFrame(rows, "src_schema string, src_table string, at array<bigint>, table_info string")

    @classmethod
    def of(cls, rows: Iterable) -> History:
        out = cls()
        for r in rows:
            out.put((r.src_schema, r.src_table), tuple(r.at), loads(r.table_info))
        return out

    def single_column_keys(self, table: tuple[str, str], column: str) -> list[str]:
        s = self.get(table)
        return [n for n, cs, _ in (s.keys if s else ()) if [c.lower() for c in cs] == [column.lower()]]


@dataclass
class SafeMode:
    """Whether changes are written as delete and upsert: by setting, until the exit point, after a start, or while shard groups are open."""

    always: bool = False
    exit_point: tuple | None = None
    started: float = 0.0
    flush_seconds: float = 30.0
    holders: int = 0

    def add(self, n: int) -> None:
        self.holders = max(0, self.holders + n)

    def on(self, at: tuple, now: float) -> bool:
        if self.always or self.holders > 0:
            return True
        if self.exit_point is not None:
            if at <= self.exit_point:
                return True
            self.exit_point = None
        return now - self.started < 2 * self.flush_seconds


class Statements:
    """DDL at a Spark catalog; what is there already, or gone already, is no error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def run(self, statement: str, schema: str = "default") -> bool:
        """True if the statement changed the catalog."""
        what, refs = kind(statement), references(statement, schema)
        name = lambda r: f"`{r.schema}`.`{r.table}`" if r.table else f"`{r.schema}`"
        exists = lambda r: self.spark.catalog.tableExists(f"{r.schema}.{r.table}") if r.table else self.spark.catalog.databaseExists(r.schema)
        if what == "CREATE DATABASE":
            there = exists(refs[0])
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name(refs[0])}")
            return not there
        if what == "CREATE TABLE":
            there = exists(refs[0])
            if not there:
                like = self.spark.table(name(refs[1])).schema if len(refs) > 1 else struct_type(create_schema(statement))
                nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in like])
                self.spark.createDataFrame([], nullable).write.saveAsTable(f"{refs[0].schema}.{refs[0].table}")
            return not there
        if what in ("DROP TABLE", "DROP DATABASE"):
            there = [r for r in refs if exists(r)]
            for r in there:
                self.spark.sql(f"DROP TABLE {name(r)}" if r.table else f"DROP DATABASE {name(r)} CASCADE")
            return bool(there)
        if what == "TRUNCATE TABLE":
            self.spark.sql(f"TRUNCATE TABLE {name(refs[0])}")
            return True
        if what == "RENAME TABLE":
            for a, b in zip(refs[::2], refs[1::2], strict=True):
                if exists(a) and not exists(b):
                    self.spark.sql(f"ALTER TABLE {name(a)} RENAME TO {name(b)}")
            return True
        if what == "ALTER TABLE":
            return sum([self.alter(f"{refs[0].schema}.{refs[0].table}", part) for part in split(statement, schema)]) > 0
        return False

    def alter(self, table: str, part: str) -> bool:
        """One operation on a table's columns. New last columns go to the catalog; all else writes the table anew under another name and then takes its place.

        Keys, defaults and options of a table have no place in a Spark catalog and change nothing here; the schema history follows them.
        """
        name = ".".join(f"`{x}`" for x in table.split("."))
        fields = self.spark.table(name).schema.fields
        found = moved(Schema(tuple(Column(f.name, "?") for f in fields)), part)
        if found is None or [(c.name, c.type) for c, _ in found] == [(f.name, "?") for f in fields]:
            return False
        kept = [c for c, old in found if old is not None]
        if [(c.name, c.type) for c in kept] == [(f.name, "?") for f in fields] and all(old is None and default_of(c) is None for c, old in found[len(fields) :]):
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c.name}` {spark_type(c)}' for c, _ in found[len(fields) :])})")
            return True
        value = lambda c, old: F.col(f"`{old}`") if old is not None else F.lit(default_of(c))
        columns = [(value(c, old) if c.type == "?" else value(c, old).cast(spark_type(c))).alias(c.name) for c, old in found]
        new = f"{table}__altered"
        self.spark.sql(f"DROP TABLE IF EXISTS {'.'.join(f'`{x}`' for x in new.split('.'))}")
        self.spark.table(name).select(*columns).write.saveAsTable(new)
        self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"ALTER TABLE {'.'.join(f'`{x}`' for x in new.split('.'))} RENAME TO {name}")
        return True
