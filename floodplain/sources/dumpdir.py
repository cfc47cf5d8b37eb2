"""A dump directory as tables: file discovery by name, and rows out of INSERT text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import unescape_name
from ..plans.ddl import Schema, create_schema

#: File name endings of a dump, by what they hold.
KINDS = {"schema_create": r"^(.+)-schema-create\.sql$", "view": r"^(.+)-schema-(?:view|trigger|post)\.sql$", "schema": r"^([^.]+)\.(.+)-schema\.sql$", "data": r"^([^.]+)\.(.+?)(?:\.(\d+))?\.sql$"}


def file_kind(name: Column) -> Column:
    """schema_create, view, schema, data or other."""
    out = None
    for kind, pattern in KINDS.items():
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise("other")


def files(names: DataFrame, name: str = "name") -> DataFrame:
    """names with kind, db, table and part; escapes in names are undone. Views, triggers and routines are told apart, so that they can be left out."""
    kind, n = file_kind(F.col(name)), F.col(name)
    data, schema = KINDS["data"], KINDS["schema"]
    db = F.when(kind == "schema_create", F.regexp_extract(n, KINDS["schema_create"], 1)).when(kind == "schema", F.regexp_extract(n, schema, 1)).when(kind == "data", F.regexp_extract(n, data, 1))
    table = F.when(kind == "schema", F.regexp_extract(n, schema, 2)).when(kind == "data", F.regexp_extract(n, data, 2))
    part = F.when(kind == "data", F.coalesce(F.regexp_extract(n, data, 3).try_cast("int"), F.lit(0)))
    return names.withColumns({"kind": kind, "db": unescape_name(db), "table": unescape_name(table), "part": part})


#: One value with what ends it: a quoted text, maybe with a lead (x, b, _binary), or anything else up to a comma or bracket.
VALUE = re.compile(r"""\s*(?:_binary\s+)?(?:([xXbB])?'((?:[^'\\]+|\\.|'')*)'|"((?:[^"\\]+|\\.|"")*)"|((?:[^,()'"]|\((?:[^()]|\([^()]*\))*\))+))\s*([,)])""", re.S)
ESCAPED = {"'": re.compile(r"\\(.)|''", re.S), '"': re.compile(r'\\(.)|""', re.S)}
#: Characters that a backslash stands for.
ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}


def unescaped(text: str, quote: str) -> str:
    if "\\" not in text and quote not in text:
        return text
    return ESCAPED[quote].sub(lambda m: ESCAPES.get(m[1], m[1]) if m[1] is not None else quote, text)


def parse_values(text: str, at: int = 0) -> Iterator[list[str | bytes | None]]:
    """Rows of `(...), (...)` from a place on; quoted texts are unescaped, hex and bit literals become bytes, NULL None, others stay text."""
    while (at := text.find("(", at)) >= 0:
        row, at = [], at + 1
        while True:
            m = VALUE.match(text, at)
            if m is None:
                if not row and text[at:].lstrip()[:1] == ")":
                    at = text.index(")", at) + 1
                    break
                raise ValueError(f"a statement that breaks off or can't be read, at {text[at : at + 40]!r}")
            lead, single, double, bare, end = m.groups()
            if single is not None:
                value: str | bytes | None = unescaped(single, "'")
                if lead in ("x", "X"):
                    value = bytes.fromhex(value)
                elif lead:
                    value = int(value or "0", 2).to_bytes(max(1, -(-len(value) // 8)), "big")
            elif double is not None:
                value = unescaped(double, '"')
            else:
                word = bare.strip()
                value = None if word.upper() == "NULL" else bytes.fromhex(word[2:]) if word[:2].lower() == "0x" else word
            row.append(value)
            at = m.end()
            if end == ")":
                break
        yield row
        rest = text[at : at + 2].lstrip()[:1]
        if rest == ";":
            return


def parse_insert(statement: str) -> tuple[str, list[str] | None, Iterator[list]]:
    """(table, column names if given, rows) of an INSERT or REPLACE."""
    from ..plans.ddl import Reader

    r = Reader(statement)
    while r.peek() in ("INSERT", "REPLACE", "IGNORE", "INTO"):
        r.at += 1
    table, columns = r.table("").table, None
    if r.peek() == "(":
        columns = []
        while r.peek() != ")":
            r.at += 1
            if r.words[r.at].text not in (",", ")"):
                columns.append(r.words[r.at].name)
        r.at += 1
    if r.peek() not in ("VALUES", "VALUE"):
        raise ValueError("not an INSERT with values")
    return table, columns, parse_values(r.sql, r.words[r.at].end)


def insertable(schema: Schema) -> list[str]:
    """Columns that rows are written to: all but generated ones."""
    return [c.name for c in schema.columns if not c.generated]


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, statement) of data files; statements end with `;` and a line's end, and each is a row of its own."""
    text = spark.read.option("lineSep", ";\n").text(path)
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.trim("value").alias("statement")).where("statement rlike '(?i)^(insert|replace) '")


def rows(inserts: DataFrame, create: str) -> DataFrame:
    """Rows of INSERT statements, as texts by column name, with the file that they come from; generated columns are left out."""
    schema = create_schema(create)
    writable = insertable(schema)
    names = ["_file", *writable]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for file, statement in zip(batch.column("file").to_pylist(), batch.column("statement").to_pylist(), strict=True):
                _, columns, values = parse_insert(statement)
                given = [c.lower() for c in (columns or writable)]
                for row in values:
                    by = dict(zip(given, row, strict=True))
                    out.append([file, *[v.decode("latin-1") if isinstance(v := by.get(c.lower()), bytes) else v for c in writable]])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    return inserts.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def _location(lines: list[str]) -> dict[str, str | int]:
    out: dict[str, str | int] = {}
    for line in lines:
        name, _, value = line.strip().partition(":")
        key = {"log": "file", "pos": "pos", "gtid": "gtid"}.get(name.strip().lower())
        if key and key not in out:
            out[key] = int(value) if key == "pos" else value.strip()
    return out


def start_location(metadata: str) -> dict[str, str | int]:
    """The log position and GTID set that a dump's metadata text names."""
    return _location(metadata.splitlines())


def exit_location(metadata: str) -> dict[str, str | int] | None:
    """Where all of the dump's connections stood: changes from the start up to here may be in the dump already, so they are applied in safe mode. None if the text names no such place."""
    lines = metadata.splitlines()
    after = [i for i, line in enumerate(lines) if "after connection pool established" in line.lower()]
    return _location(lines[after[0] + 1 :]) or None if after else None


def replace_name(statement: str, old: str, new: str) -> str:
    """The first quoted occurrence of a name under another one."""
    return statement.replace(f"`{old}`", f"`{new}`", 1)
