"""Rules by table name: allow lists, event filters, routes. All compile to Columns, so they push down."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemas of the server itself.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys", "metrics_schema", "inspection_schema")

#: Statements that have no meaning at the target, by their first words.
SKIPPED_STATEMENTS = (
    r"^SAVEPOINT", r"^FLUSH", r"^OPTIMIZE\s+TABLE", r"^ANALYZE\s+TABLE", r"^REPAIR\s+TABLE",
    r"^DROP\s+(/\*.*?\*/\s*)?TEMPORARY\s+TABLE", r"^DROP\s+TRIGGER",
    r"^CREATE\s+(OR\s+REPLACE\s+)?(DEFINER\s*=\s*\S+\s+)?(AGGREGATE\s+)?(TRIGGER|PROCEDURE|FUNCTION|EVENT)\s", r"^(DROP|ALTER)\s+(PROCEDURE|FUNCTION|EVENT)\s",
    r"^(CREATE|ALTER)\s+(OR\s+REPLACE\s+)?(ALGORITHM\s*=\s*\S+\s+)?(DEFINER\s*=\s*\S+\s+)?(SQL\s+SECURITY\s+\S+\s+)?VIEW", r"^DROP\s+VIEW",
    r"^(CREATE|ALTER|DROP)\s+TABLESPACE", r"^CREATE\s+USER", r"^ALTER\s+USER", r"^DROP\s+USER", r"^RENAME\s+USER", r"^GRANT", r"^REVOKE", r"^SET\s+PASSWORD",
)

ROW_EVENTS = {"insert": "I", "update": "U", "delete": "D"}


def pattern_regex(pattern: str) -> str:
    """A whole-name regular expression for a pattern: `~` starts a regular expression, else `*`, `?` and `[...]` are wildcards."""
    if pattern.startswith("~"):
        return pattern[1:]
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches(column: Column, pattern: str, case_sensitive: bool = False) -> Column:
    return column.rlike(("" if case_sensitive else "(?i)") + pattern_regex(pattern))


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


@dataclass(frozen=True)
class AllowList:
    """Databases first, then tables; a table rule is (schema pattern, table pattern)."""

    do_dbs: tuple[str, ...] = ()
    ignore_dbs: tuple[str, ...] = ()
    do_tables: tuple[tuple[str, str], ...] = ()
    ignore_tables: tuple[tuple[str, str], ...] = ()
    case_sensitive: bool = False

    def condition(self, schema: str = "src_schema", table: str = "src_table") -> Column:
        s, t = F.col(schema), F.col(table)
        named = lambda pattern: matches(s, pattern, self.case_sensitive)
        both = lambda rule: named(rule[0]) & matches(t, rule[1], self.case_sensitive)
        database = any_of([named(p) for p in self.do_dbs]) if self.do_dbs else ~any_of([named(p) for p in self.ignore_dbs])
        wanted, unwanted = any_of([both(r) for r in self.do_tables]), any_of([both(r) for r in self.ignore_tables])
        if self.ignore_tables:
            chosen = wanted | ~unwanted
        else:
            chosen = wanted if self.do_tables else F.lit(True)
        return ~F.lower(s).isin(*SYSTEM_SCHEMAS) & database & chosen


def allow(df: DataFrame, rules: AllowList, schema: str = "src_schema", table: str = "src_table") -> DataFrame:
    return df.where(rules.condition(schema, table))


@dataclass(frozen=True)
class EventRule:
    """What happens to some events of the tables of a pattern; without a table pattern, of a whole schema."""

    schema: str
    table: str = ""
    events: tuple[str, ...] = ()
    statements: tuple[str, ...] = ()
    action: str = "ignore"

    def fineness(self) -> tuple[int, int, int, int]:
        """Table rules come before schema rules, longer fixed text before shorter, plain names before wildcards."""
        fixed = lambda p: 0 if p.startswith("~") else len(re.sub(r"\[[^\]]*\]|[*?]", "", p))
        return (int(bool(self.table)), fixed(self.table), fixed(self.schema), int(not re.search(r"[*?\[]|^~", self.schema) and not re.search(r"[*?\[]|^~", self.table)))

    def covers(self, schema: str, table: str, event: str | None, statement: str | None, case_sensitive: bool) -> Column:
        named = matches(F.col(schema), self.schema, case_sensitive)
        if self.table:
            named &= matches(F.col(table), self.table, case_sensitive)
        kinds = F.lit(False)
        if event and self.events:
            wanted = {e.lower() for e in self.events}
            if wanted & {"all", "all dml"}:
                wanted |= set(ROW_EVENTS)
            kinds = F.lower(F.col(event)).isin(*wanted) | (F.lit("all" in wanted))
        if statement and self.statements:
            kinds |= any_of([F.col(statement).rlike(f"(?i){p}") for p in self.statements])
        return named & F.coalesce(kinds, F.lit(False))


def event_action(rules: Sequence[EventRule], schema: str = "src_schema", table: str = "src_table", event: str | None = "event", statement: str | None = None, case_sensitive: bool = False) -> Column:
    """`do` or `ignore`, by the finest rule that covers a row."""
    out = None
    for rule in sorted(rules, key=EventRule.fineness, reverse=True):
        condition = rule.covers(schema, table, event, statement, case_sensitive)
        out = F.when(condition, rule.action) if out is None else out.when(condition, rule.action)
    return F.lit("do") if out is None else out.otherwise("do")


def row_event(op: str = "op") -> Column:
    """insert, update or delete."""
    return F.when(F.col(op) == "I", "insert").when(F.col(op) == "U", "update").when(F.col(op) == "D", "delete")


def skipped_statement(statement: Column) -> Column:
    """Whether a statement is on the built-in skip list, leading white space and comments aside."""
    bare = F.regexp_replace(statement, r"^(\s|/\*.*?\*/|--[^\n]*\n)+", "")
    return bare.rlike("(?is)" + "|".join(SKIPPED_STATEMENTS))


def only_row_events(df: DataFrame, event: str, rules: AllowList) -> DataFrame:
    """Fails on a statement-form change unless its table is excluded by name; those are dropped."""
    named = rules.condition()
    guard = F.when(~F.col(event).isin("insert", "update", "delete"), F.raise_error(F.lit("a change in statement form; row form is needed")))
    return df.where(named).where(guard.isNull())


@dataclass(frozen=True)
class Route:
    """Source patterns to a target; a route without a table pattern keeps table names."""

    schema: str
    table: str = ""
    target_schema: str = ""
    target_table: str = ""


def route(df: DataFrame, routes: Sequence[Route], schema: str = "src_schema", table: str = "src_table", case_sensitive: bool = False) -> DataFrame:
    """df with target_schema and target_table; table routes come before schema routes, no route is identity.

    A table that several routes of one kind send to different targets is an error, as its rows would land by chance.
    """
    to_schema, to_table, clash = F.col(schema), F.col(table), F.lit(False)
    for by_table in (False, True):  # a table route takes over what schema routes said, their clashes too
        found, any_, own = [], F.lit(False), F.lit(False)
        for r in routes:
            if bool(r.table) == by_table:
                condition = matches(F.col(schema), r.schema, case_sensitive)
                found.append((condition & matches(F.col(table), r.table, case_sensitive) if by_table else condition, r))
        for i, (condition, r) in enumerate(found):
            to_schema = F.when(condition, F.lit(r.target_schema)).otherwise(to_schema)
            to_table = F.when(condition, F.lit(r.target_table) if by_table and r.target_table else F.col(table)).otherwise(to_table)
            any_ |= condition
            for other, x in found[:i]:
                if (r.target_schema, r.target_table) != (x.target_schema, x.target_table):
                    own |= condition & other
        clash = F.when(any_, own).otherwise(clash)
    several = F.raise_error(F.concat(F.lit("several routes for "), F.col(schema), F.lit("."), F.col(table))).cast("string")
    return df.withColumns({"target_schema": F.when(clash, several).otherwise(to_schema), "target_table": to_table})


def target_tables(tables: DataFrame, rules: AllowList, routes: Sequence[Route]) -> DataFrame:
    """(target_schema, target_table, sources): the source tables behind each target."""
    routed = route(allow(tables, rules), routes)
    return routed.groupBy("target_schema", "target_table").agg(F.array_sort(F.collect_set(F.concat_ws(".", "src_schema", "src_table"))).alias("sources"))


def same_target_name(tables: DataFrame, schema: str = "target_schema", table: str = "target_table") -> DataFrame:
    """Targets whose names differ in case only."""
    name = F.concat_ws(".", F.col(schema), F.col(table))
    return tables.select(name.alias("name")).distinct().groupBy(F.lower("name").alias("folded")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names")).where("n > 1")


@dataclass(frozen=True)
class OnlineChange:
    """Shadow and trash tables of online schema change tools, by regular expressions with one group."""

    shadow: tuple[str, ...] = (r"^_(.+)_(?:new|gho)$",)
    trash: tuple[str, ...] = (r"^_(.+)_(?:ghc|del|old)$",)

    def checked(self) -> OnlineChange:
        """Anchored, and with exactly one group each."""
        fix = lambda p: ("" if p.startswith("^") else "^") + p + ("" if p.endswith("$") else "$")
        for p in (*self.shadow, *self.trash):
            if re.compile(p).groups != 1:
                raise ValueError(f"{p} needs exactly one group")
        return OnlineChange(tuple(map(fix, self.shadow)), tuple(map(fix, self.trash)))

    def kind(self, table: Column) -> Column:
        return F.when(any_of([table.rlike(p) for p in self.trash]), "trash").when(any_of([table.rlike(p) for p in self.shadow]), "shadow").otherwise("real")

    def real_name(self, table: Column) -> Column:
        out = table
        for p in (*self.shadow, *self.trash):
            found = F.regexp_extract(table, p, 1)
            out = F.when(found != "", found).otherwise(out)
        return out
