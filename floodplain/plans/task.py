"""A task from its configuration: nested mappings, as a configuration file gives them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators.changes import RowFilter
from ..operators.rules import AllowList, EventRule, Route
from ..streaming.runner import Task
from .checks import TaskConfig


def allow_list(raw: Mapping, case_sensitive: bool = False) -> AllowList:
    table = lambda key: tuple((t["db-name"], t["tbl-name"]) for t in raw.get(key, ()))
    return AllowList(tuple(raw.get("do-dbs", ())), tuple(raw.get("ignore-dbs", ())), table("do-tables"), table("ignore-tables"), case_sensitive)


def event_rule(raw: Mapping) -> EventRule:
    return EventRule(raw["schema-pattern"], raw.get("table-pattern", ""), tuple(raw.get("events", ())), tuple(raw.get("sql-pattern", ())), raw.get("action", "Do").lower())


def route_rule(raw: Mapping) -> Route:
    return Route(raw["schema-pattern"], raw.get("table-pattern", ""), raw["target-schema"], raw.get("target-table", ""))


def row_filter(raw: Mapping) -> RowFilter:
    return RowFilter(raw.get("insert-value-expr"), raw.get("update-old-value-expr"), raw.get("update-new-value-expr"), raw.get("delete-value-expr"))


def column_mapping(rules: Sequence[Mapping]):
    """changes -> changes, with mapped columns in both images."""

    def mapped(changes: DataFrame) -> DataFrame:
        for rule in rules:
            column, kind, args = rule["target-column"], rule["expression"].lower(), [str(a) for a in rule["arguments"]]
            of_table = F.col("src_schema").rlike("(?i)" + _regex(rule["schema-pattern"])) & F.col("src_table").rlike("(?i)" + _regex(rule["table-pattern"]))
            for image in ("before", "after"):
                value = F.col(f"{image}.{column}")
                if kind == "partition id":
                    new = values.partition_id(value, int(args[0] or 0), F.col("src_schema"), args[1], F.col("src_table"), args[2])
                elif kind == "add prefix":
                    new = values.add_prefix(value, args[0])
                else:
                    raise ValueError(f"unknown mapping {rule['expression']}")
                field = F.when(of_table, new.cast(changes.schema[image].dataType[column].dataType)).otherwise(value)
                changes = changes.withColumn(image, F.when(F.col(image).isNotNull(), F.col(image).withField(column, field)))
        return changes

    return mapped if rules else None


def _regex(pattern: str) -> str:
    from ..operators.rules import pattern_regex

    return pattern_regex(pattern)


def build(raw: Mapping, source: str, key: Sequence[str]) -> Task:
    """The task of one source: the rules that it names, in the order in which it names them."""
    own = next(s for s in raw["mysql-instances"] if s["source-id"] == source)
    case = bool(raw.get("case-sensitive", False))
    pick = lambda names, section: [raw.get(section, {})[n] for n in own.get(names, ())]
    allowed = own.get("block-allow-list")
    return Task(
        key,
        allow_list(raw.get("block-allow-list", {}).get(allowed, {}), case) if allowed else AllowList(case_sensitive=case),
        [event_rule(r) for r in pick("filter-rules", "filters")],
        [row_filter(r) for r in pick("expression-filters", "expression-filter")],
        [route_rule(r) for r in pick("route-rules", "routes")],
        column_mapping(pick("column-mapping-rules", "column-mappings")),
    )


SECTIONS = {"filter-rules": "filters", "route-rules": "routes", "column-mapping-rules": "column-mappings", "expression-filters": "expression-filter"}


def config(raw: Mapping) -> TaskConfig:
    """What the checks need to know of a configuration."""
    used = {s["source-id"]: {section: tuple(s.get(names, ())) for names, section in SECTIONS.items()} for s in raw["mysql-instances"]}
    return TaskConfig(raw.get("name", ""), raw.get("task-mode", ""), [s["source-id"] for s in raw["mysql-instances"]], {s: raw.get(s, {}) for s in SECTIONS.values()}, used, all("meta" in s for s in raw["mysql-instances"]), raw.get("shard-mode", ""))
