"""Checks before a task starts: its rules, its sources, and the schemas behind each target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from .ddl import Schema
from .lattice import Conflict, join_all


@dataclass(frozen=True)
class Result:
    name: str
    state: str
    detail: str = ""


def shard_schemas(schemas: Mapping[str, Schema], optimistic: bool = False) -> Result:
    """Pessimistic: all equal by columns and keys; optimistic: they have a join."""
    if optimistic:
        try:
            join_all(schemas[k] for k in sorted(schemas))
        except Conflict as e:
            return Result("shard schemas", "fail", str(e))
        return Result("shard schemas", "success")
    first = next(iter(schemas.values()))
    for name, s in schemas.items():
        if [(c.name.lower(), c.type) for c in s.columns] != [(c.name.lower(), c.type) for c in first.columns]:
            return Result("shard schemas", "fail", f"{name}: other columns")
    return Result("shard schemas", "success")


def auto_increment(schemas: Mapping[str, Schema], mapped: Sequence[str] = ()) -> Result:
    """An auto-increment key of several shards collides at the target, unless its column is mapped."""
    bad = [f"{n}.{c.name}" for n, s in schemas.items() for c in s.columns if c.auto_increment and c.name not in mapped and any(c.name in k[1] and k[2] for k in s.keys)]
    return Result("auto increment", "warn" if len(schemas) > 1 and bad else "success", ", ".join(bad))


def table_schema(name: str, s: Schema) -> Result:
    keyed = any(u and (k == "PRIMARY" or all(not (s.column(c) or s.columns[0]).nullable for c in cs)) for k, cs, u in s.keys)
    return Result("table schema", "success" if keyed else "warn", "" if keyed else f"{name}: no primary or not-null unique key")


@dataclass
class TaskConfig:
    """A task: its sources with the names of the rules that each uses, and the rules by kind and name."""

    name: str
    mode: str
    sources: Sequence[str]
    rules: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    used: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    has_start: bool = False
    shard_mode: str = ""

    def problems(self) -> list[str]:
        out = []
        if not self.name:
            out.append("a task needs a name")
        if self.mode not in ("full", "incremental", "all"):
            out.append(f"unknown mode {self.mode}")
        if self.mode == "incremental" and not self.has_start:
            out.append("incremental mode needs a start")
        if self.shard_mode not in ("", "pessimistic", "optimistic"):
            out.append(f"unknown shard mode {self.shard_mode}")
        if not self.sources:
            out.append("a task needs a source")
        if len(set(self.sources)) < len(self.sources):
            out.append("a source comes twice")
        for source, kinds in self.used.items():
            for kind, names in kinds.items():
                out += [f"{source}: no {kind} rule {n}" for n in names if n not in self.rules.get(kind, {})]
        return out

    def unused(self) -> dict[str, list[str]]:
        """Rules that no source uses."""
        out = {}
        for kind, rules in self.rules.items():
            used = {n for kinds in self.used.values() for n in kinds.get(kind, ())}
            if rest := sorted(set(rules) - used):
                out[kind] = rest
        return out
