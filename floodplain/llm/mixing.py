"""Mixing sources to target weights: budgets through a domain-language-source tree, then token prefixes of seeded epochs.

The token budget flows from the root down. A node shares its budget among its
children by weight; a child that can't use its share (its documents, `max_epochs`
times over, hold fewer tokens) returns the rest, which its siblings get by
weight first; only what the whole family can't use goes up to the ancestors'
other children. Each leaf then takes documents in seeded order, epoch after
epoch (each with an order of its own), as long as the tokens before a document
are less than the leaf's budget. So a leaf overshoots by less than one document.

Order inside a leaf is by MD5 of seed, epoch and doc_id. Running sums are made in
two steps, so that a leaf with a third of all rows is no task of its own: sums by
leaf, epoch and slice (the digest's first three digits), running sums over those
few rows, then over the rows inside a slice.

The tree (leaf sizes) is gathered on the driver: one row for each source and
language, at most `max_leaves` of them, or it fails.

Defined cases: nulls in domain, language or source are a value of their own
(`none`); weights that aren't given are 1; a null text has no token and is never
taken, nor are texts without words or rows without doc_id; rows that repeat a
doc_id are each taken where that doc_id's place is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import dropped, written

PATH = ("_domain", "_lang", "_source")
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many leaves (a row of about 100 bytes for each epoch) their budgets are broadcast.
BROADCAST_LEAVES = 20_000


def shares(budget: float, children: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    """Budgets of siblings {name: (weight, capacity)}: by weight, what one can't use goes to the others by weight.

    Siblings fill up in the order of capacity by weight, so one pass in that order finds those that do.
    """
    out = dict.fromkeys(children, 0.0)
    open_ = sorted((c / w, k) for k, (w, c) in children.items() if w > 0 and c > 0)
    left, total = budget, sum(children[k][0] for _, k in open_)
    for i, (_, k) in enumerate(open_):
        weight, capacity = children[k]
        if left * weight / total < capacity:
            return out | {x: left * children[x][0] / total for _, x in open_[i:]}
        out[k] = capacity
        left, total = left - capacity, total - weight
    return out


def plan(leaves: Mapping[tuple[str, ...], int], weights: Mapping[tuple[str, ...], float], budget: float, max_epochs: int) -> dict[tuple[str, ...], int]:
    """Whole-token budgets of the leaves {path: tokens}; weights may be given for any path from the root. One walk up for capacities and one down."""
    children: dict[tuple[str, ...], set[str]] = {}
    capacity = {p: float(max_epochs * n) for p, n in leaves.items()}
    for path in leaves:
        for i in range(len(path)):
            children.setdefault(path[:i], set()).add(path[i])
    weight = lambda p: weights.get(p, 1.0)
    for prefix in sorted(children, key=len, reverse=True):
        capacity[prefix] = sum(capacity[(*prefix, n)] for n in sorted(children[prefix]) if weight((*prefix, n)) > 0)
    given = {(): min(budget, capacity.get((), 0.0))}
    for prefix in sorted(children, key=len):
        own = shares(given[prefix], {n: (weight((*prefix, n)), capacity[(*prefix, n)]) for n in sorted(children[prefix])})
        given |= {(*prefix, n): b for n, b in own.items()}
    return {p: int(given[p] + 0.5) for p in leaves}


def _order(seed: int, doc_id: str, epoch: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(epoch).cast("string"), F.lit(":"), F.col(doc_id).cast("string")))


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[tuple[str, ...], float] | None = None, share: float = 0.5, budget: int | None = None, max_epochs: int = 2, seed: int = 17, max_leaves: int = 100_000
) -> DataFrame:
    """(doc_id, lang, source, epoch, n_tokens): a row for each time that a document is taken.

    `budget` is in tokens; by default it is `share` of all tokens.
    """
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("lang", "source"))
    rows = docs.where("doc_id is not null").select(
        F.coalesce(domain.cast("string"), F.lit("none")).alias("_domain"), lang.alias("_lang"), source.alias("_source"), "doc_id", "lang", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_tokens")
    )
    rows = written(rows.where("n_tokens > 0"), "mix-rows")
    found = rows.groupBy(*PATH).agg(F.sum("n_tokens").alias("tokens")).limit(max_leaves + 1).collect()
    if len(found) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    leaves = {tuple(r[c] for c in PATH): r["tokens"] for r in found}
    total = sum(leaves.values())
    budgets = plan(leaves, weights or {}, float(budget if budget is not None else round(share * total)), max_epochs)
    spark = docs.sparkSession
    given = spark.createDataFrame([(*p, b, leaves[p]) for p, b in budgets.items() if b > 0], "_domain string, _lang string, _source string, leaf_budget long, leaf_tokens long")
    taken = written(prefixes(rows, given, len(leaves), max_epochs, seed).select("doc_id", "lang", "source", "epoch", "n_tokens"), "mix-taken")
    dropped(rows)
    return taken


def prefixes(rows: DataFrame, given: DataFrame, leaves: int, max_epochs: int, seed: int) -> DataFrame:
    """The rows that each leaf takes, epoch by epoch; `given` has a row for each leaf."""
    asked = given.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.lit(max_epochs - 1), F.floor((F.col("leaf_budget") - 1) / F.col("leaf_tokens")).cast("int")))))
    asked = asked.withColumn("before_epoch", F.col("epoch") * F.col("leaf_tokens"))
    asked = F.broadcast(asked) if leaves <= BROADCAST_LEAVES else asked
    taken = rows.join(asked, list(PATH)).withColumn("place", _order(seed, "doc_id", "epoch")).withColumn("slice", F.substring("place", 1, 3))
    keys = [*PATH, "epoch"]
    slices = taken.groupBy(*keys, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    running = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("before_slice", F.coalesce(F.sum("slice_tokens").over(running), F.lit(0))).drop("slice_tokens")
    inside = Window.partitionBy(*keys, "slice").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = taken.join(starts, [*keys, "slice"]).withColumn("before_row", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.where(F.col("before_epoch") + F.col("before_slice") + F.col("before_row") < F.col("leaf_budget"))


def two_domains(source: str = "source") -> Column:
    """The default domains: sources with an even number are `web`, those with an odd one `books`, others `other`."""
    digit = F.regexp_extract(F.col(source), r"(\d)$", 1)
    return F.when(digit == "", "other").when(digit.cast("int") % 2 == 0, "web").when(digit.cast("int") % 2 == 1, "books").otherwise("other")
