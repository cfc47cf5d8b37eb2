"""Exact top-k inner products: a k-d tree per shard, best-first, with a propagated k-th score.

Vectors become whole numbers, floor(scale * x). Median splits of a bounded
sample cut space into cells; every row goes to its cell, and a cell with more
than `shard_rows` rows is dealt out further by a hash of the id. Each of these
shards builds its own tree: median splits along the widest side, down to
leaves, every node with the tight box of its points and their smallest id. A
box bounds a query's inner product from above; the traversal opens nodes from
the largest bound on and stops when no bound can change the result.

Two waves, each one shuffle of the vectors. In the first every query meets its
home shard, and each shard tells the box of its root. A query then goes on only
to the shards whose root's bound reaches its k-th score so far, and takes that
score along. Root boxes meet the queries in blocks and salts, so neither is gathered
anywhere. A shard is read as a stream: its rows first, then its queries, so a
task holds a shard, never all queries. Each (query, shard) pair gives at most k
rows, and the result is the best k of those: ties go to the smaller id, in the bound too.

Defined cases: vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without id. Vectors of different length are
never compared. Rows that repeat an id are candidates each; as a query such an id
asks once, by its shortest vector that comes first in the order of its numbers. A query never meets its own
id. Products are exact as long as they fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import dropped, written

LEAF = 128
#: Bounds of the sample that the splits come from: cells, and rows for each of them.
MAX_CELLS, SAMPLED = 1024, 32
#: Root boxes in a block, and queries that share a copy of it.
BOXES, ASKING = 16_384, 4096
#: Up to so many cells (16 bytes each) the table of their sizes is broadcast.
BROADCAST_CELLS = 65_536
KEY = ("dim", "cell", "sub")


class Splits:
    """Cells of space by median splits of a sample, each along the side where the sample is widest."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.at, self.below, self.cell = [], [], [], []
        self.cells = 0
        todo = [(sample, max(1, cells), -1, 0)]
        while todo:
            part, want, parent, side = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                self.below[parent][side] = node
            width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(1)
            axis = int(width.argmax())
            cut = int(np.sort(part[:, axis])[(len(part) - 1) // 2]) if len(part) else 0
            split = want > 1 and len(part) > 1 and width[axis] > 0
            self.axis.append(axis if split else 0)
            self.at.append(cut)
            self.below.append([node, node])
            self.cell.append(-1 if split else self.cells)
            if split:
                low = part[:, axis] <= cut
                todo += [(part[low], want // 2, node, 0), (part[~low], want - want // 2, node, 1)]
            else:
                self.cells += 1
        self.axis, self.at, self.below, self.cell = (np.array(x) for x in (self.axis, self.at, self.below, self.cell))

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while (open_ := self.cell[node] < 0).any():
            own = node[open_]
            node[open_] = self.below[own, (points[rows[open_], self.axis[own]] > self.at[own]).astype(np.int64)]
        return self.cell[node]


class Tree:
    """A k-d tree over the rows of a whole-number matrix."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.arange(len(points))
        self.lo, self.hi, self.least, self.span, self.children = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            part = points[order[a:b]]
            node = len(self.span)
            self.lo.append(part.min(axis=0))
            self.hi.append(part.max(axis=0))
            self.least.append(ids[order[a:b]].min())
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            side = self.hi[-1] - self.lo[-1]
            if b - a > LEAF and side.max() > 0:
                axis, mid = int(side.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid, kind="introselect")]
                todo += [(a, a + mid, node), (a + mid, b, node)]
        self.lo, self.hi = np.stack(self.lo), np.stack(self.hi)
        self.points, self.ids = points[order], ids[order]
        self.largest = int(max(points.max(), -points.min()))
        self.as_float = self.points.astype(np.float64)

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k for a query other than its own rows; only scores of at least `floor` matter."""
        bounds = upper_bounds(q[None], self.lo, self.hi)[0]
        points = self.points
        if self.largest * int(np.abs(q).max(initial=0)) * len(q) < 1 << 52:  # floats are exact then, and faster
            points, q = self.as_float, q.astype(np.float64)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-int(bounds[0]), int(self.least[0]), 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            bound = -bound
            if floor is not None and bound < floor:
                break
            if len(best) == k and (bound < best[-1] or bound == best[-1] and least > best_ids[-1]):
                if bound < best[-1]:
                    break
                continue
            for child in self.children[node]:
                heapq.heappush(heap, (-int(bounds[child]), int(self.least[child]), child))
            if not self.children[node]:
                a, b = self.span[node]
                scores, ids = (points[a:b] @ q).astype(np.int64), self.ids[a:b]
                good = ids != own
                if floor is not None:
                    good &= scores >= floor
                if len(best) == k:
                    good &= scores >= best[-1]
                if good.any():
                    best, best_ids = np.r_[best, scores[good]], np.r_[best_ids, ids[good]]
                    top = np.lexsort((best_ids, -best))[:k]
                    best, best_ids = best[top], best_ids[top]
        return best_ids, best


def upper_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(queries x boxes) bounds that no inner product with a point of the box exceeds, rounding included."""
    q, lo, hi = (x.astype(np.float64) for x in (q, lo, hi))
    most = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    slack = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T * ((q.shape[1] + 2) * 2.0**-51)
    return np.where(slack < 0.25, np.rint(most), np.ceil(most + slack))


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """(values of the columns, rows) for each run of equal values in sorted batches."""
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield tuple(place[a].tolist()), batch.slice(a, b - a)


def _vectors(part: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return part.column(name).flatten().to_numpy().reshape(len(part), dim)


FOUND = "query_id long, vec_id long, score long"
BOX = "dim int, cell int, sub int, lo array<long>, hi array<long>"


def _wave(rows: DataFrame, queries: DataFrame, k: int, boxes: bool) -> DataFrame:
    """FOUND of each query (id, v, floor) against the shard named beside it; and with `boxes`, in rows of their own, BOX of every shard."""
    both = rows.select(*KEY, F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("long").alias("floor"))
    both = both.unionByName(queries.select(*KEY, F.lit(1).alias("kind"), "id", "v", "floor")).repartition(*KEY).sortWithinPartitions(*KEY, "kind")
    names = [x.split()[0] for x in (FOUND + (", " + BOX if boxes else "")).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None

        def box() -> pa.RecordBatch:
            lo, hi = (f([f(x, axis=0) for x, _ in held], axis=0) for f in (np.min, np.max))
            none = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, *[pa.array([x], pa.int32()) for x in at], *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (lo, hi)]], names)

        for (*key, kind), part in _groups(batches, (*KEY, "kind")):
            if tuple(key) != at:
                if boxes and held:
                    yield box()
                at, held, tree = tuple(key), [], None
            ids, vectors = part.column("id").to_numpy(), _vectors(part, "v", key[0])
            if kind == 0:
                held.append((vectors, ids))
                continue
            if tree is None:
                if not held:
                    continue
                tree = Tree(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            floors = part.column("floor").to_pylist()
            out = [tree.search(v, int(i), k, f) for v, i, f in zip(vectors, ids, floors, strict=True)]
            found = [np.repeat(ids, [len(x) for x, _ in out]), np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])]
            kinds = [pa.int32()] * 3 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), *[pa.nulls(len(found[0]), t) for t in kinds if boxes]], names)
        if boxes and held:
            yield box()

    return both.mapInArrow(run, FOUND + (", " + BOX if boxes else ""))


def _reached(queries: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, dim, cell, sub): the shards, other than its own, whose box reaches a query's floor."""
    blocks, salts = max(1, -(-boxes.count() // BOXES)), max(1, -(-queries.count() // ASKING))
    series = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    held = boxes.select("*", F.pmod(F.xxhash64("cell", "sub"), F.lit(blocks)).cast("int").alias("block"), series(salts).alias("salt"))
    held = held.select("dim", "block", "salt", F.lit(0).alias("kind"), "cell", "sub", "lo", "hi", none("long").alias("id"), none("long").alias("floor"))
    asks = queries.select("*", series(blocks).alias("block"))
    asks = asks.select("dim", "block", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "cell", "sub", F.col("v").alias("lo"), F.col("v").alias("hi"), "id", "floor")
    place = ("dim", "block", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_, box = None, [], None
        for (*key, kind), part in _groups(batches, (*place, "kind")):
            if tuple(key) != at:
                at, held_, box = tuple(key), [], None
            own = [part.column(c).to_numpy() for c in ("cell", "sub")]
            if kind == 0:
                held_.append((*own, _vectors(part, "lo", key[0]), _vectors(part, "hi", key[0])))
                continue
            if box is None:
                box = [np.concatenate(x) for x in zip(*held_, strict=True)]
            cell, sub, lo, hi = box
            floors = np.array([-np.inf if f is None else float(np.nextafter(f, -np.inf)) for f in part.column("floor").to_pylist()])
            vectors, ids = _vectors(part, "lo", key[0]), part.column("id").to_numpy()
            for a in range(0, len(part), 256):
                s = slice(a, a + 256)
                good = upper_bounds(vectors[s], lo, hi) >= floors[s, None]
                good &= (cell[None] != own[0][s, None]) | (sub[None] != own[1][s, None])
                q, b = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s][q]), pa.array(np.full(len(q), key[0], np.int32)), pa.array(cell[b]), pa.array(sub[b])], ["id", *KEY])

    return held.unionByName(asks).repartition(*place).sortWithinPartitions(*place, "kind").mapInArrow(run, "id long, dim int, cell int, sub int")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def whole_numbers(vectors: DataFrame, is_query: Column, id_: str, vector: str, scale: int) -> DataFrame:
    """(id, v, is_query, dim) of the rows that take part."""
    marked = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    usable = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform("x", lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long"))
    return marked.where(F.coalesce(usable, F.lit(False))).select(F.col("id").cast("long").alias("id"), whole.alias("v"), "is_query").withColumn("dim", F.size("v"))


def sharded(wanted: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(the table that it is read from, wanted with its shard (cell, sub))."""
    rows = wanted.count()
    cells = min(MAX_CELLS, -(-rows // shard_rows))
    if cells <= 1:
        celled = wanted.withColumn("cell", F.lit(0))
    else:
        share = SAMPLED * cells / rows
        sample = wanted.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select("dim", "v").limit(2 * SAMPLED * cells).collect()
        held: dict[int, list] = {}
        for r in sample:
            held.setdefault(r["dim"], []).append(r["v"])
        splits = {dim: Splits(np.array(v, np.int64), -(-cells * len(v) // len(sample))) for dim, v in held.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, cell = batch.column("dim").to_numpy(), np.zeros(len(batch), np.int32)
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    if dim in splits:
                        cell[own] = splits[dim].cell_of(_vectors(batch.take(pa.array(own)), "v", dim))
                yield batch.append_column("cell", pa.array(cell))

        celled = wanted.mapInArrow(run, wanted.withColumn("cell", F.lit(0)).schema)
    celled = written(celled, "topk-cells")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes
    return celled, celled.join(sizes, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int")).drop("subs")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding", scale: int = 1024, shard_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is a query, its best k of all other rows."""
    wanted = written(whole_numbers(vectors, is_query, id_, vector, scale), "topk-rows")
    celled, rows = sharded(wanted, shard_rows)
    first = F.min(F.struct("dim", "v", "cell", "sub")).alias("q")
    queries = written(rows.where("is_query").groupBy("id").agg(first).select("id", "q.*").withColumn("floor", F.lit(None).cast("long")), "topk-queries")
    home = written(_wave(rows, queries, k, True), "topk-home")
    found = home.where("query_id is not null").select("query_id", "vec_id", "score")
    floor = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    asking = queries.drop("floor").join(floor, "id", "left")
    away = written(_reached(asking, home.where("query_id is null").select(*KEY, "lo", "hi")), "topk-pairs")
    again = away.join(asking.select("id", "v", "floor"), "id")
    out = written(_best(_wave(rows, again, k, False).unionByName(found), k), "topk-best")
    dropped(wanted, celled, queries, home, away)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
