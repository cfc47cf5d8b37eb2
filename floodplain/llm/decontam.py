"""Benchmark decontamination by the q-gram lemma: counts in overlapping diagonal bands, then banded alignment.

Texts are compared as code points with runs of white space as one space and
letters in lower case (where that is one letter for one). An item of m characters
occurs in a document if some stretch of it has an edit distance of at most
e = floor(errors * m) to the item; e is lowered where the lemma would say
nothing. Such a stretch shares at least m + 1 - q * (e + 1) q-grams with the
item, all on diagonals (place in the text less place in the item) that lie
within e of each other. Diagonals are cut into bands of 2e + 1 that overlap by
e, so one band holds them all: only bands that reach the bound are aligned, by
dynamic programming over the band's diagonals and e more on each side.

Items go to the executors in blocks of about `block_chars` characters, one
scan of the documents and one broadcast at a time; that bounds what is held at once.

Defined cases: null and empty texts and items match nothing; items with fewer
than `min_chars` characters after normalising are too short to tell and are
left out; an item in two rows matches twice; repeated rows of documents give
repeated rows; a null doc_id or item_id stays null; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ODD, U, mix, pieces
from .state import dropped, written

Q = 8
ERRORS = 0.1
MIN_CHARS = 24
GAP = 0xFFFFFFFF
BITS = 22
CHUNK_CHARS = 1_000_000
#: Cells of arrays in one alignment, beyond the one item that is always aligned.
CELLS = 4_000_000

_lower = np.arange(0x2000, dtype=np.uint32)
for _i in range(0x2000):
    if len(chr(_i).lower()) == 1:
        _lower[_i] = ord(chr(_i).lower())
#: White space of Unicode below 0x3001.
_spaces = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
_is_space = np.zeros(0x3001, bool)
_is_space[_spaces] = True


def code_points(text: str) -> np.ndarray:
    """The normalised text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = raw < 0x2000
    out = np.where(small, _lower[np.where(small, raw, 0)], raw)
    space = (raw <= 0x3000) & _is_space[np.minimum(raw, 0x3000)]
    out[space] = 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    out = out[keep]
    if len(out) and out[0] == 32:
        out = out[1:]
    return out[:-1] if len(out) and out[-1] == 32 else out


def gram_hashes(points: np.ndarray) -> np.ndarray:
    n = max(0, len(points) - Q + 1)
    h, wide = np.zeros(n, U), points.astype(U)
    for k in range(Q):
        h += wide[k : k + n] * ODD[k]
    return mix(h)


class Items:
    """The q-grams of a block of items, by hash."""

    def __init__(self, ids: list, texts: list[str | None], errors: float, min_chars: int):
        points = [code_points(t or "") for t in texts]
        keep = [i for i, p in enumerate(points) if len(p) >= max(min_chars, Q)]
        self.ids, self.points = [ids[i] for i in keep], [points[i] for i in keep]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.minimum(np.floor(errors * self.size + 1e-9), (self.size - Q) // Q).astype(np.int64)
        self.bound = self.size + 1 - Q * (self.budget + 1)
        grams = [gram_hashes(p) for p in self.points]
        hashes = np.concatenate(grams) if grams else np.zeros(0, U)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.first = first
        self.may = np.zeros(1 << BITS, bool)
        self.may[(self.hash >> U(64 - BITS)).astype(np.int64)] = True

    def bands(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, smallest diagonal) of each band that reaches its item's bound in a run of texts."""
        h = gram_hashes(text)
        at = np.flatnonzero(self.may[(h >> U(64 - BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.hash, h[at]), max(0, len(self.hash) - 1))
        good = self.hash[slot] == h[at]
        at, slot = at[good], slot[good]
        many = self.count[slot]
        pair = np.repeat(self.first[slot], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        item = self.item[pair]
        diagonal = np.repeat(at, many) - self.place[pair] + int(self.size.max(initial=0))
        step = self.budget[item] + 1
        band = diagonal // step
        two = (diagonal % step < step - 1) & (band > 0)
        key = np.concatenate([item * (1 << 32) + band, (item * (1 << 32) + band - 1)[two]])
        key, count = np.unique(key, return_counts=True)
        key = key[count >= self.bound[key >> 32]]
        item, band = key >> 32, key & ((1 << 32) - 1)
        return item, band * (self.budget[item] + 1) - int(self.size.max(initial=0))


def align(text: np.ndarray, items: Items, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The least edit distance between each item and a stretch of the text around its band; those over the budget may come out larger than they are."""
    out = np.zeros(len(item), np.int64)
    order = np.argsort(items.size[item], kind="stable")
    a = 0
    while a < len(order):
        # As many as fit in CELLS cells, by the longest of 256: rows are in the order of length.
        longest = order[min(a + 255, len(order) - 1)]
        cells = int(items.size[item[longest]] + 8 * (4 * items.budget[item[order[a : a + 256]]].max() + 1))
        some = order[a : a + max(1, min(256, CELLS // cells))]
        a += len(some)
        own, e, m = item[some], items.budget[item[some]], items.size[item[some]]
        width, height = int((4 * e + 1).max()), int(m.max())
        low = diagonal[some] - e
        pattern = np.full((len(some), height), GAP - 1, np.uint32)
        for r, x in enumerate(own):
            pattern[r, : m[r]] = items.points[x]
        columns = np.arange(width)
        cost = np.zeros((len(some), width), np.int32)
        best = np.zeros(len(some), np.int64)
        for i in range(height):
            place = low[:, None] + columns + i
            inside = (place >= 0) & (place < len(text))
            letters = np.where(inside, text[np.where(inside, place, 0)], GAP)
            step = cost + (letters != pattern[:, i, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - columns, axis=1) + columns
            ends = m == i + 1
            best[ends] = cost[ends].min(axis=1)
        out[some] = best
    return out


def find(texts: list[str | None], items: Items) -> list[tuple[int, int, int]]:
    """(row, item, errors) for every item that occurs in a text, by its best occurrence."""
    found: list[tuple[int, int, int]] = []
    points, first, rows, size = [], [], [], 0
    gap = np.full(int(items.budget.max(initial=0)) + 1, GAP, np.uint32)  # dearer than any budget, so nothing matches across

    def search() -> None:
        if not points or not items.points:
            return
        text = np.concatenate([x for p in points for x in (p, gap)])
        item, diagonal = items.bands(text)
        if not len(item):
            return
        starts = np.array(first)
        errors = align(text, items, item, diagonal)
        ok = errors <= items.budget[item]
        middle = np.clip(diagonal[ok] + items.budget[item[ok]] + items.size[item[ok]] // 2, 0, len(text) - 1)
        row = np.array(rows)[np.searchsorted(starts, middle, "right") - 1]
        best: dict[tuple[int, int], int] = {}
        for r, i, x in zip(row.tolist(), item[ok].tolist(), errors[ok].tolist(), strict=True):
            best[r, i] = min(x, best.get((r, i), x))
        found.extend((r, i, x) for (r, i), x in sorted(best.items()))

    for row, text in enumerate(texts):
        own = code_points(text) if text else np.zeros(0, np.uint32)
        if len(own) < Q:
            continue
        if size + len(own) > CHUNK_CHARS and points:
            search()
            points, first, rows, size = [], [], [], 0
        points.append(own)
        first.append(size)
        rows.append(row)
        size += len(own) + len(gap)
    search()
    return found


def item_blocks(benchmark: DataFrame, errors: float, min_chars: int, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """(items, whether these are all) in blocks of about `block_chars` characters: each is collected, sent, and taken back before the next one, so one block is held at a time."""
    rows = benchmark.where("text is not null").select(F.col("item_id"), F.col("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(chars) // block_chars)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if part:
            shared = benchmark.sparkSession.sparkContext.broadcast(Items([None if r["item_id"] is None else int(r["item_id"]) for r in part], [r["text"] for r in part], errors, min_chars))
            yield shared, blocks == 1
            if blocks > 1:
                shared.destroy()


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, min_chars: int = MIN_CHARS, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, errors): each document with each benchmark item that occurs in it."""
    out = None
    for shared, only in item_blocks(benchmark, errors, min_chars, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in pieces(batches, "text"):
                hits = find(batch.column("text").to_pylist(), own)
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _, _ in hits], pa.int64())), pa.array([own.ids[i] for _, i, _ in hits], pa.int64()), pa.array([x for _, _, x in hits], pa.int32())], ["doc_id", "item_id", "errors"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, errors int")
        found = found if only else written(found, "leaks-found")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, errors int")


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, min_chars: int = MIN_CHARS, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs in which no benchmark item occurs, in the same columns."""
    kept = docs
    for shared, only in item_blocks(benchmark, errors, min_chars, block_chars):
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, at):
                good = np.ones(len(batch), bool)
                good[[r for r, _, _ in find(batch.column(at).to_pylist(), shared.value)]] = False
                yield batch.filter(pa.array(good))

        before, kept = kept, kept.mapInArrow(run, kept.schema)
        if not only:
            kept = written(kept, "leaks-kept")
            if before is not docs:
                dropped(before)
    return kept
