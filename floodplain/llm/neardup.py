"""Near-duplicate documents by SetSketch registers over word shingles.

1. Every whole text becomes M registers of its set of distinct five-word shingles
   (64-bit mixes of word digests), and a 128-bit BLAKE2 digest of its words.
2. Documents with equal words are one class; its smallest doc_id stands for it.
3. Bands of register values put similar representatives in a bucket with a
   chance that makes a miss at the threshold less than one in a million. Each bucket
   compares its members with its smallest one. Where that leaves several
   components in a bucket, each member outside the largest component is compared
   with all the others, in blocks: by registers first, and only members that have a likely
   partner come again with their texts. So a bucket of thousands of near copies
   costs one comparison each, and nothing is capped.
4. A pair is estimated by joint likelihood of the registers (those far below the
   threshold go; the margin is five standard deviations) and then verified on
   the full sets of shingles as words, not as hashes. Only verified links count.
5. Components of the links; every document gets the smallest doc_id reachable.

Defined cases: a text with fewer words than a shingle is one shingle; a null,
empty or blank text has an empty set, and is linked with nothing; rows
without doc_id are linked with nothing and have no component; rows that repeat
a doc_id are one node, which any of their texts can link; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .blocks import LOWER, chunks, digests, flat, real_sets, shingle_sets, signed
from .components import connected
from .state import dropped, written

WIDTH = 5
SALTS = 64
#: Rows and bytes of text in a block of a bucket.
BLOCK = 2048
BLOCK_BYTES = 2_000_000
CHUNK_BYTES = 500_000


def band_rows(percent: int) -> int:
    """The most registers a band may hold so that a pair at the threshold is missed with a chance below 1e-6 (at least one)."""
    for rows in range(8, 0, -1):
        if (1 - (percent / 100) ** rows) ** (setsketch.M // rows) < 1e-6:
            return rows
    return 1


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, bytes, d1, d2, regs) of every row; d1 and d2 are the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            data, offs = flat(batch.column("text"))
            raw = LOWER[data].tobytes()
            for a, sets in shingle_sets(batch.column("text"), width):
                regs = setsketch.registers(sets)
                at = offs[a : a + len(sets) + 1].tolist()
                own = digests((b" ".join(raw[i:j].split()) for i, j in zip(at, at[1:], strict=False)), 16)
                held = [r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.diff(at)), *[pa.array(signed(own[:, k].copy())) for k in (0, 1)], pa.array(held, pa.binary())],
                    ["doc_id", "n", "bytes", "d1", "d2", "regs"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n long, bytes long, d1 long, d2 long, regs binary")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, setsketch.M)


def bands(reps: DataFrame, rows: int) -> DataFrame:
    """(band, doc_id, n) for every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = setsketch.band_hashes(_regs(batch.column("regs")), rows)
            k = found.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(signed(found.reshape(-1))), *[pa.array(np.repeat(batch.column(c).to_numpy(), k)) for c in ("doc_id", "n")]], ["band", "doc_id", "n"])

    return reps.mapInArrow(run, "band long, doc_id long, n long")


def _sizes_allow(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def floor_of(percent: int) -> float:
    """Estimates below this are further than five standard deviations under the threshold."""
    t = percent / 100
    return max(0.0, t - 5 * (t * (1 - t) / setsketch.M) ** 0.5)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers make the threshold likely enough."""
    side = reps.select("doc_id", "n", "regs")
    both = pairs.join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = setsketch.likely_jaccard(_regs(batch.column("ra")), _regs(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(found >= floor_of(percent)))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def jaccard_holds(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    b's text goes once to each salt of its pairs, then a's texts stream by.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    members = salted.join(texts.select(F.col("id").alias("a"), "text"), "a").select("b", "salt", "a", "text")
    centres = salted.select("b", "salt").distinct().join(texts.select(F.col("id").alias("b"), "text"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known = None, [], None
        for batch in batches:
            b, a, salt = batch.column("b").to_numpy(), batch.column("a").to_pylist(), batch.column("salt").to_numpy()
            text = batch.column("text")
            links: list[tuple[int, int]] = []
            for first, last in chunks(flat(text)[1], CHUNK_BYTES):
                own, words = real_sets(text.slice(first, last - first), width, known)
                for i in range(first, last):
                    if (b[i], salt[i]) != at:
                        at, held = (b[i], salt[i]), []
                    if a[i] is None:
                        held.append(own(i - first))
                        known = words
                    elif any(jaccard_holds(own(i - first), x, percent) for x in held):
                        links.append((a[i], int(b[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    together = members.unionByName(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").isNotNull())
    return together.mapInArrow(run, "a long, b long")


PLACE = ("band", "block", "kind")


def in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (band, doc_id, component, ...) of buckets dealt into `blocks` (band, blocks, main): kind 0 once, and kind 1, those outside the main component, for every block."""
    rest = [c for c in rows.columns if c != "band"]
    placed = rows.join(blocks, "band")
    base = placed.select("band", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), *rest)
    asks = placed.where("component <> main").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), *rest)
    return base.unionByName(asks).repartition("band", "block").sortWithinPartitions(*PLACE)


def by_block(batches: Iterator[pa.RecordBatch], new: Callable[[int], _Likely]) -> Iterator[tuple[_Likely, pa.RecordBatch | None]]:
    """(block, rows that ask it) over the rows of in_blocks(); and (block, None) when a block is through."""
    at, block = None, None
    for batch in batches:
        place = np.stack([batch.column(c).to_numpy() for c in PLACE], axis=1)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if tuple(place[x, :2]) != at:
                if block is not None:
                    yield block, None
                at, block = tuple(place[x, :2]), new(int(place[x, 0]))
            if place[x, 2] == 0:
                block.held.append(batch.slice(x, y - x))
            elif block.held:
                yield block, batch.slice(x, y - x)
    if block is not None:
        yield block, None


class _Likely:
    """Some members of a bucket, held against others by their registers."""

    def __init__(self, band: int, percent: int):
        self.band, self.percent, self.per_band = band, percent, band_rows(percent)
        self.held: list[pa.RecordBatch] = []
        self.table: list[np.ndarray] | None = None

    def open(self) -> None:
        if self.table is None:
            self.rows = pa.Table.from_batches(self.held).combine_chunks()
            regs = _regs(self.rows.column("regs").combine_chunks())
            self.table = [self.rows.column(c).to_numpy() for c in ("doc_id", "component", "n")] + [regs, signed(setsketch.band_hashes(regs, self.per_band))]
            self.held = self.held[:1]
            self.likely = np.zeros(len(regs), bool)

    def partners(self, part: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row of part, its doc_id, its component, likely partners in other components, the likeliest first); a pair is looked at in its first common band only."""
        self.open()
        _, components, sizes, regs, bands_ = self.table
        mine = _regs(part.column("regs"))
        mine_bands = signed(setsketch.band_hashes(mine, self.per_band))
        for k, (doc, component, size) in enumerate(zip(*[part.column(c).to_pylist() for c in ("doc_id", "component", "n")], strict=True)):
            near = np.flatnonzero((components != component) & (np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * self.percent))
            if len(near):
                same = bands_[near] == mine_bands[k]
                near = near[mine_bands[k][same.argmax(axis=1)] == self.band]
            if len(near):
                found = setsketch.likely_jaccard(regs[near], np.broadcast_to(mine[k], (len(near), len(mine[k]))), sizes[near], np.full(len(near), size))
                good = found >= floor_of(self.percent)
                near = near[good][np.argsort(-found[good], kind="stable")]
            if len(near):
                yield k, doc, component, near


class _Linked(_Likely):
    """The same with texts: links that join components, a spanning forest of the block."""

    def __init__(self, band: int, percent: int, width: int):
        super().__init__(band, percent)
        self.width, self.joined, self.sets = width, {}, {}

    def root(self, component: int) -> int:
        while (up := self.joined.get(component, component)) != component:
            component = up
        return component

    def links(self, part: pa.RecordBatch) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        theirs = None
        for k, doc, component, near in self.partners(part):
            own = None
            for i in near.tolist():
                here, there = self.root(component), self.root(int(self.table[1][i]))
                if here == there:
                    continue
                if theirs is None:
                    if not self.sets:
                        self.own, self.known = real_sets(self.rows.column("text").combine_chunks(), self.width)
                    theirs, _ = real_sets(part.column("text"), self.width, self.known)
                if own is None:
                    own = theirs(k)
                if i not in self.sets:
                    self.sets[i] = self.own(i)
                if jaccard_holds(own, self.sets[i], self.percent):
                    self.joined[max(here, there)] = min(here, there)
                    out.append((doc, int(self.table[0][i])))
        return out


def left_over(members: DataFrame, parts: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components, but those with the bucket's centre.

    In each bucket every member outside its largest component meets all members, in blocks. Registers alone
    say first which members have a likely partner; only those come again with their texts, in blocks
    of at most about BLOCK rows and BLOCK_BYTES of text, and are verified there and then. What an earlier link
    of the block has joined already isn't looked at again, so rows out are links of a spanning forest, never all pairs.
    """
    rest = members.where("doc_id <> centre").select("band", "doc_id").join(parts.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rest = written(rest, "near-rest")
    sizes = rest.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("main"))
    open_ = written(sizes.where("parts > 1").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.col("main.component").alias("main")), "near-open")
    rows = written(rest.join(open_.select("band"), "band").join(reps.select("doc_id", "n", "bytes", "regs"), "doc_id").select("band", "doc_id", "component", "n", "bytes", "regs"), "near-rows")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking: list[int] = []
        for block, part in by_block(batches, lambda band: _Likely(band, percent)):
            if part is not None:
                for _, doc, _, near in block.partners(part):
                    block.likely[near] = True
                    asking.append(doc)
            elif block.table is not None:
                found = np.r_[np.array(asking, np.int64), block.table[0][block.likely]]
                asking = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block.band)), pa.array(found)], ["band", "doc_id"])

    some = written(in_blocks(rows.drop("bytes"), open_).mapInArrow(likely, "band long, doc_id long").distinct(), "near-likely")
    again = rows.join(some, ["band", "doc_id"])
    blocks = again.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")).join(open_.select("band", "main"), "band")
    whole = again.drop("bytes").join(texts.withColumnRenamed("id", "doc_id"), "doc_id").select("band", "doc_id", "component", "n", "regs", "text")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in by_block(batches, lambda band: _Linked(band, percent, width)):
            if part is not None and (links := block.links(part)):
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in links], pa.int64()), pa.array([j for _, j in links], pa.int64())], ["a", "b"])

    out = written(in_blocks(whole, blocks).mapInArrow(linked, "a long, b long"), "near-more")
    dropped(rest, open_, rows, some)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text); see the module."""
    rows = band_rows(percent)
    own = written(sketches(docs, width), "near-sketches")
    solid = own.where("n > 0 and doc_id is not null")
    classes = written(solid.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "near-classes")
    named = written(own.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "near-named")
    reps = solid.join(classes, ["d1", "d2"], "left").where("rep is null or rep = doc_id").select("doc_id", "n", "bytes", "regs")
    reps = written(reps, "near-reps")
    dropped(own)
    buckets = written(
        bands(reps, rows).groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n")).alias("first")).where("size > 1").select("band", F.col("first.doc_id").alias("centre"), F.col("first.n").alias("centre_n")),
        "near-buckets",
    )
    members = written(bands(reps, rows).join(buckets, "band"), "near-members")
    dropped(classes, buckets)
    stars = members.where(F.col("doc_id") != F.col("centre")).where(_sizes_allow("n", "centre_n", percent)).select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()
    ids = members.select(F.col("doc_id").alias("id")).distinct().hint("merge")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi"), "near-texts")
    pairs = written(plausible(stars, reps, percent), "near-stars")
    links = written(verified(pairs, texts, percent, width), "near-links")
    parts = written(connected(links), "near-parts")
    more = left_over(members, parts, reps, texts, percent, width)
    dropped(pairs, members, reps, texts)
    if not more.isEmpty():
        before, parts = parts, written(connected(links.unionByName(more)), "near-parts")
        dropped(before)
    dropped(links, more)
    out = named.join(parts.toDF("rep", "component_id"), "rep", "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
