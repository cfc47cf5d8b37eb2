"""Line dedup: sharded cuckoo filters over exact reference-count tables.

The index keeps three tables in the shared folder:

* postings (h1, h2, doc_id): every eligible line key of every document, once
  each; it makes deletions of documents exact;
* refs (h1, h2, refs, keeper): how many documents hold a key, and the largest
  doc_id among them;
* filters (shard, buckets): a cuckoo filter of the keys that `min_docs` or
  more documents hold. Keys that cross that mark upwards are inserted, keys
  that fall below it are deleted, so filters follow the exact counts.

A lookup asks the filter of the key's shard first; only keys that it may hold
are looked up in the exact table, so false positives change nothing. Filters
go to the rows by shard and salt, never by broadcast; a shard has a salt for each
`salt_rows` of its rows, so a hot key's rows are spread. Keys are 128-bit
BLAKE2 digests of the whole normalised line: equal digests mean equal bytes.

A change (insert, delete) counts the touched keys anew and updates the filters of
their shards; only a filter that has no room left is built again.

Defined cases: a null or empty text is one empty line; an empty table gives an
empty result; rows that repeat a doc_id are one document for the counts, and
each is returned; a row without doc_id keeps all its lines; other columns of
the input don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, SPACE, chunked, digests, flat, mix, pieces
from .state import dropped, fresh, written

NEWLINE = 10
CHUNK_BYTES = 256_000
SLOTS = 4
MAX_KICKS = 500
#: A shard's number of salts is 8 bytes, so up to here the table of them is under a megabyte and is broadcast.
BROADCAST_SHARDS = 65_536


def line_spans(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Every line of every row: row, start, end, where its key starts and ends, and the key's code points."""
    breaks = np.flatnonzero(data == NEWLINE)
    row_of_break = np.searchsorted(offs, breaks, "right") - 1
    rows = np.arange(len(offs) - 1)
    start = np.concatenate([offs[:-1], breaks + 1])
    row = np.concatenate([rows, row_of_break])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[last] = offs[1:]
    solid = np.flatnonzero(~SPACE[data])
    at = np.searchsorted(solid, start)
    upto = np.searchsorted(solid, end)
    empty = at == upto
    padded = np.r_[solid, 0]
    first, final = np.where(empty, start, padded[at]), np.where(empty, start, padded[upto - 1] + 1)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return {"row": row, "start": start, "end": end, "first": first, "final": final, "points": points[final] - points[first]}


def key_digests(data: np.ndarray, lines: dict[str, np.ndarray], which: np.ndarray) -> np.ndarray:
    """The 128-bit digests of some lines' keys, as two longs each."""
    low = LOWER[data].tobytes()
    return digests((low[a:b] for a, b in zip(lines["first"][which].tolist(), lines["final"][which].tolist(), strict=True)), 16).view(np.int64)


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id) for each line key of at least `min_chars` code points, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, _, data, offs in chunked(batch.column("text"), CHUNK_BYTES):
                lines = line_spans(data, offs)
                long = np.flatnonzero(lines["points"] >= min_chars)
                key = key_digests(data, lines, long)
                row, h1, h2 = lines["row"][long], key[:, 0], key[:, 1]
                order = np.lexsort((h2, h1, row))
                row, h1, h2 = row[order], h1[order], h2[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h1[new]), pa.array(h2[new]), pa.array(ids[a + row[new]].astype(np.int64))], ["h1", "h2", "doc_id"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


# ---------------------------------------------------------------- cuckoo filters


class Cuckoo:
    """A cuckoo filter over 128-bit keys: 16-bit fingerprints, four slots a bucket, with deletion."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets
        self.mask = len(buckets) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        n = 16
        while n * SLOTS * 0.85 < keys:
            n *= 2
        return cls(np.zeros((n, SLOTS), np.uint16))

    @classmethod
    def loads(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.buckets.tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = ((h2.view(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (h1.view(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return print_, one, self.other(one, print_)

    def other(self, place: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return place ^ (mix(np.asarray(print_, np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(h1, h2)
        return ((self.buckets[one] == print_[:, None]) | (self.buckets[two] == print_[:, None])).any(axis=1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if it has no room; then the shard is to be rebuilt with more buckets."""
        for print_, one, two in zip(*self.places(h1, h2), strict=True):
            for place in (one, two):
                free = np.flatnonzero(self.buckets[place] == 0)
                if len(free):
                    self.buckets[place, free[0]] = print_
                    break
            else:
                place, held = one, print_
                for kick in range(MAX_KICKS):
                    slot = (int(held) + kick) % SLOTS
                    self.buckets[place, slot], held = held, self.buckets[place, slot]
                    place = int(self.other(np.array([place]), np.array([held]))[0])
                    free = np.flatnonzero(self.buckets[place] == 0)
                    if len(free):
                        self.buckets[place, free[0]] = held
                        break
                else:
                    return False
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for print_, one, two in zip(*self.places(h1, h2), strict=True):
            for place in (one, two):
                there = np.flatnonzero(self.buckets[place] == print_)
                if len(there):
                    self.buckets[place, there[0]] = 0
                    break


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int")


def built(h1: np.ndarray, h2: np.ndarray, room: int = 1) -> Cuckoo:
    while True:
        cuckoo = Cuckoo.sized(len(h1) * room)
        if cuckoo.insert(h1, h2):
            return cuckoo
        room *= 2


def by_shard(rows: DataFrame, run, schema: str, *order: str) -> DataFrame:
    """run(shard, table) -> arrays, for the rows of each shard, streamed from sorted partitions; columns of the result as in `schema`."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(run(at, pa.Table.from_batches(held).combine_chunks()), names)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shard[a] != at and held:
                    yield done()
                    held = []
                at = int(shard[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return rows.repartition("shard").sortWithinPartitions("shard", *order).mapInArrow(each, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


FILTER = "shard int, buckets binary"


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, buckets) for the keys (h1, h2); a shard holds about `shard_keys` of them."""

    def one(shard: int, rows: pa.Table) -> list[pa.Array]:
        return [pa.array([shard], pa.int32()), pa.array([built(_column(rows, "h1"), _column(rows, "h2")).dumps()])]

    return by_shard(keys.select(_shard(shards).alias("shard"), "h1", "h2"), one, FILTER)


def update_filters(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """Filters after `changes` (h1, h2, held_before, held_now): deletions, then insertions. A filter without room for them comes out as null."""
    came = changes.where("held_before <> held_now").select(_shard(shards).alias("shard"), "h1", "h2", "held_now", F.lit(None).cast("binary").alias("buckets"))
    old = filters.select("shard", *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2")], F.lit(None).cast("boolean").alias("held_now"), "buckets")

    def one(shard: int, rows: pa.Table) -> list[pa.Array]:
        raw = rows.column("buckets").drop_null()
        changed = rows.filter(rows.column("held_now").is_valid())
        now = _column(changed, "held_now").astype(bool) if len(changed) else np.zeros(0, bool)
        h1, h2 = _column(changed, "h1").astype(np.int64), _column(changed, "h2").astype(np.int64)
        if not len(raw):
            return [pa.array([shard], pa.int32()), pa.array([built(h1[now], h2[now]).dumps()])]
        cuckoo = Cuckoo.loads(raw[0].as_py())
        cuckoo.delete(h1[~now], h2[~now])
        return [pa.array([shard], pa.int32()), pa.array([cuckoo.dumps() if cuckoo.insert(h1[now], h2[now]) else None], pa.binary())]

    return by_shard(old.unionByName(came), one, FILTER)


def maybe_held(rows: DataFrame, filters: DataFrame, shards: int, salt_rows: int) -> DataFrame:
    """The rows (h1, h2, doc_id) whose key its shard's filter may hold."""
    sized = rows.groupBy(_shard(shards).alias("shard")).agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    sized = F.broadcast(sized) if shards <= BROADCAST_SHARDS else sized
    probes = rows.withColumn("shard", _shard(shards)).join(sized, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "h1", "h2", "doc_id", F.lit(None).cast("binary").alias("buckets"))
    copies = filters.join(sized, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "doc_id")], "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cuckoo = None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt")], axis=1)
            if not len(place):
                continue
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1), len(place)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part, here = batch.slice(a, b - a), tuple(place[a])
                if here != at:
                    at, cuckoo = here, None
                raw = part.column("buckets")
                if raw[0].is_valid:
                    cuckoo, part = Cuckoo.loads(raw[0].as_py()), part.slice(1)
                if cuckoo is None or not len(part):
                    continue
                keep = pa.array(cuckoo.holds(part.column("h1").to_numpy(), part.column("h2").to_numpy()))
                yield part.select(["h1", "h2", "doc_id"]).filter(keep)

    both = probes.unionByName(copies).repartition("shard", "salt")
    return both.sortWithinPartitions("shard", "salt", F.col("buckets").isNull()).mapInArrow(run, "h1 long, h2 long, doc_id long")


# ---------------------------------------------------------------- the index


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("refs"), F.max("doc_id").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """An incremental index; every change gives a new one and leaves the old one as it was. close() deletes the tables of one."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 40
    min_docs: int = 5
    shard_keys: int = 32_768
    salt_rows: int = 50_000

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 32_768, salt_rows: int = 50_000) -> LineIndex:
        rows = written(postings(docs, min_chars), "line-postings")
        return cls._of(rows, written(_counts(rows), "line-refs"), min_chars, min_docs, shard_keys, salt_rows)

    @classmethod
    def _of(cls, rows: DataFrame, refs: DataFrame, min_chars: int, min_docs: int, shard_keys: int, salt_rows: int) -> LineIndex:
        held = refs.where(F.col("refs") >= min_docs)
        shards = max(1, -(-held.count() // shard_keys))
        return cls(rows, refs, written(build_filters(held, shards), "line-filters"), shards, min_chars, min_docs, shard_keys, salt_rows)

    def _changed(self, rows: DataFrame, keys: DataFrame) -> LineIndex:
        """After `keys` got other counts in `rows`: their counts are taken anew, all others stay."""
        keys = written(keys, "line-keys")
        now = written(_counts(rows.join(keys, ["h1", "h2"], "left_semi")), "line-counts")
        refs = written(self.refs.join(keys, ["h1", "h2"], "left_anti").unionByName(now), "line-refs")
        held = lambda table, name: table.where(F.col("refs") >= self.min_docs).select("h1", "h2", F.lit(True).alias(name))
        both = keys.join(held(self.refs, "held_before"), ["h1", "h2"], "left").join(held(now, "held_now"), ["h1", "h2"], "left").na.fill(False)
        filters = written(update_filters(self.filters, both, self.shards), "line-filters")
        dropped(keys, now)
        if not filters.where("buckets is null").isEmpty():
            dropped(filters)
            return self._of(rows, refs, self.min_chars, self.min_docs, self.shard_keys, self.salt_rows)
        return replace(self, postings=rows, refs=refs, filters=filters)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = written(postings(docs, self.min_chars), "line-postings")
        return self._changed(self.postings.unionByName(new), new.select("h1", "h2").distinct())

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of `doc_ids`: as if they had never been inserted."""
        ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        gone = self.postings.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct()
        return self._changed(written(self.postings.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id"), "line-postings"), gone)

    def dropped(self, rows: DataFrame) -> DataFrame:
        """Of the postings `rows`, those whose lines go: their key is held by enough documents and a larger doc_id keeps it."""
        exact = self.refs.where(F.col("refs") >= self.min_docs)
        return maybe_held(rows, self.filters, self.shards, self.salt_rows).join(exact, ["h1", "h2"]).where("doc_id < keeper").select("doc_id", "h1", "h2")

    def drops(self, rows: DataFrame | None = None) -> DataFrame:
        """(doc_id, drops): the keys that each document loses, as one binary of 16 bytes a key."""
        return gathered(self.dropped(self.postings if rows is None else rows))

    def apply(self, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """The columns of `docs`, `text` without its dropped lines, and two more, last: lines before, lines dropped."""
        return without_lines(docs, self.drops(rows), self.min_chars)

    def close(self) -> None:
        dropped(*[x for x in (self.postings, self.refs, self.filters) if hasattr(x, "written_to")])


def gathered(rows: DataFrame) -> DataFrame:
    """(doc_id, drops) of (doc_id, h1, h2): a document's keys in order, 16 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.large_binary()).cast(pa.binary())], ["doc_id", "drops"])
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            raw = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], axis=1).tobytes()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            whole_ids, whole = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if ids[a] != at:
                    if held:
                        whole_ids.append(at)
                        whole.append(b"".join(held))
                    at, held = int(ids[a]), []
                held.append(raw[16 * a : 16 * b])
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(whole_ids, pa.int64()), pa.array(whole, pa.binary())], ["doc_id", "drops"])
        if held:
            yield done()

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "h1", "h2").mapInArrow(run, "doc_id long, drops binary")


def without_lines(docs: DataFrame, drops: DataFrame, min_chars: int) -> DataFrame:
    """The columns of `docs`, `text` without the lines whose keys `drops` names, and two more, last: lines before, lines dropped."""
    doc, found, n_lines, n_dropped = fresh(docs, "_doc", "_drops", "_lines", "_dropped")
    drops = drops.toDF(doc, found)
    joined = docs.join(drops.hint("merge"), docs["doc_id"] == drops[doc], "left").drop(doc)  # as on large tables, whatever the size
    schema = docs.withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long")}).schema
    at, names = docs.columns.index("text"), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts, lines, gone = kept_texts(batch.column(at), batch.column(found), min_chars)
            columns = [batch.column(i) for i in range(len(names) - 2)]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines), pa.array(gone)], names)

    return joined.mapInArrow(run, schema)


def kept_texts(text: pa.Array, drops: pa.Array, min_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without dropped lines, lines before, lines dropped); texts that lose nothing stay as they are."""
    gone = np.zeros(len(text), np.int64)
    data, offs = flat(text)
    lines = np.diff(np.searchsorted(np.flatnonzero(data == NEWLINE), offs)) + 1
    new: dict[int, str] = {}
    for i in np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)).tolist():
        part = data[offs[i] : offs[i + 1]]
        own = line_spans(part, np.array([0, len(part)]))
        long = np.flatnonzero(own["points"] >= min_chars)
        bad = set(np.frombuffer(drops[i].as_py(), "V16").tolist())
        keep = np.ones(len(own["row"]), bool)
        keep[long] = [x not in bad for x in np.ascontiguousarray(key_digests(part, own, long)).view("V16").ravel().tolist()]
        gone[i] = (~keep).sum()
        raw = part.tobytes()
        new[i] = b"\n".join(raw[s:e] for s, e in zip(own["start"][keep].tolist(), own["end"][keep].tolist(), strict=True)).decode()
    if not new:
        return text, lines, gone
    parts, last = [], 0
    for i, value in sorted(new.items()):
        parts += [text.slice(last, i - last), pa.array([value], text.type)]
        last = i + 1
    return pa.concat_arrays([*parts, text.slice(last)]), lines, gone


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with frequent lines kept in the largest doc_id only; see the module for defined cases.

    The index's tables are deleted once the keys that go are known.
    """
    index = LineIndex.build(docs, min_chars, min_docs)
    drops = written(index.drops(), "line-drops")
    index.close()
    return without_lines(docs, drops, min_chars)


def digest(rows: DataFrame) -> DataFrame:
    """What op6 returns for the rows of line_dedup()."""
    n_lines, n_dropped = rows.columns[-2:]
    return rows.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))

