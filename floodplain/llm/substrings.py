"""Suffix-array dedup: bytes covered by a WIDTH-byte string that also starts elsewhere are removed.

The repeated intervals come from merged Burrows-Wheeler transforms (module
bwt). No transform of the whole corpus is made: a screen that loses nothing
first says which stretches can hold a repeat, and brings those that can match
each other to one place.

* Screen. Every window of WIDTH bytes is known by its anchor, the smallest hash of its
  GRAM-byte grams; equal windows have equal anchors. Consecutive windows with
  one anchor are a stretch, and each window is in just one stretch. A stretch whose anchor occurs
  nowhere else, nor twice in itself, holds no repeat. Hashes that collide only let more through.
* Stretches of one anchor that are equal as a whole (128-bit BLAKE2 digest of their bytes)
  count as one string with their number as its weight.
* All these strings go with their anchor to one place, and the transforms there
  tell which of their windows stand for two positions or more. What they decide holds for every stretch
  that the string stands for. An anchor with more than PLACE_BYTES of different
  strings is dealt out further, window by window, under a hash of the whole window, and
  a place of very many equal windows is worked off in pieces, so no task grows with the copies of one passage.

Rows are known by the MD5 of (doc_id, text), so rows that repeat a doc_id
are texts of their own, and equal rows repeat each other.

Defined cases: a null text is empty; texts shorter than WIDTH lose nothing; a
null doc_id is a value like others; extra columns don't matter; an empty table
gives an empty result. Remaining bytes are joined as bytes, whether or not they are whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BYTE_VALUE, chunked, digests, flat, pieces, prefix_hash, signed, span_hash
from .bwt import repeated
from .state import dropped, written

WIDTH = 200
GRAM = 50
LONGEST = 256  # windows in a stretch
#: Bytes that are solved at once, so that ranks have 16 bits; a longer place is solved on its own.
BATCH_BYTES = 64_000
PLACE_BYTES = 1_000_000
CHUNK_BYTES = 250_000

ROW = ("k1", "k2")
STRING = ("anchor", "d1", "d2")


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = -(-len(a) // w) * w
    b = np.full(n, np.iinfo(a.dtype).max, a.dtype)
    b[: len(a)] = a
    b = b.reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).reshape(-1)
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    k = len(a) - w + 1
    return np.minimum(right[:k], left[w - 1 : w - 1 + k])


def stretches(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, whether the anchor stands in it twice) of every stretch of the rows."""
    windows = np.maximum(0, offs[1:] - offs[:-1] - WIDTH + 1)
    if not windows.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    prefix = prefix_hash(BYTE_VALUE[data])
    at, span = np.arange(len(data) - GRAM + 1), WIDTH - GRAM + 1
    grams = span_hash(prefix, at, at + GRAM)
    least = sliding_min(grams, span)
    reach = ~sliding_min(~np.r_[np.zeros(span - 1, least.dtype), least, np.zeros(span - 1, least.dtype)], span)
    chosen = np.flatnonzero(grams == reach)  # grams that are the smallest of some window
    start = np.arange(windows.sum()) + np.repeat(offs[:-1] - np.r_[0, np.cumsum(windows)[:-1]], windows)
    row = np.repeat(np.arange(len(windows)), windows)
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    run = np.flatnonzero(new)
    length = np.diff(np.r_[run, len(start)])
    parts = -(-length // LONGEST)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(run, parts) + within * LONGEST
    count = np.minimum(np.repeat(length, parts) - within * LONGEST, LONGEST)
    begin = start[first]
    low, high = np.searchsorted(chosen, begin), np.searchsorted(chosen, begin + count - 1 + span)
    held = high - low
    at = np.repeat(low, held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    equal = grams[chosen[at]] == np.repeat(anchor[first], held)
    twice = np.bincount(np.repeat(np.arange(len(held)), held), weights=equal, minlength=len(held)) > 1
    return row[first], begin - offs[row[first]], count, anchor[first], twice


def occurrences(rows: DataFrame) -> DataFrame:
    """(STRING, ROW, first, windows, twice) of rows (ROW, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ROW]
            for a, _, data, offs in chunked(batch.column("text"), CHUNK_BYTES):
                row, first, count, anchor, twice = stretches(data, offs)
                raw, begin = data.tobytes(), first + offs[row]
                own = digests((raw[i:j] for i, j in zip(begin.tolist(), (begin + count - 1 + WIDTH).tolist(), strict=True)), 16).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), *[pa.array(own[:, k].copy()) for k in (0, 1)], *[pa.array(k[a + row]) for k in keys], pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(twice)],
                    [*STRING, *ROW, "first", "windows", "twice"],
                )

    return rows.mapInArrow(run, "anchor long, d1 long, d2 long, k1 long, k2 long, first int, windows int, twice boolean")


PIECE = "place long, split boolean, anchor long, d1 long, d2 long, at int, weight long, bytes binary"


def cut_out(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """PIECE: the bytes of the strings of wanted (ROW, strings of STRING, first, windows, weight, split), with the place where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", CHUNK_BYTES):
            data, offs = flat(batch.column("text"))
            raw, out = data.tobytes(), []
            for start, strings in zip(offs.tolist(), batch.column("strings").to_pylist(), strict=False):
                for p in strings:
                    a, n, key = start + p["first"], p["windows"], (p["anchor"], p["d1"], p["d2"])
                    if not p["split"]:
                        out.append((p["anchor"], False, *key, 0, p["weight"], raw[a : a + n - 1 + WIDTH]))
                        continue
                    part = prefix_hash(BYTE_VALUE[data[a : a + n - 1 + WIDTH]])
                    places = signed(span_hash(part, np.arange(n), np.arange(n) + WIDTH)).tolist()
                    out += [(place, True, *key, j, p["weight"], raw[a + j : a + j + WIDTH]) for j, place in enumerate(places)]
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = [x.split()[0] for x in PIECE.split(", ")]
            for a in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 4096], strict=True), kinds, strict=True)], names)

    return rows.join(wanted.hint("merge"), list(ROW)).select("text", "strings").mapInArrow(run, PIECE)


DECIDED = "anchor long, d1 long, d2 long, at int, windows int"


def solved(rows: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
    """(DECIDED for the PIECEs of whole places, the flags of all their windows)."""
    data, offs = flat(rows.column("bytes"))
    flags = repeated(data, offs, rows.column("weight").to_numpy(), WIDTH)
    begin = np.r_[0, np.cumsum(np.diff(offs) - WIDTH + 1)]
    new, around = np.zeros(len(flags) + 1, bool), np.r_[False, flags, False]
    new[begin] = True  # runs don't go on from string to string
    start = np.flatnonzero(flags & (~around[:-2] | new[:-1]))
    stop = np.flatnonzero(flags & (~around[2:] | new[1:])) + 1
    of = np.searchsorted(begin, start, "right") - 1
    at = start - begin[of] + rows.column("at").to_numpy()[of]
    keys = [pa.array(rows.column(c).to_numpy()[of]) for c in STRING]
    return pa.RecordBatch.from_arrays([*keys, pa.array(at.astype(np.int32)), pa.array((stop - start).astype(np.int32))], [x.split()[0] for x in DECIDED.split(", ")]), flags


def carried(rows: pa.Table, flags: np.ndarray) -> pa.Table:
    """What must be held of a place of single windows whose first rows are solved: those not repeated yet, and one of each that is, which repeats any to come."""
    whole = np.frombuffer(flat(rows.column("bytes"))[0], f"V{WIDTH}")
    _, one = np.unique(whole[flags], return_index=True)
    known = rows.take(pa.array(np.flatnonzero(flags)[one]))
    known = known.set_column(known.schema.get_field_index("weight"), "weight", pa.array(np.full(len(known), 2)))
    return pa.concat_tables([rows.filter(pa.array(~flags)), known]).combine_chunks()


def by_place(batches: Iterator[pa.RecordBatch], limit: int = 4 * PLACE_BYTES) -> Iterator[pa.RecordBatch]:
    """DECIDED for PIECEs sorted by place: whole places together up to BATCH_BYTES, and a place of single windows in pieces of `limit` bytes."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        place = held.column("place").to_numpy()
        ends = np.flatnonzero(place[1:] != place[:-1]) + 1  # of whole places; the last one may go on
        size = flat(held.column("bytes"))[1]
        a = 0
        while (left := ends[ends > a]).size:
            b = int(left[max(0, int(np.searchsorted(size[left], size[a] + BATCH_BYTES, "right")) - 1)])
            if b == left[-1] and size[b] - size[a] < BATCH_BYTES // 2:
                break
            yield solved(held.slice(a, b - a).combine_chunks())[0]
            a = b
        held = held.slice(a)
        if not len(ends) and size[-1] > limit and held.column("split")[0].as_py():
            found, flags = solved(held)
            yield found
            held = carried(held, flags)
    if held is not None and len(held):
        yield solved(held.combine_chunks())[0]


def repeats(rows: DataFrame) -> DataFrame:
    """DECIDED: the windows of PIECEs that the transforms find at two positions or more."""
    return rows.repartition("place").sortWithinPartitions("split", "place").mapInArrow(by_place, DECIDED)


def covered(rows: DataFrame, place_bytes: int = PLACE_BYTES) -> DataFrame:
    """(ROW, first, windows): stretches of repeated windows that hold every repeated window of rows (ROW, text)."""
    marks = written(occurrences(rows), "bwt-marks")
    anchors = written(marks.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("inner")).where("n > 1 or inner").select("anchor"), "bwt-anchors")
    shared = written(marks.drop("twice").join(anchors.hint("merge"), "anchor"), "bwt-shared")
    dropped(marks, anchors)
    strings = written(shared.groupBy(*STRING).agg(F.count("*").alias("weight"), F.min(F.struct(*ROW, "first", "windows")).alias("s")).select(*STRING, "weight", "s.*"), "bwt-strings")
    large = strings.groupBy("anchor").agg(F.sum(F.col("windows") + WIDTH - 1).alias("bytes")).select("anchor", (F.col("bytes") > place_bytes).alias("split"))
    asked = strings.join(large.hint("merge"), "anchor").select(*ROW, F.struct(*STRING, "first", "windows", "weight", "split").alias("string"))
    decided = written(repeats(cut_out(rows, asked.groupBy(*ROW).agg(F.collect_list("string").alias("strings")))), "bwt-decided")
    dropped(strings)
    return shared.drop("windows").join(decided.hint("merge"), list(STRING)).select(*ROW, (F.col("first") + F.col("at")).alias("first"), "windows")


def remove_repeats(docs: DataFrame, place_bytes: int = PLACE_BYTES, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text), and kept, the remaining bytes."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary"))
    half = lambda a: F.conv(F.substring(key, a, 16), 16, -10).cast("long")
    rows = docs.select("doc_id", "text", half(1).alias("k1"), half(17).alias("k2"))
    cover = covered(rows.select(*ROW, "text"), place_bytes).groupBy(*ROW).agg(F.collect_list(F.struct("first", "windows")).alias("cover"))
    joined = rows.join(cover.hint("merge"), list(ROW), "left").select("doc_id", "text", "cover")
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit("").alias("kept_sha256"), *[F.lit(b"").alias("kept")] * with_bytes).schema
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offs = flat(batch.column("text"))
            ids, cover = batch.column("doc_id"), batch.column("cover")
            for a in range(0, len(batch), 512):
                out: list[tuple] = []
                for i in range(a, min(a + 512, len(batch))):
                    own = data[offs[i] : offs[i + 1]]
                    gone = spans = 0
                    if cover[i].is_valid:
                        edge = np.zeros(len(own) + 1, np.int32)
                        held = cover[i].values
                        first = held.field("first").to_numpy()
                        np.add.at(edge, first, 1)
                        np.add.at(edge, first + held.field("windows").to_numpy() - 1 + WIDTH, -1)
                        bad = np.cumsum(edge[:-1]) > 0
                        gone, spans = int(bad.sum()), int((bad & ~np.r_[False, bad[:-1]]).sum())
                        own = own[~bad]
                    kept = own.tobytes()
                    out.append((int(offs[i + 1] - offs[i]), gone, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(out)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [f.name for f in schema])

    return joined.mapInArrow(run, schema)
