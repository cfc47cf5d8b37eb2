"""Vectorised access to Arrow text columns: byte views, words, word digests, chunking.

Whole texts, lines and stretches are known by BLAKE2 digests. Word hashes,
prefix_hash() and span_hash() only screen: who uses them compares words or bytes
afterwards. Every helper works on whole texts. A chunk is a run of rows whose bytes stay
below a limit, so that memory is bounded; a single longer text is a chunk of
its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

CHUNK_BYTES = 1_000_000

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
#: Random odd multiplier and its inverse modulo 2**64, and random byte values.
BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) | 1
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_pow[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for k, base in enumerate((BASE, BASE_INV)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _pow[k] = np.cumprod(steps, dtype=U)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str | int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `limit` bytes of a text column, or one row; nothing is copied."""
    for batch in batches:
        column = batch.column(text)
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        if not len(column) or column.buffers()[1] is None:
            yield batch
            continue
        offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        for a, b in chunks(offs.astype(np.int64), limit):
            yield batch.slice(a, b - a)


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def chunked(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for each chunk."""
    data, offs = flat(column)
    for a, b in chunks(offs, limit):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; span_hash() reads spans from them."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=out[1:], dtype=U)
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal contents give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U) * ODD[0])


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without white space, and the words' offsets by row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def digests(pieces: Iterable[bytes], size: int) -> np.ndarray:
    """Cryptographic digests of byte strings, as 64-bit numbers: `size` bytes give size / 8 of them in a row."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=size).digest() for p in pieces]), U).reshape(-1, size // 8)


def word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lower-cased words (A-Z only), each word's place among them, the words' offsets by row)."""
    starts, ends, by_row = word_spans(data, offs)
    solid = LOWER[data[~SPACE[data]]]
    ends_at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_at), pa.py_buffer(solid)]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), by_row


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (A-Z only) and the words' offsets by row. Each distinct word of the rows is hashed once."""
    distinct, codes, by_row = word_codes(data, offs)
    own, ends = flat(distinct)
    raw, ends = own.tobytes(), ends.tolist()
    hashes = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(ends, ends[1:], strict=False)), U, len(distinct))
    return hashes[codes], by_row


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) by chunk.

    A text with fewer than `width` words has its whole sequence as its one
    shingle; a text without words has none.
    """
    for a, b, data, offs in chunked(column):
        words, by_row = word_hashes(data, offs)
        n = max(0, len(words) - width + 1)
        grams = np.zeros(n, U)
        for k in range(width):
            grams += words[k : k + n] * ODD[k + 1]
        grams = mix(grams)
        sets = []
        for i in range(b - a):
            lo, hi = int(by_row[i]), int(by_row[i + 1])
            if hi - lo >= width:
                g = np.sort(grams[lo : hi - width + 1])
                sets.append(g[np.r_[True, g[1:] != g[:-1]]])
            elif hi > lo:
                whole = (words[lo:hi] * ODD[1 : 1 + hi - lo]).sum(dtype=U) + np.array([hi - lo], U) * ODD[0]
                sets.append(mix(whole))
            else:
                sets.append(np.zeros(0, U))
        yield a, sets


def real_sets(column: pa.Array, width: int, known: pa.Array | None = None) -> tuple[Callable[[int], np.ndarray], pa.Array]:
    """(a function that gives a row's sorted distinct shingles, the words that their numbers stand for).

    A shingle is the numbers of its words, and a number stands for one word: the place in `known`, or after it. So
    sets whose numbers go back to one list of words are compared as what they are, not by a hash.
    """
    data, offs = flat(column)
    words, codes, by_row = word_codes(data, offs)
    if known is not None and len(words):
        place = pc.index_in(words, value_set=known).to_numpy(zero_copy_only=False)
        new = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        number = np.where(new, len(known) + np.cumsum(new) - 1, np.nan_to_num(place)).astype(np.int64)
        codes, words = number[codes], pa.concat_arrays([known, words.filter(pa.array(new))])
    elif known is not None:
        words = known
    codes = codes.astype(np.int32)

    def row(i: int) -> np.ndarray:
        own = codes[by_row[i] : by_row[i + 1]]
        if not len(own):
            return np.zeros(0, f"V{4 * width}")
        if len(own) < width:
            own = np.r_[own, np.full(width - len(own), -1, np.int32)]
        return np.unique(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(own, width)).view(f"V{4 * width}").ravel())

    return row, words


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)
