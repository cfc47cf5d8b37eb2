"""Repeated substrings by merging Burrows-Wheeler transforms of shards.

A string is read in strides: position i has the symbol of its next STRIDE bytes
(a dense number, equal for equal bytes) and is followed by position i + STRIDE.
So `depth` symbols are depth * STRIDE bytes, at every byte position, and the
transform of all such strings needs few rounds. Symbols come from hashes, whose
bytes are compared then; should a hash ever stand for two strings, the bytes are sorted instead.

Each shard gets its transform from its own suffix order. The transforms are
then merged: an interleave says which shard each merged row comes from. One
refinement puts the rows in the order of their preceding symbols, stably, which
sorts them by one symbol more; the ends of strings stay in shard order. Rows
that get the same symbol from one block stay one block, so after h rounds blocks
are the runs with a common prefix of h symbols: after `depth` rounds, blocks that
stand for two positions or more are the repeated intervals. Suffixes are never compared again.

Up to 65,535 rows, all ranks are 16 bits wide, which numpy sorts by radix.
"""

from __future__ import annotations

import numpy as np

from .blocks import BYTE_VALUE, prefix_hash, span_hash

STRIDE = 50


def narrow(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.int64


def symbols_of(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Dense numbers, equal where the STRIDE bytes from `start` are."""
    hashes = span_hash(prefix_hash(BYTE_VALUE[data]), start, start + STRIDE)
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    at = start[order]
    for k in (*range(0, STRIDE - 7, 8), STRIDE - 8):
        w = words[at + k]
        if (w[1:] != w[:-1])[~new[1:]].any():
            whole = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, STRIDE)[start])
            return np.unique(whole.view(f"V{STRIDE}").ravel(), return_inverse=True)[1].astype(narrow(len(start)))
    out = np.empty(len(order), narrow(len(order)))
    out[order] = np.cumsum(new) - 1
    return out


def sorted_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A stable order by two ranks."""
    if first.dtype == np.uint16:
        order = np.argsort(second, kind="stable")
        return order[np.argsort(first[order], kind="stable")]
    return np.argsort(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second, kind="stable")


class Shard:
    """The suffix order and transform of some strings, given their positions' symbols."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, count: np.ndarray):
        """first, count: each string's positions in `symbols`."""
        n = int(count.sum())
        base = first[0] if len(first) else 0
        own = symbols[base : base + n]
        end = np.repeat(first - base + count, count)
        begin = np.repeat(first - base, count)
        at = np.arange(n)
        rank, step = own.astype(narrow(max(n + 1, int(own.max(initial=0)) + 1))), STRIDE
        longest = int(count.max(initial=0))
        while step < longest:
            after = np.zeros(n, rank.dtype)
            more = np.flatnonzero(at + step < end)
            after[more] = rank[more + step] + 1
            order = sorted_pairs(rank, after)
            r, a = rank[order], after[order]
            new = np.ones(n, bool)
            new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1])
            rank[order] = np.cumsum(new) - 1
            step *= 2
        order = np.argsort(rank, kind="stable")
        before = np.full(n, -1, np.int64)
        inner = at - STRIDE >= begin
        before[inner] = own[at[inner] - STRIDE]
        last = at[at + STRIDE >= end]  # of each strided string
        self.ends, self.rows = len(last), n
        self.place = np.r_[np.full(len(last), -1), base + order]
        self.bwt = np.r_[own[last], before[order]]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, blocks) of the merged rows that aren't ends; equal blocks have `depth` symbols in common."""
    ends = np.concatenate([np.full(s.ends, k, np.uint16) for k, s in enumerate(shards)])
    rows = np.concatenate([np.full(s.rows, k, np.uint16) for k, s in enumerate(shards)])
    fixed = len(ends)
    interleave = np.r_[ends, rows]
    block = np.zeros(len(interleave), np.int64)
    symbols, places = np.concatenate([s.bwt for s in shards]), np.concatenate([s.place for s in shards])
    kind = narrow(int(symbols.max(initial=0)) + 1)
    of_shard = np.empty(len(interleave), np.int64)
    for _ in range(depth):
        of_shard[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))  # merged row to row of its shard
        preceding = symbols[of_shard]
        inner = np.flatnonzero(preceding >= 0)
        order = inner[np.argsort(preceding[inner].astype(kind), kind="stable")]
        symbol, was = preceding[order], block[order]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])
        interleave = np.r_[ends, interleave[order]]
        block = np.r_[np.arange(1, fixed + 1), fixed + np.cumsum(new)]
    place = np.empty(len(interleave), np.int64)
    place[np.argsort(interleave, kind="stable")] = places
    return place[fixed:], block[fixed:]


def repeated(data: np.ndarray, offs: np.ndarray, weight: np.ndarray, width: int, shard_bytes: int = 20_000) -> np.ndarray:
    """For each string (bytes of `data` between two `offs`) and each position in it that has `width` bytes: whether they start at two places or more.

    Flags of all strings, one after the other. A string of weight w stands for w equal ones. `width` must be a multiple of STRIDE.
    """
    size = np.diff(offs)
    windows = np.maximum(0, size - width + 1)
    usable = np.flatnonzero(windows)
    if not len(usable):
        return np.zeros(0, bool)
    count = size[usable] - STRIDE + 1
    first = np.r_[0, np.cumsum(count)]
    start = np.arange(first[-1]) + np.repeat(offs[usable] - first[:-1], count)
    symbols = symbols_of(data, start)
    cuts = [0, *(np.flatnonzero(np.diff(offs[usable + 1] // shard_bytes)) + 1).tolist(), len(usable)]
    shards = [Shard(symbols, first[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    place, block = merge(shards, width // STRIDE)
    begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    stands = np.add.reduceat(np.repeat(weight[usable], count)[place], begin)
    flags = np.zeros(first[-1], bool)
    flags[place] = np.repeat(stands >= 2, np.diff(np.r_[begin, len(block)]))
    own = np.arange(windows.sum()) + np.repeat(first[:-1] - np.r_[0, np.cumsum(windows[usable])[:-1]], windows[usable])
    return flags[own]
