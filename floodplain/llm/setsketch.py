"""SetSketch registers: exponentially spaced, truncated minima of set elements.

Each element draws M ascending points with exponential spacings from its own
seeded stream and deals them to the registers, each register once. A register
keeps the smallest point it gets, as its truncated logarithm
floor(1 - log_b x), so a union's sketch is the elementwise maximum. With a base
this close to 1 the share of equal registers is close to the Jaccard
similarity; the order of unequal registers gives the rest of the likelihood.
"""

from __future__ import annotations

import numpy as np

from .blocks import ODD, U, mix

M = 128
BASE = 1.001
RATE = 20.0
TOP = 65_534
LOG_BASE = float(np.log(BASE))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x M) registers of sets of 64-bit element hashes; an empty set's are 0."""
    out = np.zeros((len(sets), M), np.uint16)
    element = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = mix(element + ODD[20])
    step = (mix(element + ODD[21]) & U(M - 1) | U(1)).astype(np.int64)
    first = (seed & U(M - 1)).astype(np.int64)
    point = np.zeros(len(element))
    cells = out.reshape(-1)
    for j in range(M):
        if not len(element):
            break
        uniform = ((mix(seed + U((j + 1) * int(ODD[22]) & (1 << 64) - 1)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
        point += -np.log(uniform) / (RATE * (M - j))
        value = np.clip(np.floor(1 - np.log(point) / LOG_BASE), 0, TOP + 1).astype(np.uint16)
        np.maximum.at(cells, owner * M + (first + step * j) % M, value)
        live = value > out.min(axis=1)[owner]
        if not live.all():
            element, owner, seed, step, first, point = (x[live] for x in (element, owner, seed, step, first, point))
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def band_hashes(regs: np.ndarray, rows: int) -> np.ndarray:
    """(sets x M // rows) hashes of register values by band."""
    bands = M // rows
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(U)
    return mix((parts * ODD[30 : 30 + rows]).sum(axis=2, dtype=U) + np.arange(1, bands + 1, dtype=U) * ODD[29])


_GRID = np.linspace(0, 1, 201)


def _share(x: np.ndarray) -> np.ndarray:
    """-log_b(1 - x (b - 1) / b): the chance that a register is larger by x of the rate."""
    return -np.log1p(-x * (BASE - 1) / BASE) / LOG_BASE


def likely_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity (to 0.005) from numbers of registers that are larger, smaller and equal, and known set sizes."""
    larger, smaller = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    equal = a.shape[-1] - larger - smaller
    u = size_a / np.maximum(size_a + size_b, 1)
    out = np.empty(np.shape(larger))
    for at in range(0, len(out), 4096):
        s = slice(at, at + 4096)
        us = np.asarray(u)[s, None]
        vs = 1 - us
        up = np.maximum(_share(np.maximum(us - vs * _GRID, 0)), 1e-12)
        down = np.maximum(_share(np.maximum(vs - us * _GRID, 0)), 1e-12)
        same = np.maximum(1 - up - down, 1e-12)
        possible = (us - vs * _GRID >= -1e-9) & (vs - us * _GRID >= -1e-9)
        chance = larger[s, None] * np.log(up) + smaller[s, None] * np.log(down) + equal[s, None] * np.log(same)
        out[s] = _GRID[np.where(possible, chance, -np.inf).argmax(axis=1)]
    return out
