"""Shared pieces: word and shingle hashing, besides written tables and connected components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

from ..operators.graph import components  # noqa: F401
from ..plans.scratch import Scratch, partitions, shared_dir  # noqa: F401

#: ASCII white space, the only word separators of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def _give_back() -> None:
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A function over Arrow batches whose worker gives memory back when a partition is done: the worker lives on between
    stages, and what it holds counts against its executor. Batches come from the system's allocator, which keeps none."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        _give_back()

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
#: Powers are kept for so many bytes; longer texts are hashed block by block.
BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.cumprod(np.full(n, base, np.uint64))
    return out


_P = 0xD1342543DE82EF95
_POW, _INV = _powers(_P, BLOCK), _powers(pow(_P, -1, 1 << 64), BLOCK)


def word_hashes(raw: bytes, most: int = 0) -> np.ndarray:
    """A 64-bit hash of each word of a text; A-Z count as a-z, words are parted by ASCII white space. With ``most``,
    of the first so many bytes of each word."""
    return prefix_hashes(raw, (most,))[0]


def prefix_hashes(raw: bytes, lengths: tuple) -> list[np.ndarray]:
    """The same for several lengths at once, 0 for whole words, from one pass over the text."""
    b = np.frombuffer(raw, np.uint8)
    none = [np.zeros(0, np.uint64) for _ in lengths]
    if not b.size:
        return none
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not start.size:
        return none
    ends = [np.minimum(end, start + most) if most else end for most in lengths]
    out = [np.zeros(start.size, np.uint64) for _ in lengths]
    k = 0
    while k < start.size:
        # a block of whole words; a word longer than a block is hashed piece by piece
        lo = start[k]
        j = int(np.searchsorted(end, lo + BLOCK, "right"))
        if j <= k:
            for stop, h_of in zip(ends, out):
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for at in range(lo, stop[k], BLOCK):
                        piece = _CODE[_LOWER[b[at : min(stop[k], at + BLOCK)]]]
                        more = (piece * _POW[: piece.size]).sum(dtype=np.uint64)
                        h = mixed(np.array([h], np.uint64))[0] + more if at > lo else more
                h_of[k] = h
            k += 1
            continue
        hi = end[j - 1]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_CODE[_LOWER[b[lo:hi]]] * _POW[: hi - lo], out=total[1:])
        base, scale = total[start[k:j] - lo], _INV[start[k:j] - lo]
        for stop, h_of in zip(ends, out):
            h_of[k:j] = (total[stop[k:j] - lo] - base) * scale
        k = j
    return [mixed(h + (stop - start).astype(np.uint64) * _BASE) for h, stop in zip(out, ends)]


def shingle_hashes(raw: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; fewer words make one shingle, none make none."""
    w = word_hashes(raw)
    if not w.size:
        return w
    take = min(n, w.size)
    h = np.full(w.size - take + 1, np.uint64(take), np.uint64)
    for i in range(take):
        h = mixed(h * _BASE + w[i : w.size - take + 1 + i])
    return np.unique(h)


def crc_sql(text: str) -> str:
    """crc32 by its bits in SQL: each byte is followed by seven zeros, and each of these shifts once (0xEDB88320, reflected)."""
    return f"""xor(cast(4294967295 as bigint), list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split({text}, ''), lambda b: [cast(ascii(b) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: cast(xor(cast(xor(c, x) >> 1 as bigint), cast(3988292384 * (xor(c, x) & 1) as bigint)) as bigint)))"""
