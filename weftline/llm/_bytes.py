"""Vectorised work on the UTF-8 bytes of whole Arrow string columns: words, their hashes, and mixing functions."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of text that are worked on at once; the arrays take some 40 times as much.
CHUNK = 3 << 20
#: The same for the stages of a pipeline, whose workers keep memory beside each other's and the executor's.
STAGE_CHUNK = 1 << 20

_WORD = np.zeros(256, np.bool_)
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True
_WORD[128:] = True

_pow = [np.ones(1, U64), np.ones(1, U64)]


_libc: list = []


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on after its stage, beside others on the executor."""
    pa.default_memory_pool().release_unused()
    if not _libc:
        try:
            _libc.append(ctypes.CDLL("libc.so.6"))
            _libc[0].malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to do
            _libc[:] = [None]
    elif _libc[0] is not None:
        _libc[0].malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo 2**64."""
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            a = np.full(n, base, U64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and its n + 1 offsets into them."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def filled(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.fill_null("") if arr.null_count else arr


def pieces(arr: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes; a longer text is a range of its own, never split.  After the last, free memory is given back."""
    _, off = buffer(arr)
    a, n = 0, len(arr)
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b
    trim()


@dataclass
class Words:
    """Words of some texts: byte ranges, hashes, index of the text, and where each text's words begin (n + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offset: np.ndarray


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] times the inverse power of i being the hash of bytes i to j."""
    pw, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U64)
    t = s[1:]  # worked on in place: eight bytes for each of the text's
    t[:] = data
    t += U64(1)
    t *= pw[: len(data)]
    np.add.accumulate(t, out=t)
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(s))
    return mix((s[end] - s[start]) * inv[start])


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the runs of true bytes; none crosses an offset."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = off[(off > 0) & (off < n)]
    begins = flag.copy()
    begins[1:] &= ~flag[:-1]
    begins[inner] = flag[inner]
    ends = flag.copy()
    ends[:-1] &= ~flag[1:]
    ends[inner - 1] = flag[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(arr: pa.Array, lower: bool = True, is_word: np.ndarray = _WORD) -> Words:
    """Maximal runs of letters, digits and non-ASCII bytes of every text, in lower case."""
    if lower:
        arr = pc.utf8_lower(arr)
    data, off = buffer(arr)
    a, b = runs(is_word[data], off)
    doc = np.searchsorted(off, a, side="right") - 1
    return Words(data, a, b, range_hash(prefix_hash(data), a, b), doc, np.searchsorted(doc, np.arange(len(arr) + 1)), off)


def shingles(w: Words, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive words, and the n + 1 places where each text's begin.

    A text of fewer words has the one hash of all of them; one without words has none.
    """
    per = np.diff(w.first)
    count = np.where(per == 0, 0, np.maximum(per - width + 1, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(w.first[:-1], count)
    stop = np.repeat(w.first[1:], count)
    h = np.zeros(len(at), U64)
    padded = np.concatenate([w.hash, np.zeros(width, U64)])
    for k in range(width):
        x = padded[at + k]
        if k:
            x = np.where(at + k < stop, x, U64(0))
        h = h * U64(0x9FB21C651E98DF25) + x
    return mix(h), first
