"""Words of Arrow string columns as numpy arrays, without a Python object a word.

A batch's texts lie in one byte buffer; word bounds come from a 256-entry table
of separator bytes, and each word gets a 64-bit hash of its bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
#: Bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes outside [0-9A-Za-z\x80-\xFF].
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LONG = 48


class Words(NamedTuple):
    buf: np.ndarray  # bytes of all texts, case folded if asked
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    off: np.ndarray  # words of text i: off[i] .. off[i + 1]

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def buffer_of(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 bounds of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_string()) if col.null_count == 0 else col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words_of(col, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    buf, offs = buffer_of(col)
    if lower:
        buf = LOWER[buf]
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(separators[buf], out=inside[1:-1])
    # A text's end ends its last word also where the next text starts with one.
    edge = inside[1:] != inside[:-1]
    begins = edge & inside[1:]
    ends = edge & inside[:-1]
    cut = offs[1:-1]
    both = cut[(inside[cut] & inside[cut + 1])] if len(cut) else cut
    begins[both] = True
    ends[both] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(buf, start, end, np.searchsorted(start, offs))


def hash_words(w: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    n = w.end - w.start
    h = np.full(len(n), 0x9E3779B97F4A7C15, _U)
    if not len(n):
        return h
    order = np.argsort(-np.minimum(n, _LONG + 1).astype(np.int16), kind="stable")
    start, size = w.start[order], n[order]
    out = h[order]
    first = np.searchsorted(-size, -_LONG, side="left")  # longer ones are hashed one by one
    for k in range(int(min(size[first], _LONG)) if first < len(size) else 0):
        top = np.searchsorted(-size, -(k + 1), side="right")
        part = out[first:top]
        part ^= w.buf[start[first:top] + k]
        part *= _U(0xFF51AFD7ED558CCD)
        part ^= part >> _U(29)
    raw = w.buf
    for i in range(first):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]].tobytes())
    out ^= size.astype(_U) * _U(0xC4CEB9FE1A85EC53)
    mix(out)
    h[order] = out
    return h


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur's finaliser, in place."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def _odd(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) * _U(2) + _U(1)


def hash_one(words: list[bytes]) -> np.ndarray:
    """Hashes of given words, for looking them up."""
    return hash_words(words_of(pa.array([w.decode() for w in words], pa.string()), np.zeros(256, bool)))


def window_hashes(h: np.ndarray, off: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one text, and each one's first word."""
    if len(h) < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    c = _odd(k, seed)
    out = h[: len(h) - k + 1] * c[0]
    for j in range(1, k):
        out += h[j : len(h) - k + 1 + j] * c[j]
    valid = np.ones(len(out), bool)
    for j in range(1, k):  # windows that start in a text's last k - 1 words
        at = off[1:] - j
        at = at[(at >= 0) & (at >= off[:-1]) & (at < len(out))]
        valid[at] = False
    pos = np.flatnonzero(valid)
    return mix(out[pos]), pos
