"""Vectorised word hashing on Arrow string buffers.

Words are runs of bytes other than blank and the control characters 9 to 13, with A-Z lowered.
A word's hash is a polynomial over its bytes modulo 2**64, finished by a mixer; it is the same
in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is the empty text."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): one hash per word, and for each row the number of its first word (one more
    entry at the end). Bytes are taken _CHUNK at a time, so a long text, or a word of any length,
    needs little more than its words' hashes."""
    raw, rows = buffers(column)
    first = np.zeros(len(rows), np.int64)
    out, begun, inside = [], 0, False
    held = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))  # the open word's sum, inverse, place
    carry, scale, unscale = 0, 1, 1
    for p in range(0, len(raw), _CHUNK):
        part = raw[p : p + _CHUNK]
        n, is_word = len(part), _WORD[part]
        before = np.concatenate([[inside], is_word[:-1]])
        starts = is_word & ~before
        lo, hi = np.searchsorted(rows, [p, p + n])
        cuts = rows[lo:hi] - p
        starts[cuts] = is_word[cuts]
        b, e = np.flatnonzero(starts), np.flatnonzero(before & (~is_word | starts))  # words end before e
        first[lo:hi] = begun + np.searchsorted(b, cuts)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        sums = sums * np.uint64(scale) + np.uint64(carry)
        held = (np.append(held[0], sums[b]), np.append(held[1], _power(_INVERSE, n)[b] * np.uint64(unscale)), np.append(held[2], b + p))
        k = len(e)
        out.append((sums[e] - held[0][:k]) * held[1][:k] + (e + p - held[2][:k]).astype(np.uint64))
        held = tuple(v[k:] for v in held)
        carry, begun, inside = int(sums[-1]), begun + len(b), bool(is_word[-1])
        scale, unscale = scale * pow(_BASE, n, 1 << 64) % (1 << 64), unscale * pow(_INVERSE, n, 1 << 64) % (1 << 64)
    first[np.searchsorted(rows, len(raw)) :] = begun
    if inside:
        out.append((np.uint64(carry) - held[0]) * held[1] + (len(raw) - held[2]).astype(np.uint64))
    return mix64(np.concatenate([*out, np.empty(0, np.uint64)])), first


def slices(batches: Iterator[pa.RecordBatch], text: Callable = lambda batch: batch.column(1), most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = buffers(text(batch))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of a text's word shingles in order; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    out = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : n - w + 1 + j]
        out ^= out >> np.uint64(29)
    return mix64(out)
