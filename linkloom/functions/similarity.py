"""String similarity kernels. Levenshtein is built in; the longest-common-subsequence family and
Jaro-Winkler run over Arrow batches, on distinct pairs if the caller makes them distinct.

ratio and its relatives are on 0..100, the others on 0..1. Two empty texts are equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


COMB_FROM = 24  # letters of the shorter text from which all windows are scored in one combing


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer text."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    if len(a) < 256:
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
    else:
        codes = _codes(a)
        for c in set(b):
            masks[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The shorter text against every window of the longer one, shorter windows at both ends included.

    Texts of one length are taken both ways round.
    """
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    if s in t:
        return 100.0
    windows = _windows if len(s) < COMB_FROM else _combed_windows
    return max(windows(s, t), windows(t, s)) if len(s) == len(t) else windows(s, t)


def _windows(s: str, t: str) -> float:
    """Window by window: for short texts, whose cost is the square of the short one by the long one."""
    m, best = len(s), 0.0
    letters = set(s)
    for end in range(1, len(t) + m):
        window = t[max(0, end - m) : end]
        # a window can only be best if its outer letter occurs in the short text
        if (end <= len(t) and window[-1] in letters) or (end > len(t) and window and window[0] in letters):
            best = max(best, ratio(s, window))
    return best


def _combed_windows(s: str, t: str) -> float:
    """All windows from one pass over the table of s by t, by semi-local comparison (seaweed combing).

    A strand that starts above column c and leaves below column e takes one from the common subsequence
    of every window with first column <= c and last column >= e. Cells of an antidiagonal are independent
    and their strands lie side by side, so each antidiagonal is a few array operations.
    """
    m, n = len(s), len(t)
    x, y = _codes(s)[::-1].copy(), _codes(t)
    across, down = np.arange(m, dtype=np.int32), np.arange(m, m + n, dtype=np.int32)
    for d in range(m + n - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        at = m - 1 - d
        h, v = across[at + lo : at + hi], down[lo:hi]
        out = np.minimum(h, v)
        np.copyto(out, v, where=x[at + lo : at + hi] == y[lo:hi])
        v += h
        v -= out
        h[:] = out
    first = down.astype(np.int64) - m
    last = np.flatnonzero(first >= 0)
    first = first[last]
    ends, starts = np.bincount(last, minlength=n).cumsum(), np.bincount(first, minlength=n)[::-1].cumsum()[::-1]
    size = np.arange(1, n + 1)
    best = 0.0
    short = size[: min(m - 1, n)]
    if len(short):
        heads, tails = short - ends[short - 1], short - starts[n - short]
        best = float((np.maximum(heads, tails) / (m + short)).max())
    if n >= m:
        # the windows of m columns that hold a whole strand: first columns last-m+1 .. first
        fits = last - first < m
        change = np.bincount(np.maximum(last[fits] - m + 1, 0), minlength=n + 1) - np.bincount(first[fits] + 1, minlength=n + 1)
        inside = m - change.cumsum()[: n - m + 1]
        best = max(best, float(inside.max()) / (2 * m))
    return 200.0 * best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    base, gap = len(" ".join(sorted(both))), 1 if both else 0
    n = 2 * (base + gap) + len(only_x) + len(only_y)
    best = 100.0 * (1 - (len(only_x) + len(only_y) - 2 * lcs(only_x, only_y)) / n)
    for only in (only_x, only_y) if both else ():
        best = max(best, 100.0 * (1 - (gap + len(only)) / (2 * base + gap + len(only))))
    return best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        # places below i - reach are out of reach for all later letters too
        left = places.get(c)
        while left and left[-1] < i - reach:
            left.pop()
        if left and left[-1] <= i + reach:
            used[left.pop()] = True
            hits.append(c)
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, half = len(hits), sum(x != y for x, y in zip(hits, other))
    jaro = (m / len(a) + m / len(b) + (m - half // 2) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


_KERNELS = {"ratio": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "jaro_winkler": jaro_winkler}


def similarities(a: Column, b: Column, *names: str) -> Column:
    """One struct with the named kernels, in one pass over the batch."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple] = {}
        out = []
        for p in zip(x.fillna(""), y.fillna("")):
            if p not in known:
                known[p] = tuple(_KERNELS[n](*p) for n in names)
            out.append(known[p])
        return pd.DataFrame(out, columns=list(names))

    return run(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / n)


def best_match(words: pd.Series, choices: list[str], cutoff: float) -> pd.Series:
    """The choice most like each word by ratio, if it reaches the cutoff; the first of equals."""

    def one(word: str):
        best = max(choices, key=lambda c: ratio(word, c))
        return best if ratio(word, best) >= cutoff else None

    return words.map({w: one(w) for w in words.unique()})
