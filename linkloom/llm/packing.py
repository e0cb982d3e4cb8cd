"""Packing by Karmarkar-Karp multiway differencing.

Every document becomes token ids and an end id. Whole windows are cut from documents longer than
one; what is left of each goes whole to a pool of POOL windows, which multiway differencing
partitions: the two partial partitions with the largest imbalance are merged so that the fullest
windows of one meet the emptiest of the other, until one partition is left. Its windows are
near-equal; while one exceeds the capacity, the number of windows rises by one, RISES times at most
(more would be padding). What still exceeds is cut off the largest items and fills the windows with
room, so a document is cut where it must be. The last words of a task, less than a window, are cut
at powers of two.

Rows: null text is the empty text (one piece holding the end id); a null id is kept; rows that
repeat are packed each; an empty table gives no piece; other columns are ignored, whatever their
names. Long documents are tokenised whole, in parts that end between words; runs of blanks or
letters of any length are tokenised by the tokenizers library itself. A pool belongs to a task, so
memory is bounded by a batch, a document and a pool, and a lost task is redone alone.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import lean
from linkloom.llm.words import slices

CAPACITY = 1024
#: Windows of a pool, and how often their number may rise.
POOL, RISES = 256, 1
#: Characters that are tokenised at a time, at least; a longer run of word characters or blanks goes to the slower library.
PART, LONG_RUN = 1 << 20, 1000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the items (by number) of each of k sets of near-equal sums."""
    if not sizes:
        return [[] for _ in range(k)]
    if k == 1:
        return [list(range(len(sizes)))]
    # a node: sums in ascending order; children and, for each slot, which slots of them it joins
    heap, nodes = [], []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        nodes.append((i,))
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joined = x + y[::-1]
        order = np.argsort(joined, kind="stable")
        sums = joined[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (int(sums[0] - sums[-1]), len(nodes) - 1, sums - sums[0]))
    found: list[list[int]] = [[] for _ in range(k)]
    stack = [(len(nodes) - 1, np.arange(k))]  # node, the set that each of its slots ends in
    while stack:
        n, to = stack.pop()
        if len(nodes[n]) == 1:
            found[to[-1]].append(nodes[n][0])
            continue
        a, b, order = nodes[n]
        of = np.empty(k, np.int64)
        of[order] = to
        stack.append((a, of))
        stack.append((b, of[::-1]))
    return found


def windows_of(sizes: list[int], capacity: int, k: int | None = None, rises: int = RISES) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, from, length) within capacity: near-equal ones of whole items; k rises while
    one exceeds the capacity, at most ``rises`` times. Then what still exceeds it is cut off the largest
    items and fills the windows with room."""
    k = k or max(1, -(-sum(sizes) // capacity))
    for last in [False] * rises + [True]:
        sets = differencing(sizes, k)
        if max((sum(sizes[i] for i in s) for s in sets), default=0) <= capacity:
            return [[(i, 0, sizes[i]) for i in s] for s in sets if s]
        if not last:
            k += 1
    out, over = [], []
    for s in sets:
        own = sorted(((sizes[i], i) for i in s), reverse=True)
        excess = sum(x for x, _ in own) - capacity
        window = []
        for size, i in own:
            cut = min(size, max(0, excess))
            excess -= cut
            if cut:
                over.append((cut, i, size - cut))
            if size > cut:
                window.append((i, 0, size - cut))
        out.append(window)
    room = sorted((capacity - sum(x[2] for x in w), j) for j, w in enumerate(out))
    for size, i, at in sorted(over, reverse=True):
        while size:
            pick = bisect_left(room, (size, -1))  # the window that it fills best, else the one with most room
            free, j = room.pop(min(pick, len(room) - 1))
            n = min(size, free)
            out[j].append((i, at, n))
            if free > n:
                insort(room, (free - n, j))
            size, at = size - n, at + n
    return [w for w in out if w]


def _parts(text: str, most: int = PART) -> Iterator[str]:
    """Parts of a long text that begin at a blank between two words, where every pre-token ends."""
    at = 0
    while len(text) - at > most:
        m = _BETWEEN.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def _longest_run(text: str) -> int:
    """A bound on the length of a pre-token: the longest word, or all blanks but one between words."""
    words = text.split()
    lengths = list(map(len, words))
    return max(max(lengths, default=0), len(text) - sum(lengths) - len(words))


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids as the tokenizers library gives them from a file, without added special tokens.

    A byte-level BPE whose merges rank like their ids can be run from its vocabulary by the
    tiktoken library, several times faster; probes decide at load whether both agree. Texts that hold a
    special token's string, and parts with a run of LONG_RUN characters without a change between
    words and blanks, always go to the tokenizers library, as do all if the probes differ.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    added = list(slow.get_added_tokens_decoder().values())
    special = [t.content for t in added]
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    fast = _fast(slow, plain, set(special))
    whole = slow.normalizer is not None or any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added)

    def encode(text: str) -> np.ndarray:
        if whole or any(s in text for s in special):
            return np.array(plain(text), "<u4")
        ids = [np.array(plain(x) if fast is None or _longest_run(x) >= LONG_RUN else fast(x), "<u4") for x in _parts(text)]
        return ids[0] if len(ids) == 1 else np.concatenate(ids)

    return encode


def _fast(slow, plain: Callable, special: set[str]) -> Callable | None:
    try:
        import tiktoken
    except ImportError:
        return None
    to_byte = {c: b for b, c in byte_alphabet().items()}
    vocab = {w: i for w, i in slow.get_vocab().items() if w not in special}
    if any(c not in to_byte for w in vocab for c in w):
        return None
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={bytes(to_byte[c] for c in w): i for w, i in vocab.items()}, special_tokens={})
    probes = ["", "It's  a\n\n test\t42,000 ", "Étion çà — naïve ß", "日本語 テキスト🙂", "a" * 300, "   x\r\ny", "don't'LL 'S"]
    probes += [" ".join(sorted(vocab)[i : i + 400]) for i in range(0, len(vocab), 9973)]
    return fast.encode_ordinary if all(fast.encode_ordinary(p) == plain(p) for p in probes) else None


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and (b < 127 or b > 160)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


class _Packer:
    """Packs the documents of one task; pieces come out as tuples in the columns' order."""

    def __init__(self, task: int, capacity: int, pool: int):
        self.next_id, self.capacity, self.pool = task << 33, capacity, pool
        self.items: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held, self.out = 0, []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids), tokens, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def flush(self, items: list[tuple], k: int | None = None) -> None:
        for own in windows_of([len(x[2]) for x in items], self.capacity, k):
            pieces = [(items[i], at, n) for i, at, n in own]
            self.emit([(doc_id, start + at, ids[at : at + n], tokens) for (doc_id, start, ids, tokens), at, n in pieces])

    def take(self, items: list[tuple], tokens: int) -> tuple[list, list]:
        """Cut a list of items after so many tokens."""
        done, n = [], 0
        for i, (doc_id, start, ids, total) in enumerate(items):
            if n + len(ids) >= tokens:
                cut = tokens - n
                rest = [(doc_id, start + cut, ids[cut:], total)] if cut < len(ids) else []
                return done + ([(doc_id, start, ids[:cut], total)] if cut else []), rest + items[i + 1 :]
            done.append((doc_id, start, ids, total))
            n += len(ids)
        return done, []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, full, self.capacity):
            self.emit([(doc_id, at, ids[at : at + self.capacity], total)])
        if total == full:
            return
        if self.held + total - full > self.pool * self.capacity:  # this rest is the next pool's first
            self.flush(self.items)
            self.items, self.held = [], 0
        self.items.append((doc_id, full, ids[full:], total))
        self.held += total - full

    def close(self) -> None:
        whole = self.held // self.capacity
        if whole:
            now, self.items = self.take(self.items, whole * self.capacity)
            self.held -= whole * self.capacity
            self.flush(now, whole)
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            now, self.items = self.take(self.items, size)
            self.held -= size
            self.emit(now)

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) if self.out else [()] * len(_NAMES)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file that every executor can open. No shuffle: a task packs
    the rows it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = _Packer(TaskContext.get().partitionId(), capacity, pool)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4"))
                if len(packer.out) >= 20000:
                    yield packer.drain()
        packer.close()
        yield packer.drain()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), SCHEMA)
