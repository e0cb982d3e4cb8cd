"""Exact dedup by an extendible-hash index kept in files that all tasks share.

Build: every text has a 64-bit key; owner tasks take ranges of keys, one owner for each prefix of
``owner_bits`` bits. Map tasks merge the copies that they meet, a bounded number of bytes at a
time, so that a text that a third of all rows share reaches its owner a few times from each; rows
then go to their owner's partition by its number. The owner reads its rows in key order into its
hash table: a key's texts are chained and told apart by comparing their bytes, an overfull bucket
splits on its next key bit, and the directory doubles when the bucket was as deep as it. A bucket
that the keys have passed goes to the pages, so an owner holds one bucket and one chain. Pages and
the owners' parts of the directory are one table in the shared folder.

To drop copies, whole rows travel in place of texts and the owners' tables give back the rows that
stay. Lookup, for a report on every row: the directory is read back; a row's key leads through its slot to a bucket, and there
key and digest to the entry. Digests are only trusted because the build has compared bytes: it
fails loudly if two different texts of a chain had the same digest.

Rows: null text is the empty text. Of equal texts the largest doc_id stays (null is smallest);
of rows equal in id and text one stays. An empty table gives an empty result; extra columns and
any column order are ignored, whatever their names. Nothing is cut from long texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from linkloom.llm.common import lean, materialise
from linkloom.llm.words import slices

#: The directory has at most 2**MAX_DEPTH slots; buckets that deep grow instead of splitting.
MAX_DEPTH = 20
#: Distinct keys that a bucket holds before it splits.
BUCKET_KEYS = 4096
#: Bytes of texts among which a map task merges copies.
MERGE_BYTES = 1 << 25
#: Pages hold an entry for each distinct text, and for each bucket a row without key: the directory.
PAGES = "owner int, bucket long, depth int, key long, chain int, text_sha256 string, keep_id long, group_size long"
_NAMES = [x.split()[0] for x in PAGES.split(", ")]


class Table:
    """An owner's extendible hash table over the keys with its prefix, filled in ascending order of keys."""

    def __init__(self, owner: int, bits: int, capacity: int, max_depth: int = MAX_DEPTH):
        self.owner, self.capacity, self.max_depth = owner, capacity, max(max_depth, bits)
        self.depth = bits  # the directory's
        self.open = [(bits, owner, {})]  # buckets (depth, prefix, key -> entries), the lowest prefix last
        self.key, self.chain = None, []  # the key at hand and its texts [text, keep_id, copies]
        self.out: list[tuple] = []
        self.kept: list = []

    def insert(self, key: int, text: str, doc_id: int | None, copies: int, row=None) -> None:
        """key: unsigned. Equal texts meet in their key's chain and are found by comparing them.
        row: what stands for the row; that of each text's largest doc_id ends in ``kept``."""
        if key != self.key:
            self._store()
            self.key = key
        for entry in self.chain:
            if entry[0] == text:
                if entry[1] is None or (doc_id is not None and doc_id > entry[1]):
                    entry[1], entry[3] = doc_id, row
                entry[2] += copies
                return
        self.chain.append([text, doc_id, copies, row])

    def _store(self) -> None:
        """Put the chain at hand into its bucket."""
        if not self.chain:
            return
        self.kept += [row for *_, row in self.chain]
        entries = sorted((hashlib.sha256(text.encode()).hexdigest(), keep, n) for text, keep, n, _ in self.chain)
        if len({e[0] for e in entries}) < len(entries):
            raise ValueError("two texts of one key share a digest")
        while self.open[-1][1] != self.key >> (64 - self.open[-1][0]):
            self._page(*self.open.pop())
        self.open[-1][2][self.key] = entries
        self.chain = []
        while len(self.open[-1][2]) > self.capacity and self.open[-1][0] < self.max_depth:
            self._split()

    def _split(self) -> None:
        depth, prefix, held = self.open.pop()
        depth += 1
        self.depth = max(self.depth, depth)  # the directory doubles
        halves: tuple[dict, dict] = ({}, {})
        for key, entries in held.items():
            halves[key >> (64 - depth) & 1][key] = entries
        if halves[1]:  # keys ascend: nothing more comes for the lower half
            self._page(depth, 2 * prefix, halves[0])
            self.open.append((depth, 2 * prefix + 1, halves[1]))
        else:
            self.open += [(depth, 2 * prefix + 1, {}), (depth, 2 * prefix, halves[0])]

    def _page(self, depth: int, prefix: int, held: dict) -> None:
        bucket = _signed(prefix << (64 - depth))  # a bucket is named by its least key
        self.out.append((self.owner, bucket, depth, None, None, None, None, None))
        for key, entries in held.items():
            self.out += [(self.owner, bucket, depth, _signed(key), i, *e) for i, e in enumerate(entries)]

    def close(self) -> None:
        self._store()
        while self.open:
            self._page(*self.open.pop())

    def drain(self) -> pa.RecordBatch:
        cols = list(zip(*self.out)) if self.out else [()] * len(_NAMES)
        self.out = []
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], _NAMES)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def key_of(text: Column, key_bits: int = 64) -> Column:
    """The index key; fewer key_bits than 64 only serve tests, to force collisions."""
    key = F.xxhash64(text)
    return key if key_bits >= 64 else key.bitwiseAND(F.lit(-(1 << (64 - key_bits))))


def rows_of(docs: DataFrame, id_col: str, text_col: str, key_bits: int = 64) -> DataFrame:
    """(doc_id, key, text)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), key_of(text, key_bits).alias("key"), text.alias("text"))


def merged(rows: DataFrame, text: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """rows (doc_id, key, ...) with the number of copies: of the copies that a task meets among MERGE_BYTES
    of texts only the row with the largest doc_id goes on."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # text -> row number, doc_id, copies
        parts: list[pa.RecordBatch] = []
        size = seen = 0

        def merge() -> Iterator[pa.RecordBatch]:
            best = pa.Table.from_batches(parts).take(pa.array([v[0] for v in held.values()], pa.int64()))
            yield from best.append_column("copies", pa.array([v[2] for v in held.values()], pa.int64())).combine_chunks().to_batches()

        for batch in slices(batches, text):
            parts.append(batch)
            for n, (doc_id, x) in enumerate(zip(batch.column(0).to_pylist(), text(batch).to_pylist()), seen):
                own = held.get(x or "")
                if own is None:
                    held[x or ""] = [n, doc_id, 1]
                    continue
                if own[1] is None or (doc_id is not None and doc_id > own[1]):
                    own[:2] = n, doc_id
                own[2] += 1
            seen, size = seen + batch.num_rows, size + batch.nbytes
            if size >= MERGE_BYTES:
                yield from merge()
                held, parts, size, seen = {}, [], 0, 0
        if parts:
            yield from merge()

    schema = StructType([*rows.schema.fields, StructField("copies", LongType())])
    return rows.mapInArrow(lean(run), schema).select(*names, "copies")


def dealt(rows: DataFrame, text: Callable, bits: int) -> DataFrame:
    """Merged rows in their owners' partitions, in order of their keys."""
    return merged(rows, text).repartitionById(1 << bits, F.shiftrightunsigned("key", 64 - bits).cast("int")).sortWithinPartitions("key")


def owner_bits_of(spark: SparkSession, most: int = MAX_DEPTH) -> int:
    return min(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() - 1), most)


def build_index(rows: DataFrame, *, bucket_keys: int = BUCKET_KEYS, owner_bits: int | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """rows: (doc_id, key, text). Returns the index: pages and directory in one table."""
    bits = owner_bits or owner_bits_of(rows.sparkSession, max_depth)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(TaskContext.get().partitionId(), bits, bucket_keys, max_depth)
        for batch in slices(batches, _third):
            for doc_id, key, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
                table.insert(key % (1 << 64), text, doc_id, copies)
            if len(table.out) >= 20000:
                yield table.drain()
        table.close()
        yield table.drain()

    return materialise(dealt(rows, _third, bits).mapInArrow(lean(own), PAGES), "exact-index")


def _third(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(2)


def slots(index: DataFrame) -> tuple[DataFrame, int]:
    """The directory as stored, read back: (slot, bucket) of its 2**depth slots, and the depth."""
    buckets = index.where("key IS NULL").select("bucket", "depth")
    depth = buckets.agg(F.max("depth")).first()[0] or 1
    first = F.shiftrightunsigned("bucket", 64 - depth)
    wide = F.expr(f"shiftleft(1L, {depth} - depth)")
    return buckets.select(F.explode(F.sequence(first, first + wide - 1)).alias("slot"), "bucket"), depth


def look_up(entries: DataFrame, index: DataFrame) -> DataFrame:
    """entries (key, text_sha256, ...) with bucket, chain, keep_id and group_size of their texts."""
    directory, depth = slots(index)
    found = entries.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(F.broadcast(directory), "slot")  # 2**MAX_DEPTH rows at most
    pages = index.where("key IS NOT NULL").select("bucket", "key", "text_sha256", "chain", "keep_id", "group_size")
    return found.drop("slot").join(pages, ["bucket", "key", "text_sha256"])


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_keys: int = BUCKET_KEYS, owner_bits: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    rows = rows_of(docs, id_col, text_col, key_bits)
    index = build_index(rows, bucket_keys=bucket_keys, owner_bits=owner_bits)
    entries = materialise(rows.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256")), "exact-entries")
    found = look_up(entries, index)
    # rows that repeat both id and text: one of them stays
    repeats = entries.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not repeats.isEmpty():
        kept &= F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("key")) == 1
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain")


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows of docs that stay, with their columns, straight from the owners' tables: whole rows travel to
    them, once. Rows equal in id and text are copies, whatever their other columns hold: one stays."""
    bits = owner_bits_of(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), key_of(F.coalesce(text, F.lit(""))).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), *([] if dict(docs.dtypes)[text_col] == "string" else [text.alias("text")]))
    place = docs.columns.index(text_col)

    def text_of(batch: pa.RecordBatch) -> pa.Array:
        return pa.compute.struct_field(batch.column(2), [place]) if batch.column(2).type[place].type in (pa.string(), pa.large_string()) else batch.column(3)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(TaskContext.get().partitionId(), bits, bucket_keys)

        def kept() -> Iterator[pa.RecordBatch]:
            of: dict[int, tuple] = {}
            for part, n in table.kept:
                of.setdefault(id(part), (part, []))[1].append(n)
            table.kept, table.out = [], []
            for part, ns in of.values():
                yield part.select(["row"]).take(pa.array(ns, pa.int64()))

        for batch in slices(batches, text_of):
            copies = batch.column(batch.num_columns - 1).to_pylist()
            for n, (doc_id, key, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_of(batch).to_pylist())):
                table.insert(key % (1 << 64), x or "", doc_id, copies[n], (batch, n))
            yield from kept()
        table.close()
        yield from kept()

    return dealt(rows, text_of, bits).mapInArrow(lean(own), StructType([StructField("row", docs.schema)])).select("row.*")
