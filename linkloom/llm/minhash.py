"""Near-dedup by SetSketch registers.

A document is its set of word shingles. Its sketch has exponentially spaced truncated minima:
register i is floor(1 - log_b(a * x)) for the least exponential variate x that the set's shingles
draw from hash i, cut to 16 bits; registers of a union are the maxima of its parts'. Equal sets
are collapsed to a class first. Registers are cut into bands; classes that share a band are
candidates. A joint maximum-likelihood estimate from the counts of greater, equal and smaller
registers discards pairs that 0.8 does not explain; what is left is confirmed on full sets.

No group emits all its pairs. In a star round every class is paired with one of its buckets'
representatives only, and only across components found so far; later rounds choose other
representatives. The last round compares, inside the buckets that still hold several components,
sketches and then full sets block by block in memory and emits only links that join components,
so that a component misses no link that a band has met.

Rows: a text without words has the empty set and links with nothing; null text is empty; rows
with one doc_id are one document; a null doc_id has component null and isn't kept. Rows that
repeat stay as rows. An empty table gives an empty result. Long texts are hashed whole, in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import components, in_groups, lean, materialise, release
from linkloom.llm.words import shingles, slices, word_hashes

#: Bands of registers. A pair with similarity 0.8 misses all bands with probability 2e-6.
BANDS, PER_BAND = 32, 5
REGISTERS = BANDS * PER_BAND
#: SetSketch parameters: base, rate, largest register.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
#: A pair is discarded if its best likelihood exceeds that of the threshold by so many nats.
NATS = 9.0
STAR_ROUNDS = 2
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 2048
#: Shingles of a block at most, on average.
BLOCK_SHINGLES = 1 << 23
#: Bits of the filter of ids whose full sets are needed: at most 2**17 words reach the driver.
FILTER_BITS = 23


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, REGISTERS, np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    a, c = _multipliers()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        y = x[at : at + 1024, None] * a
        y += c
        np.minimum(least, y.min(axis=0), out=least)
    u = (least + 0.5) / 4294967296.0  # a least uniform variate is a least exponential one
    k = np.floor(1.0 - np.log(RATE * -np.log1p(-u)) / np.log(BASE))
    return np.clip(k, 0, LIMIT).astype("<u2")


def likely(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, nats: float = NATS) -> np.ndarray:
    """Whether counts of registers a > b and a < b leave a Jaccard similarity >= threshold plausible.

    Joint likelihood of the three counts given the set sizes; sizes alone can exclude a pair.
    """
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    top = np.minimum(u / v, v / u)  # largest similarity that the sizes allow
    same = REGISTERS - up - down
    p = lambda x: -np.log(1.0 - x * (BASE - 1.0) / BASE) / np.log(BASE)

    def loglik(j):
        p_up, p_down = np.maximum(p(u - v * j), 1e-9), np.maximum(p(v - u * j), 1e-9)
        return up * np.log(p_up) + down * np.log(p_down) + same * np.log(np.maximum(1.0 - p_up - p_down, 1e-9))

    at = loglik(np.minimum(threshold, top))
    best = at
    for share in np.linspace(0.0, 1.0, 33):
        best = np.maximum(best, loglik(share * np.minimum(threshold, top)))
    return (top >= threshold - 1e-9) & (best - at <= nats)


def features(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the whole set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        for batch in slices(batches):
            hashes, first = word_hashes(batch.column(1))
            size, digest, regs = [], [], []
            for i in range(batch.num_rows):
                s = np.unique(shingles(hashes[first[i] : first[i + 1]], width))
                size.append(len(s))
                x, y = s * a, s * b
                digest.append(np.array([(x ^ x >> np.uint64(31)).sum() if len(s) else 0, (y ^ y >> np.uint64(29)).sum() if len(s) else 0], "<u8").tobytes())
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, sketch binary")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds all ids (and, by chance, a few others)."""
    h = ids.select(F.xxhash64("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("h"))
    words = h.groupBy(F.shiftright("h", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(h & 63)))").alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint64)


def full_sets(docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles) of the documents in ids: sorted 64-bit hashes. No text is shuffled; a bitmap
    of fixed size decides which texts are hashed, an exact join drops the few too many."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_id_filter(ids))  # 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (bitmap.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = batch.filter(pa.array(hit))
            hashes, first = word_hashes(batch.column(1))
            sets = [np.unique(shingles(hashes[first[i] : first[i + 1]], width)).astype("<u8").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    key = F.col(id_col).cast("long")
    rows = docs.where(key.isNotNull()).select(key.alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("h"))
    return rows.mapInArrow(lean(run), "id long, shingles binary").join(ids, "id", "left_semi").dropDuplicates(["id", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold_pct * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the joint likelihood of their sketches leaves plausible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.vstack([np.frombuffer(v.as_buffer(), "<u2") for v in batch.column(2)])
            y = np.vstack([np.frombuffer(v.as_buffer(), "<u2") for v in batch.column(3)])
            n = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 5)]
            keep = likely((x > y).sum(1), (x < y).sum(1), *n, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = reps.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n_shingles").alias("n"))
    right = reps.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n_shingles").alias("m"))
    near = pairs.join(left, "a").join(right, "b").where(100 * F.least("n", "m") >= round(100 * threshold) * F.greatest("n", "m"))
    return near.select("a", "b", "x", "y", "n", "m").mapInArrow(lean(run), "a long, b long").distinct()


def _pairs_within(key: np.ndarray, skip) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with the same key (sorted), one distance at a time, for all groups together."""
    n, starts = len(key), np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    i = np.arange(n)
    distance = 1
    while True:
        i = i[i + distance < ends[i]]
        if not len(i):
            return
        ok = ~skip(i, i + distance)
        yield i[ok], i[ok] + distance
        distance += 1


def _pairs_across(key: np.ndarray, comp: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with the same key and different components, some rows' pairs at a time; pairs of one
    component, most of a large group's, are never made."""
    order = np.lexsort((comp, key))
    key, comp = key[order], comp[order]
    turn = np.r_[True, key[1:] != key[:-1]]
    ends = lambda new: np.repeat(np.r_[np.flatnonzero(new)[1:], len(key)], np.diff(np.r_[np.flatnonzero(new), len(key)]))
    after = ends(turn | np.r_[True, comp[1:] != comp[:-1]])
    n = ends(turn) - after
    made = np.cumsum(n)
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(made, made[lo] - n[lo] + most, "right")))
        own = n[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        yield order[i], order[np.arange(len(i)) + np.repeat(after[lo:hi] - np.cumsum(own) + own, own)]
        lo = hi


def _plausible(frame: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal registers): pairs across components that a band meets here first and whose likelihood is plausible."""
    x = np.frombuffer(b"".join(frame["sketch"]), "<u2").reshape(-1, REGISTERS)
    bands = x.reshape(len(x), BANDS, PER_BAND)
    comp, n, block, band = (frame[c].to_numpy() for c in ("comp", "n_shingles", "block", "band"))
    crossed = (frame["p"] != frame["q"]).to_numpy()
    key = np.unique(frame[["bkey", "p", "q"]].to_numpy(), axis=0, return_inverse=True)[1].ravel()
    out = [(np.empty(0, np.int64),) * 3]
    for i, j in _pairs_across(key, comp):
        ok = ~(crossed[i] & (block[i] == block[j])) & (100 * np.minimum(n[i], n[j]) >= round(100 * threshold) * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 16384):
            a, b = i[at : at + 16384], j[at : at + 16384]
            same = (bands[a] == bands[b]).all(axis=2)
            first = same.argmax(axis=1) == band[a]
            a, b = a[first], b[first]
            if not len(a):
                continue
            up, down = (x[a] > x[b]).sum(1), (x[a] < x[b]).sum(1)
            ok = likely(up, down, n[a].astype(float), n[b].astype(float), threshold)
            out.append((a[ok], b[ok], (REGISTERS - up - down)[ok]))
    return tuple(np.concatenate(v) for v in zip(*out))


def _cross_links(members: DataFrame, reps: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Links that join the components inside the buckets in members (bkey, band, id, comp).

    A bucket is cut into blocks; a task compares two blocks in memory, each pair only in the first
    band that it shares. A first pass on sketches names the rows with a plausible partner; only
    their full sets travel to the second, which confirms pairs, likeliest first, unless links
    that it has found already connect them. Neither pass emits more than its rows.
    """
    threshold = threshold_pct / 100
    sized = members.join(reps.select("id", "sketch", "n_shingles"), "id")
    load = members.join(reps.select("id", "n_shingles"), "id").groupBy("bkey").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"))
    load = load.select("bkey", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = sized.join(materialise(load, "minhash-load"), "bkey").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    keys = ["bkey", "p", "q"]

    def name(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = _plausible(frame, threshold)
        return frame.iloc[np.unique(np.concatenate([i, j]))][[*keys, "band", "id", "comp", "block"]]

    named = in_groups(rows.select(*keys, "band", "id", "comp", "block", "sketch", "n_shingles"), keys, name, "bkey long, p int, q int, band int, id long, comp long, block int")
    named = materialise(named, "minhash-plausible")
    full = named.join(reps.select("id", "sketch", "n_shingles"), "id").join(sets, "id")

    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        i, j, same = _plausible(frame, threshold)
        ids, comp, found = frame["id"].to_numpy(), frame["comp"].to_numpy(), []
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        have = [np.frombuffer(v, "<u8") for v in frame["shingles"]]
        for k in np.argsort(-same, kind="stable"):
            a, b = i[k], j[k]
            x, y = find(comp[a]), find(comp[b])
            if x == y:
                continue
            both = len(np.intersect1d(have[a], have[b], assume_unique=True))
            if 100 * both >= threshold_pct * (len(have[a]) + len(have[b]) - both):
                root[x] = y
                found.append((ids[a], ids[b]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return in_groups(full.select(*keys, "band", "id", "comp", "block", "sketch", "n_shingles", "shingles"), keys, confirm, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold_pct: int = 80, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    of = {"id_col": id_col, "text_col": text_col, "width": width}
    threshold = threshold_pct / 100
    feats = materialise(features(docs, **of), "minhash-features")
    slim = feats.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "n_shingles", "digest")
    # aggregates are written before they are joined: adaptive execution splits hot keys of plain scans only
    classes = slim.groupBy("digest").agg(F.min("doc_id").alias("class"), F.max("doc_id").alias("high")).where("class < high").select("digest", "class")
    classes = materialise(classes, "minhash-digests")
    # ids of equal sets, linked to the class's smallest id
    member = slim.join(classes, "digest").where("doc_id <> class").select(F.col("class").alias("a"), F.col("doc_id").alias("b"), "digest")
    copies = materialise(member.distinct(), "minhash-members")
    member = copies.select("a", "b").distinct()
    # a document's other texts keep their sketches
    reps = feats.join(copies.select(F.col("b").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_anti").where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = materialise(reps.select(F.col("doc_id").alias("id"), "n_shingles", "sketch").dropDuplicates(["id", "sketch"]), "minhash-classes")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * PER_BAND * i, 2 * PER_BAND)) for i in range(BANDS)])
    bands = reps.select("id", F.posexplode(keys).alias("band", "bkey"))
    shared = bands.groupBy("bkey").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bkey")
    met = materialise(bands.join(materialise(shared, "minhash-shared"), "bkey"), "minhash-buckets")
    ids = materialise(met.select("id").distinct(), "minhash-ids")
    sets = materialise(full_sets(docs, ids, **of), "minhash-sets")
    links = member
    for turn in range(star_rounds + 1):
        now = met.withColumn("comp", F.col("id"))
        if turn:
            comp = materialise(components(links), "minhash-roots")
            now = met.join(comp.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            # only buckets that still hold several components
            open_ = now.groupBy("bkey").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bkey")
            now = materialise(now.join(materialise(open_, "minhash-open-keys"), "bkey"), "minhash-open")
        if turn == star_rounds:
            new = _cross_links(now, reps, sets, threshold_pct)
        else:
            # a representative by a bijection of the ids that differs with band and turn
            salt = F.xxhash64("band", F.lit(turn))
            star = now.groupBy("bkey", "band").agg(F.min(F.col("id").bitwiseXOR(salt)).alias("rep")).select("bkey", F.col("rep").bitwiseXOR(salt).alias("rep"))
            star = materialise(star, "minhash-stars")
            pairs = now.join(star, "bkey").where("id <> rep")
            if turn:
                mark = comp.select(F.col("id").alias("rep"), F.col("root").alias("rep_comp"))
                pairs = pairs.join(mark, "rep", "left").where("comp <> coalesce(rep_comp, rep)")
            # one representative per class and turn
            near = pairs.groupBy("id").agg(F.min("rep").alias("rep")).select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()
            new = verified(_estimated(near, reps, threshold), sets, threshold_pct)
        links = links.unionByName(materialise(new, "minhash-links"))
    roots = materialise(components(links), "minhash-roots")
    out = feats.select("doc_id", "n_shingles").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    release(sets)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that stay: one document of each group, with their columns; rows without an id stay."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **kw).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    gone = materialise(gone, "minhash-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")
