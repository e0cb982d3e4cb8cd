"""Near-dedup of embeddings by randomised-rotation binary codes.

Unit vectors are turned by random orthogonal matrices; the signs are the code. One rotation
serves estimates: with the stored factor f = <code, vector>, <code, other> / f is an unbiased
estimate of the inner product, with an error of about sqrt((1 - f^2) / f^2 / (D - 1)). Only pairs
whose upper confidence bound reaches the threshold are recomputed exactly, in double precision.
Further rotations give the bands of sign bits by which vectors meet at all; the number of bits
grows with the logarithm of the number of vectors, the number of bands with the recall asked for.

Pass one sends codes and 4-bit copies of the rotated vectors through the buckets and names the
rows that have a plausible partner; pass two sends only their full vectors. A pair counts in the
first band that it shares. Links are counted in the tasks, so no pair leaves one; large buckets
are cut into blocks that are compared two by two.

Rows: a vector that is null, zero, or holds null or non-finite components links with nothing, as
does one without an id; vectors link only with others of their own length; equal vectors are collapsed first and counted with
their number. Rows of one vec_id but different vectors are vectors of their own in one component.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import components, in_groups, lean, materialise
from linkloom.llm.minhash import _pairs_within

#: Share of pairs at the threshold that no band meets, at most.
MISS = 0.002
#: Half-width of the confidence interval in standard errors.
SIGMAS = 3.0
BLOCK = 2048


def plan(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors."""
    bits = min(30, max(10, math.ceil(math.log2(max(2, n))) - 5))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - p))


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    rng = np.random.Generator(np.random.PCG64([7919, dim, number]))
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(column) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encode(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """cid, h, dim, sign bits of all bands, and for estimates code, factor and 4-bit vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                dim = int(dim)
                if dim not in turned:
                    turned[dim] = [rotation(dim, i) for i in range(1 + -(-bits * bands // dim))]
                x = _unit(part["embedding"])
                est = x @ turned[dim][0]
                sign = est > 0
                factor = np.abs(est).sum(1) / math.sqrt(dim)
                step = np.abs(est).max(1) / 7.5
                four = np.clip(np.floor(est / step[:, None] + 8), 0, 15).astype(np.uint8)
                if dim % 2:
                    four = np.pad(four, ((0, 0), (0, 1)))
                four = four[:, ::2] | four[:, 1::2] << 4
                signs = np.hstack([x @ r > 0 for r in turned[dim][1:]])[:, : bits * bands]
                keys = signs.reshape(len(x), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({
                    "cid": part["cid"], "h": part["h"], "dim": dim, "keys": list(keys.astype(np.int64)), "code": [v.tobytes() for v in np.packbits(sign, axis=1)],
                    "factor": factor, "step": step, "four": [v.tobytes() for v in four],
                })

    return classes.mapInPandas(lean(run), "cid long, h long, dim int, keys array<long>, code binary, factor double, step double, four binary")


def _estimates(frame: pd.DataFrame, i: np.ndarray, j: np.ndarray, cache: dict) -> np.ndarray:
    """Upper confidence bounds of the inner products of rows i and j."""
    dim = cache["dim"]
    one = np.einsum("ij,ij->i", cache["sign"][i], cache["rough"][j]) / cache["factor"][i] + cache["wide"][i]
    two = np.einsum("ij,ij->i", cache["sign"][j], cache["rough"][i]) / cache["factor"][j] + cache["wide"][j]
    return np.minimum(one, two) if dim > 1 else np.ones(len(i))


def _named(frame: pd.DataFrame, threshold: float) -> np.ndarray:
    """Rows with a partner in their group whose upper bound reaches the threshold."""
    hit = np.zeros(len(frame), bool)
    for dim, part in frame.groupby("dim", sort=False):
        dim, at = int(dim), part.index.to_numpy()
        sign = np.unpackbits(np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1), axis=1)[:, :dim]
        raw = np.frombuffer(b"".join(part["four"]), np.uint8).reshape(len(part), -1)
        four = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(part), -1)[:, :dim]
        f = part["factor"].to_numpy()
        cache = {
            "dim": dim, "factor": f, "sign": (sign * np.float32(2) - 1) / np.float32(math.sqrt(dim)),
            "rough": ((four.astype(np.float32) - 7.5) * part["step"].to_numpy(np.float32)[:, None]),
            "wide": SIGMAS * np.sqrt(np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1)) + 1e-3,
        }
        key = (part["bkey"] != part["bkey"].shift()) | (part["p"] != part["p"].shift()) | (part["q"] != part["q"].shift())
        block, crossed = part["block"].to_numpy(), (part["p"] != part["q"]).to_numpy()
        mark = hit[at]
        for i, j in _pairs_within(key.cumsum().to_numpy(), lambda i, j: crossed[i] & (block[i] == block[j])):
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                ok = _estimates(part, a, b, cache) >= threshold
                mark[a[ok]] = mark[b[ok]] = True
        hit[at] = mark
    return hit


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots (each the smallest number of its component) once the links (a, b) are added."""
    while True:
        u, v = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (u == v).all():
            return root
        root = root.copy()
        np.minimum.at(root, v, u)
        while (root[root] != root).any():
            root = root[root]


def _links(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Per row its exact links first met here (with the partners' numbers) and a partner that joins components."""
    out = []
    for (_, p, q), own in frame.groupby(["bkey", "p", "q"], sort=False):
        x = _unit(own["embedding"])
        keys = np.array(own["keys"].tolist())
        band, mult, block = int(own["band"].iat[0]), own["mult"].to_numpy(), own["block"].to_numpy()
        cid, h = own["cid"].to_numpy(), own["h"].to_numpy()
        count, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(x), 512):
            i, j = np.nonzero(x[at : at + 512] @ x.T >= threshold)
            i += at
            ok = (i < j) & ((block[i] != block[j]) if p != q else True)
            i, j = i[ok], j[ok]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                ok = (keys[a] == keys[b]).argmax(axis=1) == band
                a, b = a[ok], b[ok]
                np.add.at(count, a, mult[b])
                np.add.at(count, b, mult[a])
                root = _joined(root, a, b)
        low = root
        got = count > 0
        out.append(pd.DataFrame({"cid": cid[got], "h": h[got], "links": count[got], "other": cid[low][got]}))
    return pd.concat(out) if out else pd.DataFrame({"cid": [], "h": [], "links": [], "other": []}, dtype="int64")


def near_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)).alias("sound"))
    rows = rows.withColumn("h", F.when(F.col("sound"), F.xxhash64("embedding"))).withColumn("g", F.when(F.col("sound"), F.xxhash64("embedding", F.lit(1))))
    slim = materialise(rows.select("vec_id", "h", "g"), "vectors-keys")
    classes = slim.where("h IS NOT NULL").groupBy("h", "g").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult"))
    classes = materialise(classes.select("cid", F.xxhash64("h", "g").alias("hg"), "h", "g", "mult"), "vectors-classes")
    n = classes.count()
    bits, bands = plan(n, threshold)
    raw = rows.where("sound").join(classes.where("mult >= 1").select(F.col("cid").alias("vec_id"), "h", "g", "mult"), ["vec_id", "h", "g"])
    raw = raw.dropDuplicates(["vec_id", "h", "g"]).select(F.col("vec_id").alias("cid"), "h", "mult", F.size("embedding").alias("dim"), "embedding")
    raw = materialise(raw, "vectors-raw")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = materialise(encode(raw.select("cid", "h", "dim", "embedding").repartition(parts, "cid"), bits, bands), "vectors-codes")
    met = codes.select("cid", "h", "dim", "code", "factor", "step", "four", F.posexplode("keys").alias("band", "bits"))
    met = met.withColumn("bkey", F.xxhash64("dim", "band", "bits"))
    sizes = met.groupBy("bkey").agg(F.count("*").alias("n")).where("n > 1").select("bkey", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = met.join(materialise(sizes, "vectors-buckets"), "bkey").withColumn("block", F.pmod(F.xxhash64("cid", "h"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    keys = ["bkey", "p", "q"]

    def name(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.loc[_named(frame, threshold), [*keys, "band", "block", "cid", "h"]]

    named = in_groups(met.select(*keys, "band", "block", "cid", "h", "dim", "code", "factor", "step", "four"), keys, name, "bkey long, p int, q int, band int, block int, cid long, h long")
    named = materialise(named, "vectors-named")
    full = named.join(raw.select("cid", "h", "mult", "embedding"), ["cid", "h"]).join(codes.select("cid", "h", "keys"), ["cid", "h"])
    links = in_groups(full.select(*keys, "band", "block", "cid", "h", "mult", "keys", "embedding"), keys, lambda f: _links(f, threshold), "cid long, h long, links long, other long")
    links = materialise(links, "vectors-links")
    counts = links.groupBy("cid", "h").agg(F.sum("links").alias("links"))
    member = slim.join(classes, ["h", "g"])
    edges = links.select(F.col("cid").alias("a"), F.col("other").alias("b")).unionByName(member.select(F.col("cid").alias("a"), F.col("vec_id").alias("b"))).where("a <> b").distinct()
    roots = components(edges, name="vectors-cc").withColumnRenamed("id", "vec_id")
    per = classes.join(counts, ["cid", "h"], "left").select("h", "g", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = slim.join(per, ["h", "g"], "left").join(roots, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
