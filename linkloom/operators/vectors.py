"""Character n-grams, words and their TF-IDF weights as postings tables.

A posting is a row (id, gram, ...); nothing is keyed by a vocabulary on the driver. scope columns
(such as a country) make document frequencies local to them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import batch
from linkloom.functions.text import number_words, words
from linkloom.operators.blocking import top_k

#: Rows of a block of vectors, and those of it that meet another block at once.
BLOCK, TOGETHER = 8192, 512
#: Words that a task counts before it passes its counts on.
COUNTED = 1 << 20
#: Words up to which only these are counted: they are sent to all tasks.
ASKED = 1 << 19


def char_ngrams(c: Column, n: int = 3) -> Column:
    """n-grams inside words, each word with one blank on both sides."""
    def of(w):
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) + 3 - n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))

    return F.flatten(F.transform(words(c), of))


def hashed(grams: Column, bits: int = 22) -> Column:
    """Grams as numbers of a fixed vocabulary of 2**bits; colliding grams count as one."""
    return F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(1 << bits)))


def postings(rows: DataFrame, grams: Column, ids: Sequence[str]) -> DataFrame:
    """(ids..., gram, tf). The texts are dealt by id, so their grams need no shuffle of their own, nor does
    what is later computed for each id."""
    return rows.repartition(*ids).select(*ids, F.explode(grams).alias("gram")).groupBy(*ids, "gram").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return post.groupBy(*scope, "gram").agg(F.count("*").alias("df"))


def text_frequencies(rows: DataFrame, texts: Callable[[tuple], dict], asked: DataFrame | None = None) -> DataFrame:
    """(what, gram, df): in how many rows a word or 3-gram is. texts makes a row's tuple into what is counted, by name:
    words in a list, or a text for its char_ngrams.

    Tasks count what they hold, so a gram is shuffled once for each of them, not for each row. asked: (gram)
    words whose counts are needed; others are left out unless these are more than ASKED.
    """
    few = asked.limit(ASKED + 1).toArrow()["gram"].to_pylist() if asked is not None else []
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(few) if asked is not None and len(few) <= ASKED else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts, kinds = sent.value, {}, {}

        def passed() -> Iterator[pa.RecordBatch]:
            for what, count in counts.items():
                grams = batch.spelled(np.array(list(count), np.int64)) if kinds[what] is str else list(count)
                yield pa.RecordBatch.from_arrays([pa.array([what] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(list(count.values()), pa.int64())], ["what", "gram", "df"])
            counts.clear()

        for b in batches:
            made = [texts(r) for r in zip(*[c.to_pylist() for c in b.columns])]
            kinds.update({what: type(x) for what, x in made[0].items()} if made else {})
            for what, kind in kinds.items() if made else ():
                all_, count = [m[what] for m in made], counts.setdefault(what, Counter())
                if kind is not str:
                    for w in all_:
                        count.update(set(w) if wanted is None else wanted.intersection(w))
                    continue
                for s in batch.together(all_):
                    _, gram, _ = batch.char_ngrams(all_[s])
                    gram, df = np.unique(gram, return_counts=True)
                    for g, n in zip(gram.tolist(), df.tolist()):
                        count[g] += n
            if sum(map(len, counts.values())) > COUNTED:
                yield from passed()
        yield from passed()

    return rows.mapInArrow(run, "what string, gram string, df long").groupBy("what", "gram").agg(F.sum("df").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(post: DataFrame, n_docs: DataFrame, ids: Sequence[str], scope: Sequence[str] = (), frequencies: DataFrame | None = None, bounded: bool = False) -> DataFrame:
    """Adds df and w: (1 + ln tf) * idf, each document of length 1. n_docs: (scope..., n).

    bounded: grams come from a small alphabet (n-grams of cleaned text: 37**3 at most, in each scope), so
    their frequencies are broadcast and postings stay where they are; otherwise they meet by a shuffle.
    """
    df = frequencies if frequencies is not None else document_frequency(post, scope)
    rows = post.join(F.broadcast(df) if bounded and not scope else df, [*scope, "gram"])
    rows = rows.join(F.broadcast(n_docs), list(scope)) if scope else rows.crossJoin(F.broadcast(n_docs))  # a row per scope
    rows = rows.withColumn("w", (1 + F.log("tf")) * idf(F.col("df"), F.col("n")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*ids)))
    return rows.withColumn("w", F.col("w") / norm)


def word_idf(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(gram, idf) of words, binary presence."""
    return document_frequency(post).crossJoin(F.broadcast(n_docs)).select("gram", idf(F.col("df"), F.col("n")).alias("idf"))  # one row


def number_postings(rows: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    return rows.select(*ids, F.explode(F.array_distinct(number_words(F.col(text)))).alias("gram"))


def field_postings(rows: DataFrame, fields: dict[str, str], ids: Sequence[str]) -> DataFrame:
    """(ids..., field, gram): which fields hold a gram."""
    parts = [rows.select(*ids, F.lit(name).alias("field"), F.explode(F.array_distinct(char_ngrams(F.col(col)))).alias("gram")) for name, col in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_dot(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str = "s1", b: str = "s23") -> DataFrame:
    """Cosine of the pairs' weight rows; left (a, gram, w), right (b, gram, w). Pairs without a common gram get 0."""
    hit = pairs.select(a, b).distinct().join(left.withColumnRenamed("w", "wa"), a).join(right.withColumnRenamed("w", "wb"), [b, "gram"])
    dots = hit.groupBy(a, b).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(dots, [a, b], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


def shared_idf(pairs: DataFrame, left: DataFrame, right: DataFrame, weights: DataFrame, a: str = "s1", b: str = "s23") -> DataFrame:
    """shared / (sum of a + sum of b - shared) of word idfs; left (a, gram), right (b, gram)."""
    x, y = left.join(weights, "gram"), right.join(weights, "gram")
    sum_a = x.groupBy(a).agg(F.sum("idf").alias("sum_a"))
    sum_b = y.groupBy(b).agg(F.sum("idf").alias("sum_b"))
    both = pairs.select(a, b).join(x, a).join(right, [b, "gram"]).groupBy(a, b).agg(F.sum("idf").alias("shared"))
    out = pairs.join(both, [a, b], "left").join(sum_a, a, "left").join(sum_b, b, "left").na.fill(0.0, ["shared", "sum_a", "sum_b"])
    return out.withColumn("idf_jaccard", F.try_divide("shared", F.col("sum_a") + F.col("sum_b") - F.col("shared")))


def centroid_support(candidates: DataFrame, weights: DataFrame, a: str = "s1", b: str = "s23", p: str = "p") -> DataFrame:
    """For each candidate the p-weighted cosine to the other candidates of its record.

    The sum over the others is the record's weighted centroid without the candidate itself, so
    candidates meet one centroid instead of each other. weights: (b, gram, w).
    """
    terms = candidates.select(a, b, p).join(weights, b)
    centre = terms.groupBy(a, "gram").agg(F.sum(F.col(p) * F.col("w")).alias("total"))
    dots = terms.join(centre, [a, "gram"]).groupBy(a, b).agg(F.sum(F.col("w") * F.col("total")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("own"))
    others = F.sum(p).over(Window.partitionBy(a)) - F.col(p)
    rows = candidates.withColumn("others", others).join(dots, [a, b], "left")
    return rows.withColumn("support", F.when((F.col("others") > 1e-3) & F.col("dot").isNotNull(), (F.col("dot") - F.col(p) * F.col("own")) / F.col("others"))).drop("dot", "own")


def nearest(rows: DataFrame, k: int, key: str, vector: str, *, every: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, near, score, rank): the k other rows of the largest cosine, exactly; equal scores in the order of their keys.

    every: only rows whose key it divides ask; all rows answer.

    The rows are dealt into blocks; a task multiplies two blocks and emits k rows a query at most.
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where(F.col("id").isNotNull() & (F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v) > 0))
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ask = rows.where(F.col("id") % every == 0).select("id", "x", F.lit(True).alias("asks"), F.col("own").alias("q"), F.col("other").alias("d"))
    have = rows.select("id", "x", F.lit(False).alias("asks"), F.col("other").alias("q"), F.col("own").alias("d"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(a) and len(b):
            b = b.sort_values("id")
            unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
            one, two = (unit(np.stack(t["x"]).astype(float)) for t in (a, b))
            ids, j = a["id"].to_numpy(), b["id"].to_numpy()
            at = max(0, len(j) - k)
            for lo in range(0, len(ids), TOGETHER):
                i = ids[lo : lo + TOGETHER]
                s = np.round(one[lo : lo + TOGETHER] @ two.T, 6)
                s[i[:, None] == j[None, :]] = -np.inf
                least = np.partition(s, at, axis=1)[:, at]
                r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                order = np.lexsort((c, -s[r, c], r))
                r, c = r[order], c[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((i[r[keep]], j[c[keep]], s[r[keep], c[keep]]))
        return pd.DataFrame(dict(zip(("id", "near", "score"), map(np.concatenate, zip(*out)))))

    scores = ask.unionByName(have).groupBy("q", "d").applyInPandas(run, "id long, near long, score double")
    return top_k(scores.withColumnRenamed("id", key), k, [key], F.col("score").desc(), F.col("near"))
