"""Toxicity by a classifier chain.

Categories are predicted in order. Each has a linear (logistic) model over the text's words; a
later model also sees the earlier categories' log-odds. For training these come from out-of-fold
predictions, so that a later model meets what it will meet on new rows; for prediction they come
from the models fitted on all rows. The last category is the verdict's.

The models are fitted on a sample of at most about SAMPLE labelled rows, taken by a hash of the
id; words and beginnings of words are learned that tell the classes apart beyond chance. Every
document is judged, whole.

Rows: null text is the empty text; a document without an id is judged but can't be learned from;
a null label leaves its row out of the training; rows that repeat are judged alike, and of an id's
several texts the one whose codes sort first is learned from; without a
labelled row of each class a category's probability is the share of its positives, or 0. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import lean

#: Labelled rows that the chain is fitted on, at most (in expectation).
SAMPLE = 12000
FOLDS = 5
#: A feature is learned if its likelihood-ratio statistic exceeds 2 ln(features) by so much.
EVIDENCE = 2.0
#: Besides whole words, their beginnings of these lengths are features.
STARTS = (4, 5)
_WORDS = re.compile(r"\w+|[^\w\s]+")


def word_codes(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit codes of the text's words, their beginnings, and punctuation runs."""
    words = set(_WORDS.findall((text or "").lower()))
    starts = {f"{n}^{w[:n]}" for w in words for n in STARTS if len(w) > n}
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words | starts), np.uint32))


class Linear:
    """Logistic model over some binary features (sorted codes) and a few dense ones."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.codes, self.weights, self.dense, self.bias = codes, weights, dense, bias

    def hits(self, row: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, row), len(self.codes) - 1)
        return at[self.codes[at] == row]

    def logit(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return np.array([self.weights[self.hits(r)].sum() for r in rows]) + dense @ self.dense + self.bias


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Codes whose presence tells the classes apart: G statistics beyond what chance gives among so many."""
    flat = np.concatenate([*rows, np.empty(0, np.uint32)])
    codes, at = np.unique(flat, return_inverse=True)
    n = np.bincount(at, minlength=len(codes))
    a = np.bincount(at, np.repeat(y, [len(r) for r in rows]), len(codes))
    rest = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(p, 1e-12)), 0)
    share, b = y.mean(), n - a
    c, d = y.sum() - a, (len(y) - y.sum()) - b
    g = 2 * (rest(a, n * share) + rest(b, n * (1 - share)) + rest(c, (len(y) - n) * share) + rest(d, (len(y) - n) * (1 - share)))
    return codes[g >= 2 * np.log(max(2, len(codes))) + EVIDENCE]


def fit_linear(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> Linear:
    """Full-batch AdaGrad with weight decay over the telling features."""
    share = y.mean() if len(y) else 0.0
    out = Linear(np.empty(0, np.uint32), np.zeros(0), np.zeros(dense.shape[1]), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if share in (0.0, 1.0):
        return out
    out.codes = telling(rows, y)
    hits = [out.hits(r) for r in rows]
    col = np.concatenate([*hits, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(h) for h in hits])
    w, d, b = np.zeros(len(out.codes)), np.zeros(dense.shape[1]), out.bias
    gw, gd, gb = np.full(len(w), 1e-8), np.full(len(d), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(rows)) + dense @ d + b
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(col, e[row], len(w)) + decay * w
        gw += g * g
        w -= 0.5 * g / np.sqrt(gw)
        g = dense.T @ e + decay * d
        gd += g * g
        d -= 0.1 * g / np.sqrt(gd)
        g = e.sum()
        gb += g * g
        b -= 0.5 * g / np.sqrt(gb)
    out.weights, out.dense, out.bias = w, d, float(b)
    return out


class Chain:
    """Models in order; each sees the log-odds of those before it."""

    def __init__(self, names: list[str], models: list[Linear], limits: list[float]):
        self.names, self.models, self.limits = names, models, limits

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), 0))
        for m in self.models:
            out = np.hstack([out, np.clip(m.logit(rows, out), -20, 20)[:, None]])
        return out


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, names: list[str], folds: int = FOLDS) -> Chain:
    """labels: a column per category, NaN where unknown. Rows come in a stable order."""
    n = len(rows)
    fold = np.random.Generator(np.random.PCG64(11)).permutation(n) % folds  # not aligned with any order of the rows
    dense, models, limits = np.zeros((n, 0)), [], []
    for c in range(labels.shape[1]):
        y = labels[:, c]
        known = ~np.isnan(y)
        pick = lambda m: ([rows[i] for i in np.flatnonzero(m)], dense[m], y[m])
        out_of_fold = np.zeros(n)
        for f in range(folds):
            rest = fold == f
            if rest.any():
                out_of_fold[rest] = fit_linear(*pick(known & ~rest)).logit([rows[i] for i in np.flatnonzero(rest)], dense[rest])
        out_of_fold = np.clip(out_of_fold, -20, 20)  # as predictions are
        models.append(fit_linear(*pick(known)))
        limits.append(best_limit(out_of_fold[known], y[known]))
        dense = np.hstack([dense, out_of_fold[:, None]])
    return Chain(names, models, limits)


def best_limit(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds at which out-of-fold predictions have the best F1; of the equally good ones the nearest to 0."""
    if not len(y) or not 0 < y.mean() < 1:
        return 0.0
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1
    return float(min(z[order[k]], max(0.0, (z[order[k]] + low) / 2 if low > 0 else 0.0)))


def fit(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]], *, id_col="doc_id", text_col="text", sample: int = SAMPLE) -> Chain:
    """categories: (name, SQL over the label columns giving 0 or 1), in the chain's order."""
    known = labels.select(F.col(id_col).alias("id"), *[F.expr(sql).cast("double").alias(f"y{i}") for i, (_, sql) in enumerate(categories)]).where("id IS NOT NULL")
    known = known.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    n = known.count()
    known = known.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < min(1.0, sample / max(1, n)) * float(1 << 53))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(codes=[word_codes(t).astype("<u4").tobytes() for t in b["text"]])

    ys = ", ".join(f"y{i} double" for i in range(len(categories)))
    got = texts.join(F.broadcast(known), "id").mapInPandas(codes, f"id long, {ys}, codes binary")  # about `sample` rows
    got = got.toPandas().sort_values(["id", "codes"]).drop_duplicates("id")
    rows = [np.frombuffer(x, "<u4") for x in got["codes"]]
    return fit_chain(rows, got[[f"y{i}" for i in range(len(categories))]].to_numpy(float), [c for c, _ in categories])


def predict(docs: DataFrame, chain: Chain, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, a probability p_<category> for each, and toxic, the last one's verdict."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(chain)  # the learned features' weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = model.value.logits([word_codes(t) for t in b["text"]])
            out = pd.DataFrame({"doc_id": b["doc_id"]})
            for i, name in enumerate(model.value.names):
                out[f"p_{name}"] = 1 / (1 + np.exp(-z[:, i]))
            out["toxic"] = z[:, -1] >= model.value.limits[-1] if len(b) else pd.Series([], dtype=bool)
            yield out

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.names) + ", toxic boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(lean(run), schema)
