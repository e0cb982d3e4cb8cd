"""Language identification by nearest centroid.

A text becomes a vector of byte n-grams (1 to 3 bytes of its lower-cased letters, words apart),
weighted by log tf and idf and normalised. Each language has several centroids, found by
spherical k-means over its sample. The nearest centroid by cosine names the language; a text
that is too far from every centroid is rejected.

The classifier is fitted on a sample of at most about SAMPLE labelled rows per language, taken by
a hash of the id; everything else runs over all rows and whole texts.

Rows: null text, or text without a letter, is `und` with score 0 and rejected; rows with null
lang or null id aren't learned from; without any labelled row every prediction is `und`. Rows
that repeat are judged alike; an empty table gives an empty result. Ties between languages go to
the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import lean

#: Labelled rows per language that the classifier is fitted on, centroids per language.
SAMPLE = 400
CENTROIDS = 3
DIMS = 1 << 13
#: Bytes of a text that are counted at a time.
STEP = 1 << 20
#: A text is rejected if its best cosine is under this share of the centroid's 1st percentile in the sample.
REJECT_SHARE = 0.3

#: ASCII bytes that aren't letters become blanks; other bytes belong to letters or marks.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, 1 + ln tf) of the text's n-grams; empty if it has no letter. Bytes are counted
    STEP at a time, so a long text needs little more than itself."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    tf, last = np.zeros(DIMS, np.int64), np.empty(0, np.uint32)  # last: up to two bytes before a step
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP]
        keep = part != 32
        keep[1:] |= part[:-1] != 32
        keep[0] |= at == 0 or raw[at - 1] != 32
        x = np.concatenate([last, part[keep].astype(np.uint32)])
        n = len(last)
        one, two, three = x[n:], x[max(n - 1, 0) :], x[max(n - 2, 0) :]
        two = two[:-1] | two[1:] << 8
        three = three[:-2] | three[1:-1] << 8 | three[2:] << 16
        for size, codes in ((1, one), (2, two), (3, three)):
            tf += np.bincount(((codes | size << 24) * np.uint32(2654435761) >> np.uint32(32 - 13)).astype(np.int64), minlength=DIMS)
        last = x[-2:]
    if not any(c.isalpha() for c in text):
        return np.empty(0, np.int64), np.empty(0)
    at = np.flatnonzero(tf)
    return at, 1.0 + np.log(tf[at])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest rows, so it is deterministic."""
    mean = x.mean(0)
    centres = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centres) < min(k, len(x)):
        far = x[np.argmin(np.max(x @ np.array(centres).T, axis=1))]
        centres.append(far)
    c = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


class CentroidModel:
    """idf weights, unit centroids (DIMS x n), each one's language and least cosine."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centres, self.langs, self.least = idf, centres, langs, least

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if text is None or not self.langs:
            return "und", 0.0, True
        at, tf = grams(text)
        if not len(at):
            return "und", 0.0, True
        v = tf * self.idf[at]
        cos = v @ self.centres[at] / max(np.sqrt(v @ v), 1e-12)
        best = int(np.argmax(cos))
        return self.langs[best], float(min(1.0, max(0.0, cos[best]))), bool(cos[best] < self.least[best])


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> CentroidModel:
    """labelled: the rows to learn from. Rows with null label, id or text are left out."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return CentroidModel(np.zeros(DIMS), np.zeros((DIMS, 0)), [], np.zeros(0))
    share = F.create_map(*[F.lit(x) for s, n in counts.items() for x in (s, min(1.0, sample / n))])
    picked = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < share[F.col("lang")] * float(1 << 53))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, lang, *grams(t)) for i, lang, t in zip(b["id"].astype(str), b["lang"], b["text"])]
            out = [(i, lang, at.astype("<u2").tobytes(), tf.astype("<f4").tobytes()) for i, lang, at, tf in out if len(at)]
            yield pd.DataFrame(out, columns=["id", "lang", "at", "tf"])

    got = picked.select("id", "lang", "text").mapInPandas(vectors, "id string, lang string, at binary, tf binary").toPandas().sort_values(["lang", "id", "at"])
    ats = [np.frombuffer(x, "<u2").astype(np.int64) for x in got["at"]]
    tfs = [np.frombuffer(x, "<f4").astype(np.float64) for x in got["tf"]]
    df = np.bincount(np.concatenate([*ats, np.empty(0, np.int64)]).astype(np.int64), minlength=DIMS)
    idf = np.log((1 + len(ats)) / (1 + df)) + 1
    centres, langs, least = [], [], []
    labels = got["lang"].to_numpy()
    for lang in sorted(set(labels)):
        own = np.flatnonzero(labels == lang)
        x = np.zeros((len(own), DIMS), np.float32)
        for r, i in enumerate(own):
            x[r, ats[i]] = tfs[i] * idf[ats[i]]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _kmeans(x, centroids)
        low = np.quantile((x @ c.T).max(1), 0.01)
        centres += [*c]
        langs += [lang] * len(c)
        least += [REJECT_SHARE * low] * len(c)
    return CentroidModel(idf, np.array(centres, np.float64).T.copy(), langs, np.array(least))


def identify(docs: DataFrame, model: CentroidModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = pd.DataFrame([model.judge(t) for t in b["text"]], columns=["lang_pred", "score", "rejected"])
            yield pd.concat([b[["doc_id", "held_out"]].reset_index(drop=True), said], axis=1)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: CentroidModel, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    rejected = F.pandas_udf(lambda s: pd.Series([model.judge(t)[2] for t in s], dtype=bool), "boolean")
    return docs.where(~rejected(F.col(text_col)))
