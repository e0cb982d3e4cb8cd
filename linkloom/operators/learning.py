"""Word lists learned from matched names, deterministic samples, and the two-stage model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from linkloom.functions.similarity import similarities
from linkloom.functions.text import sound_skeleton, words


def word_counts(pairs: DataFrame, a: str = "name1", b: str = "name2") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(missing, extra, n) replacements of a lone missing word by a lone extra one; how often a word is
    extra; how often it occurs in copies."""
    x, y = F.array_distinct(words(F.col(a))), F.array_distinct(words(F.col(b)))
    rows = pairs.select(y.alias("copy"), F.array_except(x, y).alias("missing"), F.array_except(y, x).alias("extra"))
    swaps = rows.select(F.explode("extra").alias("extra"), "missing").select("extra", F.explode("missing").alias("missing")).groupBy("extra", "missing").agg(F.count("*").alias("n"))
    extra = rows.select(F.explode("extra").alias("word")).groupBy("word").agg(F.count("*").alias("n_extra"))
    seen = rows.select(F.explode("copy").alias("word")).groupBy("word").agg(F.count("*").alias("n_copy"))
    return swaps, extra, seen


def learn_words(pairs: DataFrame, *, least: int = 20, share: float = 0.5, sound: float = 60.0, noise: float = 0.6) -> DataFrame:
    """(word, kind, target): spellings to map (the word replaces one other that sounds alike most of
    the time) and noise words (extra most of the time)."""
    swaps, extra, seen = word_counts(pairs)
    best = swaps.withColumn("_n", F.row_number().over(Window.partitionBy("extra").orderBy(F.col("n").desc(), "missing"))).where("_n = 1")
    best = best.join(extra, F.col("extra") == F.col("word")).where((F.col("n") >= least) & (F.col("n") >= share * F.col("n_extra")))
    alike = similarities(sound_skeleton(F.col("extra")), sound_skeleton(F.col("missing")), "ratio")["ratio"]
    spell = best.withColumn("_s", alike).where(F.col("_s") >= sound).select(F.col("extra").alias("word"), F.lit("map").alias("kind"), F.col("missing").alias("target"))
    noisy = extra.join(seen, "word").where((F.col("n_extra") >= least) & (F.col("n_extra") >= noise * F.col("n_copy")))
    noisy = noisy.join(spell.select("word"), "word", "left_anti").select("word", F.lit("noise").alias("kind"), F.lit("").alias("target"))
    return spell.unionByName(noisy)


def word_lists(learned: DataFrame, most_noise: int = 63) -> tuple[dict[str, str], list[str]]:
    """(word map, noise words) for name_key and the pair features, from learn_words: as many rows as the
    names have frequent words reach the driver; of the noise words the first most_noise in order."""
    rows = learned.collect()
    return {r.word: r.target for r in rows if r.kind == "map"}, sorted(r.word for r in rows if r.kind == "noise")[:most_noise]


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of the key's hash: a sampling operator that reruns alike."""
    return rows.orderBy(F.crc32(F.col(key).cast("string").cast("binary")), key).limit(n)


def named_pairs(pairs: DataFrame, s1: DataFrame, s23: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs with columns of both sides, <column>_1 and <column>_23."""
    one = s1.select("s1", *[F.col(c).alias(f"{c}_1") for c in columns])
    two = s23.select("s23", *[F.col(c).alias(f"{c}_23") for c in columns])
    return pairs.select("s1", "s23").join(one, "s1").join(two, "s23")


def hard_pairs(candidates: DataFrame, truth: DataFrame, n: int, most_rank: int = 6) -> DataFrame:
    """(s1, s23, label): training pairs for a text scorer from n records, the true candidates and the first wrong ones."""
    own = hash_sample(candidates.select("s1").distinct(), "s1", n)
    rows = candidates.join(own, "s1", "left_semi").join(truth.select("s1", "s23").distinct().withColumn("label", F.lit(1)), ["s1", "s23"], "left").na.fill(0, ["label"])
    return rows.where((F.col("label") == 1) | F.col("candidate_rank").between(0, most_rank - 1)).select("s1", "s23", "label")


def by_length(rows: DataFrame, text: str, parts: int | None = None) -> DataFrame:
    """Rows in order of a text's length within their partition, so that a scorer's batches need little padding."""
    rows = rows.repartition(parts) if parts else rows
    return rows.sortWithinPartitions(F.length(text).desc())


def used(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The rows that a pair mentions."""
    return rows.join(pairs.select(key).distinct(), key, "left_semi")


def rescore(pairs: DataFrame, label: str = "label", p: str = "p", **kw) -> DataFrame:
    """Scores anew from a pair's neighbours in its record's list, each half of the records by the other's model. pairs has fold."""
    from linkloom.operators.ranking import list_context

    rows = list_context(pairs, p).withColumnRenamed(p, "before")
    names = ["before", "list_rank", "prev_p", "next_p", "mass_above", "mass_below", "list_size", "gap_prev", "gap_next"]
    return cross_fit(rows, names, label, **kw).select("s1", "s23", label, "before", "p")


def dense_sample(s1: DataFrame, s23: DataFrame, truth: DataFrame, pattern: str, address: str = "business_address") -> tuple[DataFrame, DataFrame]:
    """All records of some cities: an address pattern on both sides, and the partners of what it takes."""
    own = s1.where(F.lower(address).rlike(pattern))
    partners = truth.join(own, "s1", "left_semi").select("s23")
    near = s23.where(F.lower(address).rlike(pattern)).select("s23").unionByName(partners).distinct()
    return own, s23.join(near, "s23", "left_semi")


def world_sample(s1: DataFrame, s23: DataFrame, truth: DataFrame, n: int, per: float = 4.7) -> tuple[DataFrame, DataFrame]:
    """n records, all their partners, and random others up to `per` noisy records a record."""
    own = hash_sample(s1, "s1", n)
    partners = s23.join(truth.join(own, "s1", "left_semi").select("s23").distinct(), "s23", "left_semi")
    others = hash_sample(s23.join(partners.select("s23"), "s23", "left_anti"), "s23", int(n * per))
    return own, partners.unionByName(others)


def with_known(rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """NULL as -1 with a flag beside it, for learners that take no NULL."""
    cols = {}
    for f in features:
        cols[f"_{f}"] = F.coalesce(F.col(f).cast("double"), F.lit(-1.0))
        cols[f"_{f}_null"] = F.col(f).isNull().cast("double")
    return rows.withColumns(cols), list(cols)


def fit_gbdt(rows: DataFrame, features: Sequence[str], label: str = "label", *, validation: str | None = None, rounds: int = 40, depth: int = 5, seed: int = 42):
    """A boosted-tree classifier; validation names a boolean column for early stopping."""
    ready, names = with_known(rows, features)
    model = GBTClassifier(labelCol=label, featuresCol="_features", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), model]).fit(ready)


def fit_blend(rows: DataFrame, features: Sequence[str], label: str = "label"):
    """Logistic blend of scores."""
    ready, names = with_known(rows, features)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), LogisticRegression(labelCol=label, featuresCol="_features")]).fit(ready)


def score(model, rows: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    ready, _ = with_known(rows, features)
    out = model.transform(ready).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_features", "rawPrediction", "probability", "prediction", *[c for c in ready.columns if c not in rows.columns])


def cross_fit(rows: DataFrame, features: Sequence[str], label: str = "label", fold: str = "fold", **kw) -> DataFrame:
    """Two-fold cross predictions by record: each half is scored by the other half's model."""
    halves = [rows.where(F.col(fold) == i) for i in (0, 1)]
    models = [fit_gbdt(h, features, label, **kw) for h in halves]
    return score(models[1], halves[0], features).unionByName(score(models[0], halves[1], features))


def importances(model, features: Sequence[str]) -> list[tuple[str, float]]:
    names = [n for f in features for n in (f, f"{f} is null")]
    return sorted(zip(names, model.stages[-1].featureImportances.toArray()), key=lambda x: -x[1])


def transfer_check(rows: DataFrame, features: Sequence[str], group: str, groups: Sequence[str], label: str = "label", **kw) -> DataFrame:
    """Every group scored by a model that has not seen it."""
    out = None
    for g in groups:
        got = score(fit_gbdt(rows.where(F.col(group) != g), features, label, **kw), rows.where(F.col(group) == g), features)
        out = got if out is None else out.unionByName(got)
    return out
