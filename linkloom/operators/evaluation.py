"""Macro F0.5 over all records, blocking and score reports, error examples, AUC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 15, 20, 30, 50)


def f05(n_pred: Column, n_true: Column, n_hit: Column) -> Column:
    """F0.5 of one record; nothing predicted for nothing true is 1, no hit otherwise 0."""
    precision, recall = F.try_divide(n_hit, n_pred), F.try_divide(n_hit, n_true)
    f = F.try_divide(1.25 * precision * recall, 0.25 * precision + recall)
    return F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).otherwise(F.coalesce(f, F.lit(0.0)))


def per_record(answered: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """s1 with n_pred, n_true, n_hit and f: one full join and one aggregate for all three counts."""
    a = answered.select("s1", "s23").distinct().withColumn("_a", F.lit(1))
    t = truth.select("s1", "s23").distinct().withColumn("_t", F.lit(1))
    both = a.join(t, ["s1", "s23"], "outer").groupBy("s1").agg(F.sum(F.coalesce("_a", F.lit(0))).alias("n_pred"), F.sum(F.coalesce("_t", F.lit(0))).alias("n_true"), F.sum(F.when(F.col("_a").isNotNull() & F.col("_t").isNotNull(), 1).otherwise(0)).alias("n_hit"))
    rows = s1.join(both, "s1", "left").na.fill(0, ["n_pred", "n_true", "n_hit"])
    return rows.withColumn("f", f05(F.col("n_pred"), F.col("n_true"), F.col("n_hit")))


def macro_f05(answered: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    return per_record(answered, truth, s1).agg(F.avg("f").alias("macro_f05"), F.sum("n_pred").alias("n_pred"), F.sum("n_hit").alias("n_hit"), F.count("*").alias("n_records"))


def score_breakdown(answered: DataFrame, truth: DataFrame, s1: DataFrame, by: str = "country") -> DataFrame:
    """Mean and size by a column, by number of true matches, and over all, in one aggregate."""
    from linkloom.operators.ranking import binned

    rows = per_record(answered, truth, s1).withColumn("matches", binned(F.col("n_true")))
    sets = rows.groupingSets([[by], ["matches"], []], by, "matches").agg(F.avg("f").alias("f05"), F.count("*").alias("n"))
    return sets.select(F.coalesce(by, F.lit("all")).alias(by), F.coalesce("matches", F.lit("all")).alias("matches"), "f05", "n")


def blocking_report(candidates: DataFrame, truth: DataFrame, s1: DataFrame, n_s23: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row: candidates per record, reduction, pair recall, records found whole, ceiling, recall at k.
    candidates: (s1, s23, candidate_rank); n_s23: one row with n."""
    hit = truth.select("s1", "s23").distinct().join(candidates.select("s1", "s23", "candidate_rank"), ["s1", "s23"], "left")
    found = hit.agg(F.count("*").alias("n_truth"), F.count("candidate_rank").alias("n_found"), *[F.sum(F.when(F.col("candidate_rank") < k, 1).otherwise(0)).alias(f"found_at_{k}") for k in ks])
    per = hit.groupBy("s1").agg(F.count("*").alias("n_true"), F.count("candidate_rank").alias("n_hit"))
    per = s1.select("s1").join(per, "s1", "left").na.fill(0)
    whole = per.agg(F.count("*").alias("n_s1"), F.avg((F.col("n_hit") == F.col("n_true")).cast("double")).alias("all_found"), F.avg(f05(F.col("n_hit"), F.col("n_true"), F.col("n_hit"))).alias("ceiling"))
    rows = candidates.agg(F.count("*").alias("n_candidates")).crossJoin(found).crossJoin(whole).crossJoin(n_s23)  # one row each
    recalls = [F.try_divide(f"found_at_{k}", "n_truth").alias(f"recall_at_{k}") for k in ks]
    return rows.select("n_candidates", F.try_divide("n_candidates", "n_s1").alias("per_record"), (1 - F.try_divide("n_candidates", F.col("n_s1").cast("double") * F.col("n"))).alias("reduction"), F.try_divide("n_found", "n_truth").alias("pair_recall"), "all_found", "ceiling", *recalls)


def found_by_method(candidates: DataFrame, truth: DataFrame, methods: Sequence[str]) -> DataFrame:
    """(method, found, only): true pairs that a method found, and that it alone found."""
    hit = truth.select("s1", "s23").distinct().join(candidates, ["s1", "s23"])
    rows = [F.struct(F.lit(m).alias("method"), F.sum(F.col(f"score_{m}").isNotNull().cast("int")).alias("found"), F.sum((F.col(f"score_{m}").isNotNull() & (F.col("n_methods") == 1)).cast("int")).alias("only")) for m in methods]
    return hit.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def errors(scored: DataFrame, truth: DataFrame, answered: DataFrame, p: str = "p") -> DataFrame:
    """Wrong pairs with their kind: false positive, false negative, or not among the candidates."""
    s = scored.select("s1", "s23", p)
    t = truth.select("s1", "s23").distinct().withColumn("_t", F.lit(1))
    a = answered.select("s1", "s23").distinct().withColumn("_a", F.lit(1))
    rows = s.join(t, ["s1", "s23"], "outer").join(a, ["s1", "s23"], "left")
    kind = F.when(F.col("_t").isNull() & F.col("_a").isNotNull(), "false_positive").when(F.col("_t").isNotNull() & F.col(p).isNull(), "not_in_candidates").when(F.col("_t").isNotNull() & F.col("_a").isNull(), "false_negative")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("s1", "s23", p, "kind")


def error_examples(scored: DataFrame, truth: DataFrame, answered: DataFrame, n: int = 20, p: str = "p") -> DataFrame:
    """The n worst of each kind: the surest false positives, the least sure misses."""
    rows = errors(scored, truth, answered, p)
    worst = F.when(F.col("kind") == "false_positive", -F.col(p)).otherwise(F.coalesce(p, F.lit(0.0)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(worst, "s1", "s23"))).where(F.col("_n") <= n).drop("_n")


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Rank formula with average ranks for ties, from counts per distinct score (no global sort of rows)."""
    from linkloom.operators.blocking import running_before

    per = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = running_before(per, "n", "s", "_below").withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2)
    got = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return got.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p").cast("double") * (F.col("n") - F.col("p"))).alias("auc"))


def holdout(scored: DataFrame, candidates: DataFrame, truth: DataFrame, s1: DataFrame, p: str = "p") -> DataFrame:
    """The holdout's report as (measure, value): AUC, recall of the search, macro F0.5 of the keep rule and of
    the best threshold, by country and by number of true matches."""
    from linkloom.operators import decisions

    labelled = scored.join(truth.select("s1", "s23").distinct().withColumn("_t", F.lit(1)), ["s1", "s23"], "left").na.fill(0, ["_t"])
    named = lambda rows, name, value: rows.select(name.cast("string").alias("measure"), value.cast("double").alias("value"))
    kept = decisions.keep_rule(scored, p=p)
    parts = [
        named(auc(labelled, "_t", p), F.lit("auc"), F.col("auc")),
        named(truth.select("s1", "s23").distinct().join(candidates.select("s1", "s23").withColumn("_c", F.lit(1)), ["s1", "s23"], "left").agg(F.avg(F.coalesce("_c", F.lit(0))).alias("r")), F.lit("pair_recall"), F.col("r")),
        named(score_breakdown(kept, truth, s1), F.concat_ws(" ", F.lit("f05"), "country", "matches"), F.col("f05")),
        named(decisions.threshold_grid(scored, truth, s1.select("s1"), p=p), F.concat(F.lit("f05 at "), F.col("t").cast("string")), F.col("macro_f05")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def quantiles(rows: DataFrame, value: str, shares: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(s) for s in shares]))
    return rows.agg(q.alias("q")).select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("q").alias("value"))).alias("x")).select("x.share", "x.value")


def score_correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair's correlation, and each column's mean and deviation, in one aggregate."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"), F.avg(a).alias("mean_a"), F.stddev_samp(a).alias("std_a")) for a in columns for b in columns]
    return rows.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
