"""Competition among candidates: ranks, gaps, leave-one-out statistics, list context, exclusivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import logit

LEVELS = (0.9, 0.7, 0.5, 0.3, 0.1)


def _by(group: str | list[str]):
    return Window.partitionBy(*([group] if isinstance(group, str) else group))


def rank_in(group, order: list[Column]) -> Column:
    """1 for the first; order must be total."""
    return F.row_number().over(_by(group).orderBy(*order))


def competition(pairs: DataFrame, score: str = "score", source: str = "source", name: str | None = None) -> DataFrame:
    """How a pair stands among its record's candidates and its target's suitors. Needs all candidates."""
    s = F.col(score)
    out = pairs.withColumns({
        "n_candidates_for_s1": F.count("*").over(_by("s1")),
        "gap_to_best_for_s1": F.max(s).over(_by("s1")) - s,
        "source_rank": rank_in(["s1", source], [s.desc(), F.col("s23")]),
        "reverse_rank": rank_in("s23", [s.desc(), F.col("s1")]),
        "gap_to_best_for_s23": F.max(s).over(_by("s23")) - s,
        "n_s1_wanting_this": F.count("*").over(_by("s23")),
    })
    return out.withColumn("n_same_name_candidates", F.count("*").over(_by(["s1", name])) - 1) if name else out


def others_max(value: Column, group, tie: list[Column]) -> Column:
    """The largest value among the other rows of a group; NULL if there is none."""
    w = _by(group)
    first = rank_in(group, [value.desc(), *tie]) == 1
    return F.when(first, F.lead(value).over(w.orderBy(value.desc(), *tie))).otherwise(F.max(value).over(w))


def leave_one_out(pairs: DataFrame, p: str = "p", sure: float = 0.5) -> DataFrame:
    """Rank, the others' largest and summed probability, and how many others are sure."""
    v, w = F.col(p), _by("s1")
    return pairs.withColumns({
        "p_rank": rank_in("s1", [v.desc(), F.col("s23")]),
        "p_others_max": others_max(v, "s1", [F.col("s23")]),
        "p_others_sum": F.sum(v).over(w) - v,
        "n_sure_others": F.sum((v > sure).cast("int")).over(w) - (v > sure).cast("int"),
    })


def score_others_max(pairs: DataFrame, value: str, group: str = "s1", name: str = "others_max") -> DataFrame:
    """The best of the others: the best itself for all but a sole best row, which sees the next lower value."""
    rows = pairs.withColumn("_best", F.max(value).over(_by(group))).withColumn("_is", (F.col(value) == F.col("_best")).cast("int"))
    lone = (F.col("_is") == 1) & (F.sum("_is").over(_by(group)) == 1)
    lower = F.max(F.when(F.col("_is") == 0, F.col(value))).over(_by(group))
    return rows.withColumn(name, F.when(lone, lower).otherwise(F.col("_best"))).drop("_best", "_is")


def list_context(pairs: DataFrame, p: str = "p") -> DataFrame:
    """A pair's neighbours in its record's list, by falling probability."""
    v, w = F.col(p), _by("s1").orderBy(F.col(p).desc(), F.col("s23"))
    above = F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cols = {
        "list_rank": F.row_number().over(w), "prev_p": F.lag(v, 1, 1.0).over(w), "next_p": F.lead(v, 1, 0.0).over(w),
        "mass_above": above, "mass_below": F.sum(v).over(_by("s1")) - above - v, "list_size": F.count("*").over(_by("s1")),
    }
    rows = pairs.withColumns(cols)
    rows = rows.withColumns({"gap_prev": logit(F.col("prev_p")) - logit(v), "gap_next": logit(v) - logit(F.col("next_p"))})
    return rows.withColumns({f"n_over_{int(100 * t)}": F.sum((v >= t).cast("int")).over(_by("s1")) for t in LEVELS})


def exclusive(pairs: DataFrame, p: str = "p", owner: str = "s1", target: str = "s23") -> DataFrame:
    """Each target keeps its best owner only; ties go to the smaller owner."""
    n = F.row_number().over(Window.partitionBy(target).orderBy(F.col(p).desc(), owner))
    return pairs.withColumn("_n", n).where("_n = 1").drop("_n")


def added_word_rank(rows: DataFrame, value: str, group: str = "s1", name: str = "rank") -> DataFrame:
    """Rank with gaps: equal values share the least rank."""
    return rows.withColumn(name, F.rank().over(_by(group).orderBy(value)))


def binned(n: Column) -> Column:
    """0, 1, 2-3, 4+."""
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def kth_smallest(rows: DataFrame, value: str, k: int, limit: float) -> DataFrame:
    """The value at index k of the ascending order, or limit if there are fewer rows (a budget's limit)."""
    at = rows.select(F.col(value).alias("v")).orderBy("v").limit(k + 1).agg(F.count("*").alias("n"), F.max("v").alias("m"))
    return at.select(F.when(F.col("n") > k, F.col("m")).otherwise(F.lit(limit)).alias("limit"))
