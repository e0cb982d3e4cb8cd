"""Rivals: records of the canonical list with the same name or address key as a candidate.

Keys shared by more than a guard of records give no features; the guard also bounds the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH, MAX_RIVALS = 0.005, 0.995, 300


def rival_scores(pairs: DataFrame, s1: DataFrame, key: str, text: str, pair_text: str, score: Callable[[Column, Column], Column], guard: int = MAX_RIVALS) -> DataFrame:
    """pairs: (s1, s23, <key> of the copy, <pair_text> of the copy); s1: (s1, key, text) of all records.

    Adds n_rivals, own, gap_best (own - best), n_better, n_tie (others equal to own), gap_second
    (own - best of the others). NULL if the group is empty or above the guard.
    """
    sizes = s1.groupBy(key).agg(F.count("*").alias("n_rivals"))
    small = s1.join(sizes.where(F.col("n_rivals") <= guard), key)
    copies = pairs.select(key, pair_text).distinct()
    # each distinct copy meets each rival once; its scores, at most `guard`, go back to the pairs as one sorted row
    met = copies.join(small.select(key, F.col(text).alias("_text"), "n_rivals"), key).withColumn("_score", score(F.col(pair_text), F.col("_text")))
    scores = met.groupBy(key, pair_text).agg(F.max("n_rivals").alias("n_rivals"), F.sort_array(F.collect_list("_score"), asc=False).alias("_all"))
    out = pairs.join(s1.select("s1", F.col(text).alias("_own_text"), F.col(key).alias("_own_key")), "s1").join(scores, [key, pair_text], "left")
    out = out.withColumn("own", score(F.col(pair_text), F.col("_own_text")))
    some, among = F.col("n_rivals").isNotNull(), F.col(key) == F.col("_own_key")  # among: the pair's own record is one of the rivals
    best = F.get("_all", F.lit(0))
    second = F.when(among & (F.col("own") == best), F.get("_all", F.lit(1))).otherwise(best)
    count = lambda test: F.size(F.filter("_all", test))
    return out.select(
        *pairs.columns, F.when(some, F.col("own")).alias("own"), among.cast("int").alias("key_eq"), F.col("n_rivals"),
        F.when(some, F.col("own") - best).alias("gap_best"), F.when(some, count(lambda x: x > F.col("own"))).alias("n_better"),
        F.when(some, count(lambda x: x == F.col("own")) - F.coalesce(among, F.lit(False)).cast("int")).alias("n_tie"), F.when(some, F.col("own") - second).alias("gap_second"),
    )


def in_window(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Only unsure pairs pay for rival features."""
    return pairs.where((F.col(p) > LOW) & (F.col(p) < HIGH))


def rival_features(pairs: DataFrame, s1: DataFrame, s23: DataFrame, p: str = "p", guard: int = MAX_RIVALS) -> DataFrame:
    """The 17 rv_ columns; NULL outside the window. s1, s23: ids with business_name, business_address."""
    from linkloom.functions.similarity import similarities
    from linkloom.functions.text import digit_key, plain, rival_key, words

    def keyed(rows: DataFrame, row: str) -> DataFrame:
        name, addr = plain(F.col("business_name")), plain(F.col("business_address"))
        return rows.select(row, name.alias("name"), addr.alias("addr")).withColumn("nkey", rival_key(F.col("name"))).withColumn("akey", digit_key(F.col("addr")))

    ratio = lambda a, b: similarities(a, b, "ratio")["ratio"]
    token_set = lambda a, b: similarities(a, b, "token_set")["token_set"]
    one, two = keyed(s1, "s1"), keyed(s23, "s23")
    live = in_window(pairs, p).select("s1", "s23").distinct().join(two, "s23")
    # how many canonical records have the record's key, the copy's key, the copy's address key
    names_, addrs_ = one.groupBy("nkey").agg(F.count("*").alias("n")), one.groupBy("akey").agg(F.count("*").alias("n"))
    n1 = one.select("s1", "nkey").join(names_, "nkey").select("s1", F.col("n").alias("rv_n1"), F.col("nkey").alias("_key1"))
    by_name = rival_scores(live, one, "nkey", "name", "name", ratio, guard)
    by_addr = rival_scores(live.where("akey <> ''"), one, "akey", "addr", "addr", token_set, guard)
    own = live.join(one.select("s1", F.col("name").alias("name1"), F.col("addr").alias("addr1")), "s1")
    own = own.join(n1, "s1")
    w = words(F.col("name"))
    own = own.select(
        "s1", "s23", F.when(F.col("addr") == "", 1).otherwise(0).alias("rv_empty"), (F.col("nkey") == F.col("_key1")).cast("int").alias("rv_key_eq"), "rv_n1",
        ratio(F.col("name"), F.col("name1")).alias("rv_sim"), token_set(F.col("_key1"), F.col("nkey")).alias("rv_tset"), token_set(F.col("addr"), F.col("addr1")).alias("rv_asim"),
        F.size(w).alias("rv_n_words"), F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).alias("rv_max_word"), "nkey", "akey",
    )
    own = own.join(names_.withColumnRenamed("n", "rv_n2"), "nkey", "left").join(addrs_.withColumnRenamed("n", "_ad_n2"), "akey", "left").na.fill(0, ["rv_n2", "_ad_n2"])
    own = own.withColumn("rv_ad_n2", F.when(F.col("akey") == "", -1).otherwise(F.col("_ad_n2"))).drop("nkey", "akey", "_ad_n2")
    names = by_name.select("s1", "s23", F.col("gap_best").alias("rv_gap_best"), F.col("n_better").alias("rv_n_better"), F.col("n_tie").alias("rv_n_tie"), F.col("gap_second").alias("rv_gap_second"))
    addrs = by_addr.select("s1", "s23", F.col("gap_best").alias("rv_ad_gap_best"), F.col("n_better").alias("rv_ad_better"), F.col("gap_second").alias("rv_ad_gap_second"))
    return pairs.join(own.join(names, ["s1", "s23"], "left").join(addrs, ["s1", "s23"], "left"), ["s1", "s23"], "left")


def sibling_expansion(kept: DataFrame, s23_keys: DataFrame, owned: DataFrame, group: int = 30) -> DataFrame:
    """(s1, s23) proposals: records with the key of a kept partner, if the key's group is small and
    nobody owns them. kept: (s1, s23); s23_keys: (s23, key)."""
    small = s23_keys.where("key <> ''").groupBy("key").agg(F.count("*").alias("gsize")).where(F.col("gsize") <= group)
    seeds = kept.join(s23_keys, "s23").join(small, "key").select("s1", "key", "gsize").groupBy("s1", "key", "gsize").agg(F.count("*").alias("n_seeds"))
    new = seeds.join(s23_keys, "key").join(kept.select("s1", "s23"), ["s1", "s23"], "left_anti").join(owned.select("s23"), "s23", "left_anti")
    return new.groupBy("s1", "s23").agg(F.sum("n_seeds").alias("n_seeds"), F.max("gsize").alias("gsize"))
