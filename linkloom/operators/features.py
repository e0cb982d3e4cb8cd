"""The 69 pair features of a candidate, the collective features of a list, and seed statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.similarity import best_match, levenshtein_similarity, similarities
from linkloom.functions import batch, rules, text
from linkloom.operators import ranking, vectors
from linkloom.sources.steps import written


def one_row(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def records(rows: DataFrame, row: str, word_map: dict[str, str] | None = None, noise: Sequence[str] = ()) -> DataFrame:
    """Per record what the features need. rows: clean table with a row id; word_map, noise: learned words."""
    key = text.name_key(F.col("name_core"), word_map, noise)
    return rows.select(
        row, F.col("name_core").alias("core"), F.col("name_clean").alias("clean"), F.col("legal_form").alias("legal"), F.col("addr_clean").alias("addr"),
        key.alias("key"), text.sound_skeleton(F.col("name_core")).alias("sound"), text.initials(key).alias("acronym"),
        text.first_number(F.col("addr_clean")).alias("house"), text.postcode(F.col("addr_clean")).alias("zip"), text.legal_bits(F.col("legal_form")).alias("bits"),
        F.filter(text.words(F.col("name_core")), lambda w: w.isin(list(noise))).alias("noise"),
    )


def fuzzy_legal_bits(rows: DataFrame, name: str, ids: str, cutoff: float = 85.0) -> DataFrame:
    """(ids, fuzzy): legal forms in a name, misspelt ones included. Each distinct word is compared once."""
    import pandas as pd

    post = rows.select(ids, F.explode(F.array_distinct(text.words(F.col(name)))).alias("word"))
    exact = {w: 1 << rules.LEGAL_FORMS.index(f) for w, f in rules.LEGAL_WORDS.items()}

    def run(batches):
        for b in batches:
            long_ = b["word"].where(b["word"].str.len() >= 5)
            near = best_match(long_.dropna(), rules.LONG_LEGAL_WORDS, cutoff).reindex(b.index)
            bits = [exact.get(w, exact.get(n, 0) if isinstance(n, str) else 0) for w, n in zip(b["word"], near)]
            yield pd.DataFrame({"word": b["word"], "bits": pd.array(bits, "int64")})

    known = post.select("word").distinct().mapInPandas(run, "word string, bits long")
    hit = post.join(known, "word").groupBy(ids).agg(F.bit_or("bits").alias("fuzzy"))
    return rows.select(ids).join(hit, ids, "left").select(ids, F.coalesce("fuzzy", F.lit(0)).alias("fuzzy"))


def unseen_share(names: DataFrame, ids: str, name: str, vocabulary: DataFrame) -> DataFrame:
    """(ids, unseen): the share of a name's words that are not in vocabulary (word)."""
    post = names.select(ids, F.explode(text.words(F.col(name))).alias("word"))
    seen = post.join(vocabulary.select("word").distinct().withColumn("_s", F.lit(1)), "word", "left")
    per = seen.groupBy(ids).agg(F.avg(F.when(F.col("_s").isNull(), 1.0).otherwise(0.0)).alias("unseen"))
    return names.select(ids).join(per, ids, "left").select(ids, F.coalesce("unseen", F.lit(0.0)).alias("unseen"))


def text_counts(s1: DataFrame, s23: DataFrame, word_map: dict[str, str] | None = None, noise: Sequence[str] = (), asked: DataFrame | None = None) -> DataFrame:
    """(what, gram, df) over all rows of two clean tables: words of names, keys and addresses, 3-grams of names
    and addresses. asked: (gram) words that are needed."""
    key = batch.key_words(word_map, noise)

    def texts(row: tuple) -> dict:
        name, addr = row[0] or "", row[1] or ""
        words = batch.words(name)
        return {"word-name": words, "word-key": key(words), "word-addr": batch.words(addr), "char-name": name, "char-addr": addr}

    return vectors.text_frequencies(s1.select("name_core", "addr_clean").unionByName(s23.select("name_core", "addr_clean")), texts, asked)


def _overlap(pairs: DataFrame, one: DataFrame, two: DataFrame, column: str, prefix: str, counts: DataFrame, n: DataFrame) -> DataFrame:
    """(s1, s23) of pairs with <prefix>_word_cosine, _char_cosine, _idf_jaccard of a text column; no
    _char_cosine of keys. one, two: the pairs' rows; counts, n: over all rows."""
    both = one.select(F.concat(F.lit("a"), F.col("s1").cast("string")).alias("id"), F.col(column).alias("t")).unionByName(two.select(F.concat(F.lit("b"), F.col("s23").cast("string")).alias("id"), F.col(column).alias("t")))
    out = pairs
    for kind, grams in (("word", text.words(F.col("t"))), ("char", vectors.char_ngrams(F.col("t")))):
        if (prefix, kind) == ("key", "char"):
            continue
        post = vectors.postings(both, F.array_distinct(grams) if kind == "word" else grams, ["id"])
        df = counts.where(F.col("what") == f"{kind}-{prefix}").select("gram", "df")
        weights = written(vectors.tfidf(post, n, ["id"], frequencies=df), f"{prefix}-{kind}")
        side = lambda letter, name: weights.where(F.col("id").startswith(letter)).select(F.substring("id", 2, 30).cast("long").alias(name), "gram", "w")
        dots = vectors.pair_dot(pairs, side("a", "s1"), side("b", "s23")).withColumnRenamed("dot", f"{prefix}_{kind}_cosine")
        out = out.join(written(dots, f"{prefix}-{kind}-cosine"), ["s1", "s23"])
        if kind == "word":
            rare = weights.select("gram", vectors.idf(F.col("df"), F.col("n")).alias("idf")).distinct()
            own = vectors.shared_idf(pairs, side("a", "s1").drop("w"), side("b", "s23").drop("w"), rare).withColumnRenamed("idf_jaccard", f"{prefix}_idf_jaccard")
            own = own.withColumnsRenamed({"shared": f"_{prefix}_shared", "sum_a": f"_{prefix}_a", "sum_b": f"_{prefix}_b"})
            out = out.join(written(own, f"{prefix}-idf"), ["s1", "s23"])
    return out


def pair_features(candidates: DataFrame, s1: DataFrame, s23: DataFrame, word_map: dict[str, str] | None = None, noise: Sequence[str] = ()) -> DataFrame:
    """candidates (from combine_and_trim, with source) and two clean tables to the 69 columns.

    Competition is counted over all candidates; rescue rows keep rank -1. word_map and noise are the
    learned words (learning.word_lists); without them name_noise_added is 0.
    """
    # each is read many times below; as tables they are leaves of short plans. Frequencies and the vocabulary
    # are of all rows; what else a row gives is made for the candidates' rows only
    candidates = written(candidates, "candidates")
    base = candidates.select("s1", "s23")
    named = lambda rows, row: written(records(rows.join(base.select(row).distinct(), row, "left_semi"), row, word_map, noise), row)
    one, two = named(s1, "s1"), named(s23, "s23")
    texts = lambda rows: rows.select(F.explode(F.array_distinct(F.flatten(F.array(*[text.words(F.col(c)) for c in ("core", "key", "addr")])))).alias("gram"))
    asked = written(texts(one).unionByName(texts(two)).distinct(), "asked")
    counts = written(text_counts(s1, s23, word_map, noise, asked), "counts")
    n = written(one_row(s1.select("s1").unionByName(s23.select(F.col("s23").alias("s1")))), "n")
    vocabulary = s1.select(F.explode(text.words(F.col("name_core"))).alias("word"))
    fuzzy1 = written(fuzzy_legal_bits(one, "clean", "s1").withColumnRenamed("fuzzy", "fuzzy1"), "fuzzy1")
    fuzzy2 = written(fuzzy_legal_bits(two, "clean", "s23").withColumnRenamed("fuzzy", "fuzzy2"), "fuzzy2")
    unseen = written(unseen_share(two, "s23", "core", vocabulary).withColumnRenamed("unseen", "s23_unseen_words"), "unseen")
    rows = ranking.competition(candidates.join(two.select("s23", F.col("core").alias("_core")), "s23"), "best_score", "source", "_core").drop("_core")
    for column, prefix in (("core", "name"), ("key", "key"), ("addr", "addr")):
        rows = rows.join(_overlap(base, one, two, column, prefix, counts, n), ["s1", "s23"])
    rows = written(rows, "overlap")
    a = one.select("s1", *[F.col(c).alias(f"{c}1") for c in one.columns if c != "s1"])
    b = two.select("s23", *[F.col(c).alias(f"{c}2") for c in two.columns if c != "s23"])
    rows = rows.join(a, "s1").join(b, "s23").join(fuzzy1, "s1").join(fuzzy2, "s23").join(unseen, "s23")
    # the kernels' time is far beyond what the rows' bytes tell, so pairs are dealt to all tasks by number
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s1", "s23")
    pair = lambda c: (F.col(f"{c}1"), F.col(f"{c}2"))
    rows = rows.withColumns({
        "_n": similarities(*pair("core"), "ratio", "token_set", "token_sort", "partial", "jaro_winkler"), "_c": similarities(*pair("clean"), "ratio"),
        "_s": similarities(*pair("sound"), "ratio", "token_set"), "_k": similarities(*pair("key"), "ratio", "token_set"),
        "_j": similarities(F.replace(F.col("key1"), F.lit(" "), F.lit("")), F.replace(F.col("key2"), F.lit(" "), F.lit("")), "ratio", "partial"),
        "_a": similarities(*pair("addr"), "ratio", "token_set", "token_sort", "partial"),
    })
    flag = lambda c: c.cast("double")
    w1, w2 = text.words(F.col("core1")), text.words(F.col("core2"))
    ends = lambda i: flag(F.try_element_at(w1, F.lit(i)).eqNullSafe(F.try_element_at(w2, F.lit(i))))  # noqa: E731  two empty names agree
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    fuzzy_known = (F.col("fuzzy1") > 0) & (F.col("fuzzy2") > 0)
    no1, no2 = F.col("legal1") == "", F.col("legal2") == ""
    num1, num2 = F.array_distinct(text.number_words(F.col("addr1"))), F.array_distinct(text.number_words(F.col("addr2")))
    shared = F.size(F.array_intersect(num1, num2))
    either = F.size(F.array_union(num1, num2))
    miss1, miss2 = F.col("addr1") == "", F.col("addr2") == ""
    addr = lambda c: F.when(~(miss1 | miss2), c)
    both_given = lambda x, y: F.when((x != "") & (y != ""), flag(x == y))
    cols: dict[str, Column] = {
        "name_ratio": F.col("_n.ratio"), "name_token_set": F.col("_n.token_set"), "name_token_sort": F.col("_n.token_sort"), "name_partial": F.col("_n.partial"),
        "name_jaro_winkler": F.col("_n.jaro_winkler"), "name_levenshtein": levenshtein_similarity(*pair("core")), "name_full_ratio": F.col("_c.ratio"),
        "name_sound_ratio": F.col("_s.ratio"), "name_sound_token_set": F.col("_s.token_set"),
        "name_length_diff": flag(F.abs(F.length("core1") - F.length("core2"))), "name_word_count_diff": flag(F.abs(blanks(F.col("core1")) - blanks(F.col("core2")))),
        "name_first_word_equal": ends(1), "name_last_word_equal": ends(-1), "name_exact_equal": flag(F.col("core1") == F.col("core2")),
        "key_joined_ratio": F.col("_j.ratio"), "key_joined_partial": F.col("_j.partial"),
        "key_acronym": flag((F.col("acronym1") != "") & F.startswith("key2", "acronym1")),
        "key_ratio": F.col("_k.ratio"), "key_token_set": F.col("_k.token_set"), "key_containment": F.try_divide("_key_shared", F.least("_key_a", "_key_b")),
        "key_only_s1_idf": F.col("_key_a") - F.col("_key_shared"), "key_only_s23_idf": F.col("_key_b") - F.col("_key_shared"), "key_equal": flag(F.col("key1") == F.col("key2")),
        "legal_equal": flag(~no1 & ~no2 & (F.col("legal1") == F.col("legal2"))), "legal_conflict": flag(~no1 & ~no2 & (F.col("legal1") != F.col("legal2"))), "legal_any_missing": flag(no1 | no2),
        "legal_s1_only": flag(~no1 & no2), "legal_s23_only": flag(no1 & ~no2), "legal_form_s1": flag(F.col("bits1")), "legal_form_s23": flag(F.col("bits2")),
        "legal_fuzzy_equal": flag(fuzzy_known & (F.col("fuzzy1") == F.col("fuzzy2"))),
        "legal_dropped": F.when(fuzzy_known, flag(text.bits_missing(F.col("fuzzy1"), F.col("fuzzy2")))), "legal_added": F.when(fuzzy_known, flag(text.bits_missing(F.col("fuzzy2"), F.col("fuzzy1")))),
        "name_noise_added": flag(F.size(F.array_except("noise2", "noise1"))),
        "addr_missing_s1": flag(miss1), "addr_missing_s23": flag(miss2), "addr_ratio": addr(F.col("_a.ratio")), "addr_token_set": addr(F.col("_a.token_set")), "addr_token_sort": addr(F.col("_a.token_sort")), "addr_partial": addr(F.col("_a.partial")),
        "addr_word_cosine": addr(F.col("addr_word_cosine")), "addr_char_cosine": addr(F.col("addr_char_cosine")), "addr_idf_jaccard": addr(F.col("addr_idf_jaccard")),
        "num_shared": addr(flag(shared)), "num_jaccard": addr(F.try_divide(flag(shared), flag(either))), "num_conflict": addr(flag((F.size(num1) > 0) & (F.size(num2) > 0) & (shared == 0))),
        "first_number_equal": addr(both_given(*pair("house"))), "postcode_equal": addr(both_given(*pair("zip"))),
    }
    rows = rows.withColumns(cols)
    drop = [c for c in rows.columns if c.startswith("_") or (c[-1] in "12" and c[:-1] in (*one.columns, "fuzzy"))]
    return rows.drop(*drop)


def collective_features(pairs: DataFrame, name_weights: DataFrame, addr_weights: DataFrame, p: str = "p") -> DataFrame:
    """The seven list features of a scored pair; weights: (s23, gram, w) of names and addresses."""
    rows = ranking.leave_one_out(pairs, p)
    for name, weights in (("sib_name_support", name_weights), ("sib_addr_support", addr_weights)):
        rows = vectors.centroid_support(rows, weights, p=p).withColumnRenamed("support", name).drop("others")
    return rows


def word_difference(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """What the copy adds to the record's name and what it lacks."""
    x, y = text.words(F.col(a)), text.words(F.col(b))
    added, lost = F.array_except(y, x), F.array_except(x, y)
    return pairs.withColumns({"n_common": F.size(F.array_intersect(x, y)), "n_added": F.size(added), "n_lost": F.size(lost), "added": F.array_join(F.array_sort(added), " "), "lost": F.array_join(F.array_sort(lost), " ")})


def word_difference_features(pairs: DataFrame, group: str = "s1") -> DataFrame:
    """pairs (group, core1, legal1, name1, core2, legal2) with the 16 wd_ columns; nulls count as empty.

    Side 1 is the record, side 2 the copy. wd_rank_add is the copy's rank among the record's copies by
    added words, equal ones sharing the least rank.
    """
    x, y, name = (text.words(F.col(c)) for c in ("core1", "core2", "name1"))
    added, lost, both = F.array_except(y, x), F.array_except(x, y), F.array_intersect(x, y)
    flag = lambda c: c.cast("double")
    count = lambda a, of=None: flag(F.size(a if of is None else F.filter(a, of)))
    one_for_many = (F.size(y) == 1) & (F.size(x) > 1)
    firsts = lambda w: F.array_join(F.transform(w, lambda v: F.substring(v, 1, 1)), "")
    only = F.array_join(y, "")
    legal1, legal2 = text.text_or_empty(F.col("legal1")), text.text_or_empty(F.col("legal2"))
    cols = {
        "wd_add": count(added), "wd_miss": count(lost), "wd_common": count(both),
        "wd_add_short": count(added, lambda w: F.length(w) <= 3), "wd_add_long": count(added, lambda w: F.length(w) > 3),
        "wd_first_eq": flag(F.coalesce(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), F.lit(False))),
        "wd_order_eq": flag(F.filter(y, lambda w: F.array_contains(x, w)) == F.filter(x, lambda w: F.array_contains(y, w))),
        "wd_acronym": flag(one_for_many & ((only == firsts(x)) | (only == firsts(name)))),
        "wd_concat": flag(one_for_many & ((only == F.array_join(x, "")) | (only == F.array_join(name, "")))),
        "wd_legal_diff": flag((legal1 != "") & (legal2 != "") & (legal1 != legal2)),
        "wd_legal_b_only": flag((legal2 != "") & (legal1 == "")), "wd_legal_x_only": flag((legal1 != "") & (legal2 == "")),
        "wd_jacc": count(both) / F.greatest(count(F.array_union(x, y)), F.lit(1.0)), "wd_b_ntok": count(y), "wd_x_ntok": count(x),
    }
    ranked = ranking.added_word_rank(pairs.withColumns(cols), "wd_add", group, "wd_rank_add")
    return ranked.withColumn("wd_rank_add", flag(F.col("wd_rank_add")))
