"""The operators over whole driver tables, one query each.

Worlds: hits = lineitem (order = record, part = copy), truth = its rows with line status F, records =
orders; names = part and supplier names; texts = documents against benchmark passages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import batch, similarity, text
from linkloom.functions.translit import fold_latin, latin_udf
from linkloom.operators import blocking, decisions, evaluation, features, learning, ranking, rivals, vectors
from linkloom.sources import steps, tsv

METHODS = ["A", "N", "R"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- worlds


def _hits(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("s23"), F.col("l_returnflag").alias("method"), (F.col("l_quantity") / 51).alias("score"), F.col("l_linenumber").alias("rank"))


def _pairs(spark, d) -> DataFrame:
    """(s1, s23, p, source): one row per pair."""
    rows = _hits(spark, d).groupBy("s1", "s23").agg(F.max("score").alias("p"))
    return rows.withColumn("source", (F.col("s23") % 2 + 2).cast("int"))


def _truth(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("s23")).distinct()


def _records(spark, d) -> DataFrame:
    orders, cust, nation = (load(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.select(F.col("o_orderkey").alias("s1"), "o_custkey").join(cust.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("s1", F.col("n_name").alias("country"))  # 25 nations


def _docs(spark, d) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "text", "lang", (F.col("doc_id") % 2 + 2).cast("int").alias("source"))


def _clean(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.basic_clean(F.col("text"), native=True).alias("t"))


def _passages(spark, d) -> DataFrame:
    return load(spark, d, "benchmark").select(F.col("item_id").alias("s1"), text.basic_clean(F.col("text"), native=True).alias("t"))


# ---- text


def clean_tokens(spark, d):
    return _clean(spark, d)


def name_parts(spark, d):
    return _clean(spark, d).withColumn("parts", text.name_struct(F.col("t"))).select("doc_id", "parts.*")


def clean_address(spark, d):
    return _clean(spark, d).select("doc_id", text.clean_address(F.col("t")).alias("addr"))


def number_fields(spark, d):
    t = F.col("t")
    return _clean(spark, d).select("doc_id", text.first_number(t).alias("first_number"), text.postcode(t).alias("postcode"), text.digit_key(t).alias("digit_key"))


def page_numbers(spark, d):
    t = text.basic_clean(F.col("url"), native=True)
    return load(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", "t", text.first_number(F.col("t")).alias("first_number"), text.postcode(F.col("t")).alias("postcode"), text.digit_key(F.col("t")).alias("digit_key"))


def sound_skeleton(spark, d):
    return _clean(spark, d).select("doc_id", text.sound_skeleton(F.col("t")).alias("sound"))


def fix_typos(spark, d):
    parts = load(spark, d, "customer").select("c_custkey", F.lower(F.translate("c_name", "#", " ")).alias("t"))
    return parts.select("c_custkey", text.fix_typos(F.col("t")).alias("fixed"), text.fix_typos(F.concat(F.lit("l"), "t", F.lit("lnd5ia 3rd 24x7 te0hno1"))).alias("mixed"))


def acronym(spark, d):
    return load(spark, d, "part").select("p_partkey", text.initials(F.lower("p_name")).alias("initials"), text.name_key(F.lower("p_name")).alias("key"))


def word_shape(spark, d):
    w = text.words(F.col("t"))
    return _clean(spark, d).select("doc_id", F.size(w).alias("n_words"), F.length("t").alias("n_chars"), F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first_word"), F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("")).alias("last_word"))


def legal_bit_sets(spark, d):
    _, _, legal = text.name_parts(F.col("t"))
    bits = _clean(spark, d).select("doc_id", text.legal_bits(legal).alias("bits"))
    return bits.select("doc_id", "bits", F.bit_count("bits").alias("n_bits"), text.bits_missing(F.col("bits"), F.lit(1 << 3).cast("long")).alias("n_other"))


def rival_keys(spark, d):
    rows = _docs(spark, d).select("doc_id", text.plain(F.col("text")).alias("plain"))
    return rows.withColumn("key", text.rival_key(F.col("plain")))


def ascii_fold(spark, d):
    return _docs(spark, d).select("doc_id", fold_latin(F.col("text")).alias("folded"))


def script_udf(spark, d):
    """The general transliteration, which on Latin texts equals the native fold after NFKC."""
    return _docs(spark, d).select("doc_id", latin_udf(F.col("text")).alias("folded"), text.is_indic(F.col("text")).alias("indic"))


def pair_texts(spark, d):
    return load(spark, d, "part").select("p_partkey", text.pair_text(F.col("p_name"), F.col("p_type")).alias("pair_text"))


def unseen_words(spark, d):
    vocabulary = _passages(spark, d).select(F.explode(text.words(F.col("t"))).alias("word"))
    got = features.unseen_share(_clean(spark, d), "doc_id", "t", vocabulary)
    return got.select("doc_id", F.round("unseen", 6).alias("unseen"))


def logits(spark, d):
    r = _pairs(spark, d)
    return r.select("s1", "s23", F.round(text.logit(F.col("p")), 6).alias("logit"), F.round(text.temper(F.col("p"), 1.5), 6).alias("tempered"), F.round(F.try_divide("p", F.col("source") - 2), 6).alias("ratio"))


def distinct_clean(spark, d):
    """A costly function once per distinct value, spread back by a join."""
    parts = load(spark, d, "part").select("p_partkey", "p_name")
    cleaned = parts.select("p_name").distinct().withColumn("clean", text.basic_clean(F.col("p_name"), native=True))
    return parts.join(cleaned, "p_name").select("p_partkey", "clean")


# ---- vectors and search


def _doc_post(spark, d):
    return vectors.postings(_clean(spark, d), vectors.char_ngrams(F.col("t")), ["doc_id"])


def char_ngrams(spark, d):
    return vectors.document_frequency(_doc_post(spark, d))


def _weights(spark, d):
    """TF-IDF over passages and documents together: (side, id, gram, tf, df, n, w)."""
    both = _clean(spark, d).select(F.lit("d").alias("side"), F.col("doc_id").alias("id"), "t").unionByName(_passages(spark, d).select(F.lit("q").alias("side"), F.col("s1").alias("id"), "t"))
    post = vectors.postings(both, vectors.char_ngrams(F.col("t")), ["side", "id"])
    return vectors.tfidf(post, features.one_row(both), ["side", "id"], bounded=True)


def tfidf_weights(spark, d):
    w = _weights(spark, d)
    return w.groupBy("side", "id").agg(F.count("*").alias("n_grams"), F.round(F.sum("w"), 6).alias("sum_w"), F.round(F.max("w"), 6).alias("max_w"), F.sum("tf").alias("sum_tf"))


def word_idf_sums(spark, d):
    docs = _clean(spark, d)
    post = vectors.postings(docs, F.array_distinct(text.words(F.col("t"))), ["doc_id"])
    idfs = vectors.word_idf(post, features.one_row(docs))
    return post.join(idfs, "gram").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.round(F.sum("idf"), 6).alias("idf_sum"))


def number_presence(spark, d):
    pages = load(spark, d, "pages").select("page_id", text.basic_clean(F.col("url"), native=True).alias("t"))
    return vectors.number_postings(pages, "t", ["page_id"])


def field_patterns(spark, d):
    parts = load(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower("p_type").alias("address"))
    return vectors.field_postings(parts, {"name": "name", "address": "address"}, ["p_partkey"])


def query_pruning(spark, d):
    w = _weights(spark, d).where("side = 'q'")
    return blocking.pick_rare(w, ["id"]).select("id", "gram", "pick", F.round("w", 6).alias("w"))


def field_quota(spark, d):
    parts = load(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower("p_type").alias("address"))
    fields = vectors.field_postings(parts, {"name": "name", "address": "address"}, ["p_partkey"])
    whole = parts.select("p_partkey", F.concat_ws(" ", "name", "address").alias("t"))
    w = vectors.tfidf(vectors.postings(whole, vectors.char_ngrams(F.col("t")), ["p_partkey"]), features.one_row(whole), ["p_partkey"])
    return blocking.pick_by_field(fields, w, ["p_partkey"], {"name": 6, "address": 8}).select("p_partkey", "field", "gram")


def work_estimate(spark, d):
    w = _weights(spark, d)
    df = w.where("side = 'd'").groupBy("gram").agg(F.count("*").alias("df"))
    return blocking.work_estimate(blocking.pick_rare(w.where("side = 'q'"), ["id"]), df, ["id"])


def _split(w):
    one = w.where("side = 'q'").select(F.col("id").alias("s1"), "gram", "w", "df", "n")
    two = w.where("side = 'd'").select(F.col("id").alias("s23"), (F.col("id") % 2 + 2).cast("int").alias("source"), "gram", "w", "df", "n")
    return one, two


def _sides(spark, d):
    return _split(_weights(spark, d))


def _forward(one, two):
    return blocking.search(blocking.pick_rare(one, ["s1"]), two, 15, query="s1", document="s23", per=["source"])


def blocking_forward(spark, d):
    return _forward(*_sides(spark, d))


def blocking_reverse(spark, d):
    one, two = _sides(spark, d)
    return blocking.search(blocking.pick_rare(two, ["s23"]), one, 10, query="s23", document="s1", coverage=0.7)


def blocking_both(spark, d):
    one, two = _sides(spark, d)
    n = one.select("n").limit(1)  # one value
    hits = blocking.retrieve(one.drop("n"), two.drop("n"), n_docs=n)
    return blocking.combine_and_trim(hits, ["name_addr_fwd", "name_addr_rev"], 15, 5)


def pair_cosine(spark, d):
    one, two = _sides(spark, d)
    pairs = blocking_forward(spark, d).select("s1", "s23")
    return vectors.pair_dot(pairs, one.select("s1", "gram", "w"), two.select("s23", "gram", "w")).select("s1", "s23", F.round("dot", 6).alias("dot"))


def sibling_support(spark, d):
    # read several times below, so the weights are computed once
    w = steps.written(_weights(spark, d).drop("tf"), "weights")
    scored = steps.written(_forward(*_split(w)).select("s1", "s23", F.col("score").alias("p")), "siblings")
    weights = w.where("side = 'd'").select(F.col("id").alias("s23"), "gram", "w")
    return vectors.centroid_support(scored, weights).select("s1", "s23", F.round("others", 6).alias("others"), F.round("support", 5).alias("support"))


def embedding_topk(spark, d):
    """Each vector whose id 20 divides against all others, exact cosine in blocks; one without a direction has no neighbours."""
    return vectors.nearest(load(spark, d, "embeddings"), 3, "vec_id", "embedding", every=20)


# ---- pair world


def combine_and_trim(spark, d):
    return blocking.combine_and_trim(_hits(spark, d), METHODS, 2, 2)


def candidates_only(spark, d):
    return tsv.trim_saved(blocking.combine_and_trim(_hits(spark, d), METHODS, 4, 0), 3)


def chunked_work(spark, d):
    work = _hits(spark, d).groupBy(F.col("s1")).agg(F.count("*").alias("work"))
    return blocking.chunk_by_work(work.groupBy((F.floor(F.col("s1") / 100)).alias("s1")).agg(F.sum("work").alias("work")), 1000, "s1")


def competition_features(spark, d):
    r = ranking.competition(_pairs(spark, d).withColumn("name", F.col("s23") % 3), "p", name="name")
    return r.select("s1", "s23", "n_same_name_candidates", "n_candidates_for_s1", F.round("gap_to_best_for_s1", 6).alias("gap_s1"), "source_rank", "reverse_rank", F.round("gap_to_best_for_s23", 6).alias("gap_s23"), "n_s1_wanting_this")


def leave_one_out(spark, d):
    r = ranking.leave_one_out(_pairs(spark, d))
    return r.select("s1", "s23", "p_rank", F.round("p_others_max", 6).alias("others_max"), F.round("p_others_sum", 6).alias("others_sum"), "n_sure_others")


def shared_best(spark, d):
    r = ranking.score_others_max(_pairs(spark, d), "p")
    return r.select("s1", "s23", F.round("others_max", 6).alias("others_max"))


def list_context(spark, d):
    r = ranking.list_context(_pairs(spark, d))
    return r.select("s1", "s23", "list_rank", "list_size", *[F.round(c, 6).alias(c) for c in ("prev_p", "next_p", "mass_above", "mass_below", "gap_prev", "gap_next")], *[f"n_over_{int(100 * t)}" for t in ranking.LEVELS])


def exclusivity(spark, d):
    return ranking.exclusive(_pairs(spark, d)).select("s1", "s23", F.round("p", 6).alias("p"))


def keep_rule(spark, d):
    return decisions.keep_rule(_pairs(spark, d)).select("s1", "s23", F.round("p", 6).alias("p"))


def threshold_decision(spark, d):
    return decisions.decide(_pairs(spark, d), "threshold", 0.6).select("s1", "s23", F.round("p", 6).alias("p"))


def expected_f05_decision(spark, d):
    return decisions.decide(_pairs(spark, d), "expected").select("s1", "s23", F.round("p", 6).alias("p"))


def macro_f05(spark, d):
    r = evaluation.macro_f05(decisions.keep_rule(_pairs(spark, d)), _truth(spark, d), _records(spark, d).select("s1"))
    return r.select(F.round("macro_f05", 6).alias("macro_f05"), "n_pred", "n_hit", "n_records")


def score_breakdown(spark, d):
    r = evaluation.score_breakdown(decisions.keep_rule(_pairs(spark, d)), _truth(spark, d), _records(spark, d))
    return r.select("country", "matches", F.round("f05", 6).alias("f05"), "n")


def blocking_report(spark, d):
    cand = blocking.combine_and_trim(_hits(spark, d), METHODS, 15)
    r = evaluation.blocking_report(cand, _truth(spark, d), _records(spark, d).select("s1"), features.one_row(load(spark, d, "part")), (1, 3, 5))
    return r.select("n_candidates", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


def found_by_method(spark, d):
    return evaluation.found_by_method(blocking.collapse_hits(_hits(spark, d), METHODS), _truth(spark, d), METHODS)


def recall_variants(spark, d):
    cand = blocking.combine_and_trim(_hits(spark, d), METHODS, 15)
    r = blocking.recall_variants(cand, _truth(spark, d), (1, 2, 4, None))
    return r.select("cap", "found", "pairs", F.round("recall", 6).alias("recall"))


def error_examples(spark, d):
    p = _pairs(spark, d)
    r = evaluation.error_examples(p, _truth(spark, d), decisions.keep_rule(p), 20)
    return r.select("s1", "s23", F.round("p", 6).alias("p"), "kind")


def error_counts(spark, d):
    p = _pairs(spark, d)
    return evaluation.errors(p, _truth(spark, d), decisions.keep_rule(p)).groupBy("kind").agg(F.count("*").alias("n"))


def threshold_grid(spark, d):
    r = decisions.threshold_grid(ranking.exclusive(_pairs(spark, d)), _truth(spark, d), _records(spark, d).select("s1"))
    return r.select("t", F.round("macro_f05", 6).alias("macro_f05"))


def honest_grid(spark, d):
    r = decisions.honest_grid(_pairs(spark, d), _truth(spark, d), _records(spark, d).select("s1"), decisions.KEEP, decisions.KEEP_FIRST)
    return r.select("fold", "t", "t1", F.round("picked", 6).alias("picked"), F.round("honest", 6).alias("honest"))


def auc(spark, d):
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.auc(rows, "toxic", "n_chars").select(F.round("auc", 6).alias("auc"))


def quantiles(spark, d):
    per = _hits(spark, d).groupBy("s1").agg(F.count("*").cast("double").alias("n"))
    return evaluation.quantiles(per, "n")


def score_correlations(spark, d):
    rows = load(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    r = evaluation.score_correlations(rows, ["l_quantity", "l_discount", "l_tax"])
    return r.select("a", "b", *[F.round(c, 6).alias(c) for c in ("corr", "mean_a", "std_a")])


def budget_limit(spark, d):
    spread = _pairs(spark, d).withColumn("p", (F.col("s1") * 7919 + F.col("s23") * 104729) % 9973 / 9973.0)  # few equal values
    return decisions.unsure(spread, 0.499, 500).select("s1", "s23", F.round("p", 6).alias("p"))


def blend_two(spark, d):
    p = _pairs(spark, d)
    r = decisions.blend(p.where("source = 2 OR p > 0.5"), p.where("source = 3 OR p > 0.5"), 0.6)
    return r.select("s1", "s23", F.round("p", 6).alias("p"))


def ensemble_mean(spark, d):
    h = _hits(spark, d)
    runs = [h.where(F.col("method") == m).groupBy("s1", "s23").agg(F.max("score").alias("ce")) for m in METHODS]
    return decisions.ensemble_mean(runs).select("s1", "s23", F.round("ce", 6).alias("ce"), "n_runs")


def pseudo_labels(spark, d):
    return decisions.pseudo_labels(_pairs(spark, d), high=0.9, low=0.1)


def pseudo_pairs(spark, d):
    return decisions.pseudo_pairs(_pairs(spark, d), high=0.9, low=0.1, hard=3)


def hash_split(spark, d):
    return decisions.split_by_hash(_records(spark, d).select("s1"), "s1")


def hash_sample(spark, d):
    return learning.hash_sample(_records(spark, d).select("s1"), "s1", 100)


def id_lists(spark, d):
    answers = decisions.keep_rule(_pairs(spark, d)).withColumn("at", F.col("s23"))
    return tsv.id_lists(_records(spark, d).select("s1"), answers, s1_key="s1", id_col="s23", order_col="at", name="matched")


def truth_explode(spark, d):
    lists = tsv.id_lists(_records(spark, d).select("s1"), _truth(spark, d), s1_key="s1", id_col="s23", order_col="s23", name="matched_entity_ids")
    return tsv.truth_pairs(lists.withColumnRenamed("s1", "source1_entity_id"))


def row_numbers(spark, d):
    return tsv.with_row_number(load(spark, d, "customer").select(F.col("c_name").alias("entity_id")), "row")


def monte_carlo(spark, d):
    return decisions.monte_carlo(_pairs(spark, d))


# ---- names


def _names(spark, d):
    parts = load(spark, d, "part")
    one = parts.select(F.col("p_partkey").alias("s1"), F.lower("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return one


def levenshtein_similarity(spark, d):
    """Each two names of a nation are compared once, then spread to all keys that hold them."""
    a = load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("a"), F.col("s_nationkey").alias("nation"))
    b = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("b"), F.col("c_nationkey").alias("nation"))

    def held(rows, key, name):
        """A row per nation, name and up to 4096 of its keys."""
        n = F.row_number().over(Window.partitionBy("nation", name).orderBy(key))
        return rows.where("nation IS NOT NULL").withColumn("part", F.floor((n - 1) / 4096)).groupBy("nation", name, "part").agg(F.collect_list(key).alias(key)).drop("part")

    # the pairs are far more than the tables' bytes tell and nations are few, so customers' names are dealt to all tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = held(a, "s_suppkey", "a").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts, "nation", "deal")
    two = held(b, "c_custkey", "b").withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")).repartition(parts, "nation", "deal")
    pairs = one.join(two, ["nation", "deal"]).select("s_suppkey", "c_custkey", F.round(similarity.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("sim"))
    return pairs.withColumn("s_suppkey", F.explode("s_suppkey")).withColumn("c_custkey", F.explode("c_custkey"))


def _name_pairs(spark, d):
    n = _names(spark, d).select("name").distinct()
    return n.withColumnRenamed("name", "a").join(n.withColumnRenamed("name", "b"), F.col("a") < F.col("b"))  # distinct part names


def jaro_winkler(spark, d):
    s = similarity.similarities(F.col("a"), F.col("b"), "jaro_winkler")
    return _name_pairs(spark, d).withColumn("s", s).select("a", "b", F.round("s.jaro_winkler", 6).alias("sim"))


def indel_family(spark, d):
    s = similarity.similarities(F.col("a"), F.col("b"), "ratio", "partial", "token_sort", "token_set")
    return _name_pairs(spark, d).withColumn("s", s).select("a", "b", *[F.round(f"s.{k}", 6).alias(k) for k in ("ratio", "partial", "token_sort", "token_set")])


def rival_scores(spark, d):
    one = _names(spark, d).select("s1", F.col("brand").alias("key"), "name")
    copies = load(spark, d, "lineitem").select(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("s23")).distinct()
    sup = load(spark, d, "supplier").select(F.col("s_suppkey").alias("s23"), F.lower("s_name").alias("name"), F.concat(F.lit("Brand#"), F.col("s_nationkey") % 5 + 1, F.col("s_nationkey") % 5 + 1).alias("key"))
    pairs = copies.join(sup, "s23")
    r = rivals.rival_scores(pairs, one, "key", "name", "name", lambda a, b: F.round(similarity.levenshtein_similarity(a, b), 6))
    return r.select("s1", "s23", "own", "key_eq", "n_rivals", F.round("gap_best", 6).alias("gap_best"), "n_better", "n_tie", F.round("gap_second", 6).alias("gap_second"))


def sibling_expansion(spark, d):
    kept = decisions.keep_rule(_pairs(spark, d)).where("s23 % 3 = 0").select("s1", "s23")  # two of three parts have no owner
    keys = load(spark, d, "part").select(F.col("p_partkey").alias("s23"), F.concat_ws("|", "p_brand", "p_size").alias("key"))
    return rivals.sibling_expansion(kept, keys, kept.select("s23").distinct())


def word_difference(spark, d):
    p = _name_pairs(spark, d)
    return features.word_difference(p, "a", "b")


def word_difference_features(spark, d):
    """The 16 columns of part names against their brand's first one; some copies are joined up or initials."""
    legal = F.when(F.col("p_size") % 3 > 0, F.lower(F.substring("p_type", 1, 2)))
    n = load(spark, d, "part").select(F.col("p_brand").alias("s1"), F.col("p_partkey").alias("s23"), F.lower("p_name").alias("n"), legal.alias("legal"), F.col("p_size").alias("size"))
    first = n.groupBy("s1").agg(F.min_by(F.struct("n", "legal"), "s23").alias("x")).select("s1", F.col("x.n").alias("core1"), F.col("x.legal").alias("legal1"), F.concat_ws(" ", "x.n", "x.legal").alias("name1"))
    copy = F.when(F.col("size") % 5 == 0, F.replace("core1", F.lit(" "), F.lit(""))).when(F.col("size") % 5 == 1, F.regexp_replace("name1", r"(\w)\w* ?", "$1")).otherwise(F.col("n"))
    pairs = n.join(first, "s1").select("s1", "s23", "core1", "legal1", "name1", copy.alias("core2"), F.col("legal").alias("legal2"))
    return features.word_difference_features(pairs).drop("core1", "legal1", "name1", "core2", "legal2")


def word_map_learning(spark, d):
    """How often a word replaces another between part names of one brand and type."""
    n = load(spark, d, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("k"), "p_partkey", F.lower("p_name").alias("n"))
    first = n.groupBy("k").agg(F.min_by("n", "p_partkey").alias("name1"), F.min("p_partkey").alias("m"))
    swaps, _, _ = learning.word_counts(n.join(first, "k").where("p_partkey <> m").select("name1", F.col("n").alias("name2")))
    return swaps


def learned_words(spark, d):
    n = load(spark, d, "part").select(F.concat_ws("|", "p_brand", "p_type").alias("k"), "p_partkey", F.lower("p_name").alias("n"))
    first = n.groupBy("k").agg(F.min_by("n", "p_partkey").alias("name1"), F.min("p_partkey").alias("m"))
    return learning.learn_words(n.join(first, "k").where("p_partkey <> m").select("name1", F.col("n").alias("name2")), least=2, share=0.1, sound=0.0)


def gbdt_scores(spark, d):
    rows = ranking.competition(ranking.leave_one_out(_pairs(spark, d)), "p").join(_truth(spark, d).withColumn("label", F.lit(1.0)), ["s1", "s23"], "left").na.fill(0.0, ["label"])
    rows = rows.withColumn("fold", (text.id_bucket(F.col("s1")) % 2))
    names = ["p_rank", "p_others_max", "p_others_sum", "n_sure_others", "n_candidates_for_s1", "gap_to_best_for_s1", "reverse_rank"]
    rows = rows.withColumn("stop", text.id_bucket(F.col("s1")) % 100 < 10)  # the records that end the rounds early
    return learning.cross_fit(rows.withColumnRenamed("p", "score"), names, validation="stop").select("s1", "s23", "p", "label")


def _named(batches):
    """For mapInArrow: (id, text) to a clean table's rows."""
    for b in batches:
        parts = [pa.array(c, pa.string()) for c in zip(*[batch.clean_row(batch.clean(t)) for t in b.column(1).to_pylist()])] or [pa.array([], pa.string())] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *parts], ["id", "name_clean", "name_core", "legal_form", "addr_clean"])


def _proposed(spark, d):
    """(candidates, passages, documents): what the search proposes to the benchmark's passages among all documents."""
    def table(rows, row):
        # by row, so that a file of few row groups is dealt to all tasks too
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
        return steps.written(rows.mapInArrow(_named, "id long, name_clean string, name_core string, legal_form string, addr_clean string").withColumnRenamed("id", row), row)

    one = table(load(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), "text"), "s1")
    two = table(_docs(spark, d).select(F.col("doc_id").cast("long").alias("id"), "text"), "s23")
    both = one.select(F.col("name_core").alias("t")).unionByName(two.select(F.col("name_core").alias("t")))
    known = vectors.text_frequencies(both, lambda r: {"char": r[0] or ""}).select("gram", "df")
    source = (F.col("s23") % 2 + 2).cast("int").alias("source")
    hits = blocking.retrieve_texts(one.select("s1", F.col("name_core").alias("t")), two.select("s23", source, F.col("name_core").alias("t")), known, both.count())
    cand = blocking.combine_and_trim(hits, ["name_addr_fwd", "name_addr_rev"])
    return cand.withColumn("source", source), one, two


def pair_features(spark, d):
    """The 69 features of benchmark passages against the documents that the search proposes."""
    return features.pair_features(*_proposed(spark, d))


def queries() -> dict:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}
    return {k: f for k, f in own.items() if k not in ("load", "queries")}
