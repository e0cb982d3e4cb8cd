"""DuckDB SQL for the queries' results, written independently of the DataFrame code."""

from __future__ import annotations

from linkloom.functions import rules
from linkloom.functions.translit import LATIN


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _words(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def _fold(t: str) -> str:
    t = f"lower({t})"
    for a, b in LATIN.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"strip_accents({t})"


def _clean(t: str) -> str:
    t = f"replace({_fold(t)}, '&', ' and ')"
    t = f"regexp_replace({t}, '{rules.WEBSITE}', ' \\3 ', 'g')"
    for _ in (1, 2):
        t = f"regexp_replace({t}, '\\b([a-z])\\.([a-z])\\b', '\\1' || chr(1) || '\\2', 'g')"
    t = f"replace(replace({t}, chr(1), ''), '''', '')"
    t = f"regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')"
    return f"array_to_string(list_transform({_words(t)}, lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), ' ')"


def _distinct(a: str) -> str:
    """First occurrences in order."""
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


CLEAN = f"clean AS MATERIALIZED (SELECT doc_id, {_clean('text')} AS t FROM documents)"
PASSAGES = f"passages AS MATERIALIZED (SELECT item_id AS s1, {_clean('text')} AS t FROM benchmark)"
FIRST = "coalesce(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))[1], '')"
POST = "coalesce(list_filter(w, lambda x, i: i > 1 AND regexp_full_match(x, '[0-9]{4,6}'))[-1], '')"
POSTCODE = f"CASE WHEN len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]{{4,6}}'))) > 0 THEN {POST} ELSE '' END"
DIGITS = "array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]+'))), ' ')"

PAIRS = "pairs AS (SELECT l_orderkey AS s1, l_partkey AS s23, max(l_quantity / 51) AS p, l_partkey % 2 + 2 AS source FROM lineitem GROUP BY ALL)"
TRUTH = "truth AS (SELECT DISTINCT l_orderkey AS s1, l_partkey AS s23 FROM lineitem WHERE l_linestatus = 'F')"
RECORDS = "records AS (SELECT o_orderkey AS s1, n_name AS country FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"
OWN = "own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s23 ORDER BY p DESC, s1) AS rn FROM pairs) WHERE rn = 1)"
KEEP = "kept AS (SELECT s1, s23, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s23) AS f FROM own) WHERE p >= 0.74 OR (f = 1 AND p >= 0.56))"
HITS = "hits AS (SELECT l_orderkey AS s1, l_partkey AS s23, l_returnflag AS method, l_quantity / 51 AS score, l_linenumber AS rank FROM lineitem)"
COLLAPSED = "flat AS (SELECT s1, s23, min(rank) AS best_rank, max(score) AS best_score, count(DISTINCT method) AS n_methods, " + ", ".join(f"max(score) FILTER (method = '{m}') AS score_{m}" for m in "ANR") + " FROM hits GROUP BY ALL)"


def _f05(pred: str, true: str, hit: str) -> str:
    return f"CASE WHEN {pred} = 0 AND {true} = 0 THEN 1.0::DOUBLE WHEN {hit} = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * {hit} / (0.25::DOUBLE * {true} + {pred}) END"


def _per(answers: str = "kept") -> str:
    return f"""per AS (SELECT r.s1, r.country, coalesce(a.n, 0) AS n_pred, coalesce(t.n, 0) AS n_true, coalesce(h.n, 0) AS n_hit FROM records r
        LEFT JOIN (SELECT s1, count(*) AS n FROM {answers} GROUP BY 1) a USING (s1) LEFT JOIN (SELECT s1, count(*) AS n FROM truth GROUP BY 1) t USING (s1)
        LEFT JOIN (SELECT s1, count(*) AS n FROM {answers} JOIN truth USING (s1, s23) GROUP BY 1) h USING (s1)),
        scored AS (SELECT *, {_f05('n_pred', 'n_true', 'n_hit')} AS f, CASE WHEN n_true = 0 THEN '0' WHEN n_true = 1 THEN '1' WHEN n_true <= 3 THEN '2-3' ELSE '4+' END AS matches FROM per)"""


def _trim(most: int, rescue: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY best_rank, best_score DESC, s23) - 1 AS r FROM flat),
        cand AS (SELECT s1, s23, best_rank, best_score, n_methods, score_A, score_N, score_R, CASE WHEN r < {most} THEN r ELSE -1 END AS candidate_rank FROM ranked WHERE r < {most + rescue})"""


GRAMS = "list_transform(generate_series(1, length(x)), lambda i: substr(' ' || x || ' ', i, 3))"
POSTINGS = f"""both_ AS (SELECT 'd' AS side, doc_id AS id, t FROM clean UNION ALL SELECT 'q', s1, t FROM passages),
    post AS (SELECT side, id, gram, count(*) AS tf FROM (SELECT side, id, unnest(flatten(list_transform({_words('t')}, lambda x: {GRAMS}))) AS gram FROM both_) GROUP BY ALL),
    df AS (SELECT gram, count(*) AS df FROM post GROUP BY 1),
    raw AS (SELECT side, id, gram, tf, df, n, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w0 FROM post JOIN df USING (gram), (SELECT count(*)::DOUBLE AS n FROM both_)),
    weights AS MATERIALIZED (SELECT side, id, gram, tf, df, n, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY side, id)) AS w FROM raw)"""
VEC = f"WITH {CLEAN}, {PASSAGES}, {POSTINGS}"
PICK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, gram) AS pick FROM weights WHERE side = '{s}') WHERE pick <= 30 AND (pick <= 20 OR df <= greatest(50.0, 0.001 * n))"
FWD = f"""fwd0 AS (SELECT q.id AS s1, d.id AS s23, d.id % 2 + 2 AS source, round(sum(q.w * d.w), 6) AS score FROM ({PICK.format(s='q')}) q JOIN weights d ON d.side = 'd' AND d.gram = q.gram GROUP BY ALL),
    fwd AS (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY score DESC, s23) - 1 AS rank FROM fwd0 QUALIFY rank < 15)"""
REV = f"""rev0 AS (SELECT d.id AS s23, q.id AS s1, round(sum(d.w / d.total * (0.7 + (1 - 0.7) * q.w)), 6) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY id) AS total FROM ({PICK.format(s='d')})) d JOIN weights q ON q.side = 'q' AND q.gram = d.gram GROUP BY ALL),
    rev AS (SELECT *, row_number() OVER (PARTITION BY s23 ORDER BY score DESC, s1) - 1 AS rank FROM rev0 QUALIFY rank < 10)"""
NAMES = "names AS (SELECT DISTINCT lower(p_name) AS n FROM part), np AS (SELECT x.n AS a, y.n AS b FROM names x JOIN names y ON x.n < y.n)"


def _name_parts() -> str:
    t = "regexp_replace(CASE WHEN regexp_matches(t, '^(m s|messrs) +[^ ]') THEN regexp_replace(t, '^(m s|messrs) +', '') ELSE t END, '([a-z])0([a-z])', '\\1o\\2', 'g')"
    t = f"regexp_replace({t}, '([a-z])0([a-z])', '\\1o\\2', 'g')"
    for phrase in sorted(rules.LETTER_SEQUENCES, key=lambda p: (-len(p), p)):
        t = f"regexp_replace({t}, '\\b{phrase}\\b', '{rules.LETTER_SEQUENCES[phrase]}', 'g')"
    legal = _map(rules.LEGAL_WORDS)
    return f"""a AS (SELECT doc_id, {_words(t)} AS w0 FROM clean), b AS (SELECT doc_id, {_distinct('w0')} AS w FROM a),
        c AS (SELECT doc_id, w, list_filter(w, lambda x: len(map_extract({legal}, x)) = 0) AS core, list_sort(list_distinct(list_transform(list_filter(w, lambda x: len(map_extract({legal}, x)) > 0), lambda x: map_extract({legal}, x)[1]))) AS legal FROM b),
        parts AS (SELECT doc_id, array_to_string(w, ' ') AS name_clean, array_to_string(CASE WHEN len(core) > 0 THEN core ELSE w END, ' ') AS name_core, array_to_string(legal, ' ') AS legal_form, legal FROM c)"""


def _address() -> str:
    t = "t"
    for phrase in sorted((p for p in rules.STATE_NAMES if " " in p), key=lambda p: (-len(p), p)):
        t = f"regexp_replace({t}, '\\b{phrase}\\b', '{rules.STATE_NAMES[phrase]}', 'g')"
    single = _map({k: v for k, v in rules.STATE_NAMES.items() if " " not in k})
    fillers = ", ".join(f"'{w}'" for w in rules.ADDRESS_FILLER_WORDS)
    return f"""a AS (SELECT doc_id, list_transform({_words(t)}, lambda x: coalesce(map_extract({single}, x)[1], x)) AS w FROM clean),
        b AS (SELECT doc_id, list_filter(list_transform(w, lambda x: coalesce(map_extract({_map(rules.ADDRESS_WORDS)}, x)[1], x)), lambda x: x NOT IN ({fillers})) AS w FROM a)"""


def _sound(t: str) -> str:
    for old, new in rules.SOUND_PAIRS:
        t = f"replace({t}, '{old}', '{new}')"
    t = f"array_to_string(list_transform({_words(t)}, lambda x: substr(x, 1, 1) || regexp_replace(substr(x, 2), '[aeiouyh]', '', 'g')), ' ')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789C":
        t = f"regexp_replace({t}, '{c}{c}+', '{c}', 'g')"
    return t


def _typos(t: str) -> str:
    digits, letters = rules.DIGITS_FOR_LETTERS
    fixed = f"CASE WHEN length(regexp_replace(x, '[^a-z]', '', 'g')) >= 3 AND regexp_matches(x, '[0-9]') THEN translate(x, '{digits}', '{letters}') ELSE x END"
    return f"array_to_string(list_transform({_words(t)}, lambda x: regexp_replace({fixed}, '^l([nmstdcfvgkpr])', 'i\\1')), ' ')"


LEGAL_BIT = "list_sum([0::BIGINT] || list_transform(legal, lambda f: 1::BIGINT << (list_position([" + ", ".join(f"'{f}'" for f in rules.LEGAL_FORMS) + "], f) - 1)::BIGINT))::BIGINT"
LEV = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"
LOGIT = "ln(greatest(least({x}, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least({x}, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)))"
SWAPS = """n AS (SELECT p_brand || '|' || p_type AS k, p_partkey, lower(p_name) AS n FROM part), f AS (SELECT k, min(p_partkey) AS m, arg_min(n, p_partkey) AS name1 FROM n GROUP BY 1),
    pr AS (SELECT list_distinct(string_split(name1, ' ')) AS x, list_distinct(string_split(n.n, ' ')) AS y FROM n JOIN f USING (k) WHERE p_partkey <> m),
    df2 AS (SELECT list_filter(x, lambda v: NOT list_contains(y, v)) AS missing, list_filter(y, lambda v: NOT list_contains(x, v)) AS extra FROM pr)"""
RIVAL = rf"""u AS (SELECT doc_id, trim(regexp_replace(regexp_replace({_fold("coalesce(text, '')")}, '[^\x00-\x7f]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM documents),
    r1 AS (SELECT doc_id, plain, regexp_replace(plain, 'www\.\S+|https?://\S+|\S+@\S+|\S+\.com\b', ' ', 'g') AS t FROM u),
    r2 AS (SELECT doc_id, plain, string_split(regexp_replace(regexp_replace(t, '\(id:?\s*\d+\)|\d{{6,}}', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' ') AS w FROM r1),
    r3 AS (SELECT doc_id, plain, list_transform(list_filter(list_zip(w, list_prepend('', w)), lambda p: p[1] <> '' AND p[1] <> p[2]), lambda p: p[1]) AS w FROM r2)"""
FIELDS = f"""f AS (SELECT p_partkey, 'name' AS field, lower(p_name) AS t FROM part UNION ALL SELECT p_partkey, 'address', lower(p_type) FROM part),
    fg AS (SELECT DISTINCT p_partkey, field, unnest(flatten(list_transform({_words('t')}, lambda x: {GRAMS}))) AS gram FROM f),
    post AS (SELECT p_partkey, gram, count(*) AS tf FROM (SELECT p_partkey, unnest(flatten(list_transform({_words('t')}, lambda x: {GRAMS}))) AS gram FROM f) GROUP BY ALL),
    df AS (SELECT gram, count(*) AS df FROM post GROUP BY 1),
    raw AS (SELECT p_partkey, gram, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w0 FROM post JOIN df USING (gram), (SELECT count(*)::DOUBLE AS n FROM part)),
    w AS (SELECT p_partkey, gram, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY p_partkey)) AS w FROM raw),
    placed AS (SELECT p_partkey, field, gram, CASE field WHEN 'name' THEN 6 ELSE 8 END AS quota, count(*) OVER (PARTITION BY p_partkey, field) AS n_field,
        row_number() OVER (PARTITION BY p_partkey, field ORDER BY round(w, 9) DESC, gram) AS place FROM fg JOIN w USING (p_partkey, gram)),
    other AS (SELECT p_partkey, field, sum(least(n_field, quota)) AS took FROM placed WHERE place = 1 GROUP BY ALL)"""
LEARNED = f"""{SWAPS}, sw AS (SELECT extra, missing, count(*) AS n FROM (SELECT extra, unnest(missing) AS missing FROM (SELECT unnest(extra) AS extra, missing FROM df2)) GROUP BY ALL),
    ex AS (SELECT word, count(*) AS n_extra FROM (SELECT unnest(extra) AS word FROM df2) GROUP BY 1),
    seen AS (SELECT word, count(*) AS n_copy FROM (SELECT unnest(y) AS word FROM pr) GROUP BY 1),
    best AS (SELECT extra AS word, missing, n FROM (SELECT *, row_number() OVER (PARTITION BY extra ORDER BY n DESC, missing) AS rn FROM sw) WHERE rn = 1),
    spell AS (SELECT word, missing FROM best JOIN ex USING (word) WHERE n >= 2 AND n >= 0.1::DOUBLE * n_extra)"""
GRID = f"""one AS (SELECT o.s1, o.p, row_number() OVER (PARTITION BY o.s1 ORDER BY o.p DESC, o.s23) = 1 AS first, (u.s1 IS NOT NULL)::INT AS hit FROM own o LEFT JOIN truth u ON u.s1 = o.s1 AND u.s23 = o.s23),
    g AS (SELECT * FROM (SELECT round(0.50 + 0.02 * i, 2)::DOUBLE AS t FROM range(21) r(i)), (SELECT round(0.40 + 0.04 * i, 2)::DOUBLE AS t1 FROM range(10) r(i) UNION ALL SELECT NULL) WHERE t1 IS NULL OR t1 < t),
    c AS (SELECT s1, t, t1, count(*) AS n_pred, sum(hit) AS n_hit FROM one JOIN g ON p >= t OR (first AND p >= t1) GROUP BY ALL),
    tr AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1),
    z AS (SELECT r.s1, g.t, g.t1, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit, coalesce(n_true, 0) AS n_true FROM records r CROSS JOIN g LEFT JOIN tr ON tr.s1 = r.s1
        LEFT JOIN c ON c.s1 = r.s1 AND c.t = g.t AND coalesce(c.t1, -1) = coalesce(g.t1, -1)),
    m AS (SELECT (s1::HUGEINT * 2654435761 % 4294967296 // 65536 % 2)::INT AS fold, t, t1, round(avg({_f05('n_pred', 'n_true', 'n_hit')}), 9) AS f FROM z GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f DESC, t, t1 NULLS FIRST) AS rn FROM m) WHERE rn = 1)"""
WORDS_APART = f"""n AS (SELECT p_brand AS s1, p_partkey AS s23, lower(p_name) AS n, CASE WHEN p_size % 3 > 0 THEN lower(substr(p_type, 1, 2)) ELSE '' END AS legal, p_size AS size FROM part),
    f AS (SELECT s1, n AS core1, legal AS legal1, n || ' ' || legal AS name1 FROM n WHERE s23 IN (SELECT min(s23) FROM n GROUP BY s1)),
    c AS (SELECT n.s1, s23, core1, legal1, trim(name1) AS name1, legal AS legal2, CASE size % 5 WHEN 0 THEN replace(core1, ' ', '') WHEN 1 THEN regexp_replace(trim(name1), '(\\w)\\w* ?', '\\1', 'g') ELSE n END AS core2 FROM n JOIN f USING (s1)),
    w AS (SELECT *, {_words('core1')} AS x, {_words('core2')} AS y, {_words('name1')} AS z FROM c),
    v AS (SELECT *, list_distinct(list_filter(y, lambda q: NOT list_contains(x, q))) AS a, list_distinct(list_filter(x, lambda q: NOT list_contains(y, q))) AS m,
        list_distinct(list_filter(x, lambda q: list_contains(y, q))) AS b, len(y) = 1 AND len(x) > 1 AS lone FROM w)"""

SQL = {
    "word_difference_features": f"""WITH {WORDS_APART} SELECT s1, s23, len(a)::DOUBLE AS wd_add, len(m)::DOUBLE AS wd_miss, len(b)::DOUBLE AS wd_common,
        len(list_filter(a, lambda q: length(q) <= 3))::DOUBLE AS wd_add_short, len(list_filter(a, lambda q: length(q) > 3))::DOUBLE AS wd_add_long,
        (len(x) > 0 AND len(y) > 0 AND x[1] = y[1])::INT::DOUBLE AS wd_first_eq,
        (list_filter(y, lambda q: list_contains(x, q)) = list_filter(x, lambda q: list_contains(y, q)))::INT::DOUBLE AS wd_order_eq,
        (lone AND y[1] IN (array_to_string(list_transform(x, lambda q: q[1]), ''), array_to_string(list_transform(z, lambda q: q[1]), '')))::INT::DOUBLE AS wd_acronym,
        (lone AND y[1] IN (replace(core1, ' ', ''), replace(name1, ' ', '')))::INT::DOUBLE AS wd_concat,
        (legal1 <> '' AND legal2 <> '' AND legal1 <> legal2)::INT::DOUBLE AS wd_legal_diff, (legal2 <> '' AND legal1 = '')::INT::DOUBLE AS wd_legal_b_only, (legal1 <> '' AND legal2 = '')::INT::DOUBLE AS wd_legal_x_only,
        len(b)::DOUBLE / greatest(len(a) + len(m) + len(b), 1) AS wd_jacc, len(y)::DOUBLE AS wd_b_ntok, len(x)::DOUBLE AS wd_x_ntok,
        rank() OVER (PARTITION BY s1 ORDER BY len(a))::DOUBLE AS wd_rank_add FROM v""",
    "honest_grid": f"WITH {PAIRS}, {TRUTH}, {RECORDS}, {OWN}, {GRID} SELECT b.fold, b.t, b.t1, round(b.f, 6) AS picked, round(o.f, 6) AS honest FROM best b JOIN m o ON o.fold = 1 - b.fold AND o.t = b.t AND coalesce(o.t1, -1) = coalesce(b.t1, -1)",
    "rival_keys": f"WITH {RIVAL} SELECT doc_id, plain, array_to_string(list_filter(w, lambda x: NOT list_contains({rules.RIVAL_STOP_WORDS}, x)), ' ') AS key FROM r3",
    "field_quota": f"WITH {FIELDS} SELECT p.p_partkey, p.field, p.gram FROM placed p LEFT JOIN other o ON o.p_partkey = p.p_partkey AND o.field <> p.field WHERE p.place <= greatest(p.quota, 14 - coalesce(o.took, 0))",
    "learned_words": f"WITH {LEARNED} SELECT word, 'map' AS kind, missing AS target FROM spell UNION ALL SELECT word, 'noise', '' FROM ex JOIN seen USING (word) WHERE n_extra >= 2 AND n_extra >= 0.6::DOUBLE * n_copy AND word NOT IN (SELECT word FROM spell)",
    "clean_tokens": f"WITH {CLEAN} SELECT doc_id, t FROM clean",
    "name_parts": f"WITH {CLEAN}, {_name_parts()} SELECT doc_id, name_clean, name_core, legal_form FROM parts",
    "clean_address": f"WITH {CLEAN}, {_address()} SELECT doc_id, array_to_string({_distinct('w')}, ' ') AS addr FROM b",
    "number_fields": f"WITH {CLEAN}, x AS (SELECT doc_id, t, {_words('t')} AS w FROM clean) SELECT doc_id, {FIRST} AS first_number, {POSTCODE} AS postcode, {DIGITS} AS digit_key FROM x",
    "page_numbers": f"WITH c AS (SELECT page_id, {_clean('url')} AS t FROM pages), x AS (SELECT *, {_words('t')} AS w FROM c) SELECT page_id, t, {FIRST} AS first_number, {POSTCODE} AS postcode, {DIGITS} AS digit_key FROM x",
    "sound_skeleton": f"WITH {CLEAN} SELECT doc_id, {_sound('t')} AS sound FROM clean",
    "fix_typos": f"WITH x AS (SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS t FROM customer) SELECT c_custkey, {_typos('t')} AS fixed, {_typos(chr(40) + chr(39) + 'l' + chr(39) + ' || t || ' + chr(39) + 'lnd5ia 3rd 24x7 te0hno1' + chr(39) + chr(41))} AS mixed FROM x",
    "acronym": f"WITH x AS (SELECT p_partkey, {_words('lower(p_name)')} AS w, {_words(_typos('lower(p_name)'))} AS v FROM part) SELECT p_partkey, CASE WHEN len(w) >= 2 THEN array_to_string(list_transform(w, lambda x: substr(x, 1, 1)), '') ELSE '' END AS initials, array_to_string({_distinct('v')}, ' ') AS key FROM x",
    "word_shape": f"WITH {CLEAN}, x AS (SELECT doc_id, t, {_words('t')} AS w FROM clean) SELECT doc_id, len(w) AS n_words, length(t) AS n_chars, coalesce(w[1], '') AS first_word, coalesce(w[-1], '') AS last_word FROM x",
    "legal_bit_sets": f"WITH {CLEAN}, {_name_parts()}, x AS (SELECT doc_id, {LEGAL_BIT} AS bits FROM parts) SELECT doc_id, bits, bit_count(bits) AS n_bits, bit_count(bits & ~8::BIGINT) AS n_other FROM x",
    "ascii_fold": f"SELECT doc_id, {_fold('text')} AS folded FROM documents",
    "script_udf": f"SELECT doc_id, {_fold('text')} AS folded, regexp_matches(text, '[ऀ-෿]') AS indic FROM documents",
    "pair_texts": "SELECT p_partkey, trim(p_name || ' | ' || p_type, ' |') AS pair_text FROM part",
    "unseen_words": f"WITH {CLEAN}, {PASSAGES}, v AS (SELECT DISTINCT unnest({_words('t')}) AS word FROM passages), x AS (SELECT doc_id, unnest({_words('t')}) AS word FROM clean), s AS (SELECT doc_id, avg(CASE WHEN v.word IS NULL THEN 1.0 ELSE 0.0 END) AS u FROM x LEFT JOIN v USING (word) GROUP BY 1) SELECT doc_id, round(coalesce(u, 0), 6) AS unseen FROM clean LEFT JOIN s USING (doc_id)",
    "logits": f"WITH {PAIRS} SELECT s1, s23, round({LOGIT.format(x='p')}, 6) AS logit, round(1 / (1 + exp(-1.5::DOUBLE * {LOGIT.format(x='p')})), 6) AS tempered, CASE WHEN source = 2 THEN NULL ELSE round(p, 6) END AS ratio FROM pairs",
    "distinct_clean": f"SELECT p_partkey, {_clean('p_name')} AS clean FROM part",
    "char_ngrams": f"WITH {CLEAN}, g AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform({_words('t')}, lambda x: {GRAMS}))) AS gram FROM clean) SELECT gram, count(*) AS df FROM g GROUP BY 1",
    "tfidf_weights": f"{VEC} SELECT side, id, count(*) AS n_grams, round(sum(w), 6) AS sum_w, round(max(w), 6) AS max_w, sum(tf)::BIGINT AS sum_tf FROM weights GROUP BY ALL",
    "word_idf_sums": f"WITH {CLEAN}, p AS (SELECT DISTINCT doc_id, unnest({_words('t')}) AS gram FROM clean), i AS (SELECT gram, ln((1 + (SELECT count(*) FROM clean))::DOUBLE / (1 + count(*))) + 1 AS idf FROM p GROUP BY 1) SELECT doc_id, count(*) AS n_words, round(sum(idf), 6) AS idf_sum FROM p JOIN i USING (gram) GROUP BY 1",
    "number_presence": f"WITH c AS (SELECT page_id, {_clean('url')} AS t FROM pages) SELECT DISTINCT page_id, unnest(list_filter({_words('t')}, lambda x: regexp_full_match(x, '[0-9]+'))) AS gram FROM c",
    "field_patterns": f"WITH f AS (SELECT p_partkey, 'name' AS field, lower(p_name) AS t FROM part UNION ALL SELECT p_partkey, 'address', lower(p_type) FROM part) SELECT DISTINCT p_partkey, field, unnest(flatten(list_transform({_words('t')}, lambda x: {GRAMS}))) AS gram FROM f",
    "query_pruning": f"{VEC} SELECT id, gram, pick, round(w, 6) AS w FROM ({PICK.format(s='q')})",
    "work_estimate": f"{VEC}, d AS (SELECT gram, count(*) AS hits FROM weights WHERE side = 'd' GROUP BY 1) SELECT id, sum(hits)::BIGINT AS work FROM ({PICK.format(s='q')}) JOIN d USING (gram) GROUP BY 1",
    "blocking_forward": f"{VEC}, {FWD} SELECT * FROM fwd",
    "blocking_reverse": f"{VEC}, {REV} SELECT * FROM rev",
    "blocking_both": f"""{VEC}, {FWD}, {REV}, hits AS (SELECT s1, s23, 'f' AS method, score, rank FROM fwd UNION ALL SELECT s1, s23, 'r', score, rank FROM rev),
        flat AS (SELECT s1, s23, min(rank) AS best_rank, max(score) AS best_score, count(DISTINCT method) AS n_methods, max(score) FILTER (method = 'f') AS score_name_addr_fwd, max(score) FILTER (method = 'r') AS score_name_addr_rev FROM hits GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY best_rank, best_score DESC, s23) - 1 AS k FROM flat QUALIFY k < 20)
        SELECT * EXCLUDE (k), CASE WHEN k < 15 THEN k ELSE -1 END AS candidate_rank, CASE WHEN k >= 15 THEN max(best_score) FILTER (k < 15) OVER (PARTITION BY s1) - best_score END AS search_margin FROM r""",
    "embedding_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0), s AS (SELECT a.vec_id, b.vec_id AS near, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near) - 1 AS rank FROM s QUALIFY rank < 3""",
    "pair_cosine": f"{VEC}, {FWD} SELECT f.s1, f.s23, round(coalesce(sum(a.w * b.w), 0), 6) AS dot FROM fwd f JOIN weights a ON a.side = 'q' AND a.id = f.s1 JOIN weights b ON b.side = 'd' AND b.id = f.s23 AND b.gram = a.gram GROUP BY ALL",
    "sibling_support": f"""{VEC}, {FWD}, t AS (SELECT f.s1, f.s23, f.score AS p, gram, w FROM fwd f JOIN weights d ON d.side = 'd' AND d.id = f.s23), c AS (SELECT s1, gram, sum(p * w) AS total FROM t GROUP BY ALL),
        x AS (SELECT s1, s23, p, sum(w * total) AS dot, sum(w * w) AS own FROM t JOIN c USING (s1, gram) GROUP BY ALL)
        SELECT s1, s23, round(sum(p) OVER (PARTITION BY s1) - p, 6) AS others, CASE WHEN sum(p) OVER (PARTITION BY s1) - p > 1e-3 THEN round((dot - p * own) / (sum(p) OVER (PARTITION BY s1) - p), 5) END AS support FROM x""",
    "combine_and_trim": f"WITH {HITS}, {COLLAPSED}, {_trim(2, 2)} SELECT *, CASE WHEN candidate_rank < 0 THEN max(best_score) FILTER (candidate_rank >= 0) OVER (PARTITION BY s1) - best_score END AS search_margin FROM cand",
    "candidates_only": f"WITH {HITS}, {COLLAPSED}, {_trim(4, 0)} SELECT *, NULL::DOUBLE AS search_margin FROM cand WHERE candidate_rank < 3",
    "chunked_work": "WITH w AS (SELECT floor(l_orderkey / 100)::BIGINT AS s1, count(*) AS work FROM lineitem GROUP BY 1) SELECT s1, work, floor((sum(work) OVER (ORDER BY s1) - work) / 1000)::BIGINT AS chunk FROM w",
    "competition_features": f"""WITH {PAIRS} SELECT s1, s23, count(*) OVER (PARTITION BY s1, s23 % 3) - 1 AS n_same_name_candidates, count(*) OVER a AS n_candidates_for_s1, round(max(p) OVER a - p, 6) AS gap_s1, row_number() OVER (PARTITION BY s1, source ORDER BY p DESC, s23) AS source_rank,
        row_number() OVER (PARTITION BY s23 ORDER BY p DESC, s1) AS reverse_rank, round(max(p) OVER b - p, 6) AS gap_s23, count(*) OVER b AS n_s1_wanting_this FROM pairs WINDOW a AS (PARTITION BY s1), b AS (PARTITION BY s23)""",
    "leave_one_out": f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s23) AS k FROM pairs)
        SELECT s1, s23, k AS p_rank, round(CASE WHEN k = 1 THEN max(p) FILTER (k = 2) OVER a ELSE max(p) OVER a END, 6) AS others_max, round(sum(p) OVER a - p, 6) AS others_sum, (count(*) FILTER (p > 0.5) OVER a) - (p > 0.5)::INT AS n_sure_others FROM r WINDOW a AS (PARTITION BY s1)""",
    "shared_best": f"""WITH {PAIRS}, b AS (SELECT *, max(p) OVER (PARTITION BY s1) AS m FROM pairs)
        SELECT s1, s23, round(CASE WHEN p = m AND count(*) FILTER (p = m) OVER w = 1 THEN max(p) FILTER (p < m) OVER w ELSE m END, 6) AS others_max FROM b WINDOW w AS (PARTITION BY s1)""",
    "list_context": f"""WITH {PAIRS}, r AS (SELECT *, lag(p, 1, 1.0::DOUBLE) OVER w AS prev_p, lead(p, 1, 0.0::DOUBLE) OVER w AS next_p, row_number() OVER w AS list_rank, coalesce(sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, s23 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM pairs WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, s23))
        SELECT s1, s23, list_rank, count(*) OVER a AS list_size, round(prev_p, 6) AS prev_p, round(next_p, 6) AS next_p, round(above, 6) AS mass_above, round(sum(p) OVER a - above - p, 6) AS mass_below,
        round({LOGIT.format(x='prev_p')} - {LOGIT.format(x='p')}, 6) AS gap_prev, round({LOGIT.format(x='p')} - {LOGIT.format(x='next_p')}, 6) AS gap_next,
        {', '.join(f"count(*) FILTER (p >= {t}::DOUBLE) OVER a AS n_over_{int(100 * t)}" for t in (0.9, 0.7, 0.5, 0.3, 0.1))} FROM r WINDOW a AS (PARTITION BY s1)""",
    "exclusivity": f"WITH {PAIRS}, {OWN} SELECT s1, s23, round(p, 6) AS p FROM own",
    "keep_rule": f"WITH {PAIRS}, {OWN}, {KEEP} SELECT s1, s23, round(p, 6) AS p FROM kept",
    "threshold_decision": f"WITH {PAIRS}, {OWN} SELECT s1, s23, round(p, 6) AS p FROM own WHERE p >= 0.6",
    "expected_f05_decision": f"""WITH {PAIRS}, {OWN}, c AS (SELECT s1, s23, p, least(p, 1 - 1e-6::DOUBLE) AS q FROM own),
        r AS (SELECT *, row_number() OVER w AS k, sum(q) OVER (PARTITION BY s1 ORDER BY q DESC, s23 ROWS UNBOUNDED PRECEDING) AS h, sum(q) OVER (PARTITION BY s1) AS t, exp(sum(ln(1 - q)) OVER (PARTITION BY s1)) AS none FROM c WINDOW w AS (PARTITION BY s1 ORDER BY q DESC, s23)),
        s AS (SELECT *, round((1 - none) * 1.25::DOUBLE * h / (0.25::DOUBLE * t + k), 9) AS f FROM r), b AS (SELECT *, max(f) OVER (PARTITION BY s1) AS best FROM s),
        z AS (SELECT *, min(k) FILTER (f = best) OVER (PARTITION BY s1) AS cut FROM b) SELECT s1, s23, round(p, 6) AS p FROM z WHERE k <= cut AND round(none, 9) < best""",
    "macro_f05": f"WITH {PAIRS}, {TRUTH}, {RECORDS}, {OWN}, {KEEP}, {_per()} SELECT round(avg(f), 6) AS macro_f05, sum(n_pred)::BIGINT AS n_pred, sum(n_hit)::BIGINT AS n_hit, count(*) AS n_records FROM scored",
    "score_breakdown": f"WITH {PAIRS}, {TRUTH}, {RECORDS}, {OWN}, {KEEP}, {_per()} SELECT country, 'all' AS matches, round(avg(f), 6) AS f05, count(*) AS n FROM scored GROUP BY 1 UNION ALL SELECT 'all', matches, round(avg(f), 6), count(*) FROM scored GROUP BY 2 UNION ALL SELECT 'all', 'all', round(avg(f), 6), count(*) FROM scored",
    "blocking_report": f"""WITH {HITS}, {COLLAPSED}, {_trim(15, 0)}, {TRUTH}, {RECORDS}, h AS (SELECT t.s1, t.s23, candidate_rank AS r FROM truth t LEFT JOIN cand c USING (s1, s23)),
        per AS (SELECT r.s1, coalesce(n, 0) AS n_true, coalesce(k, 0) AS n_hit FROM records r LEFT JOIN (SELECT s1, count(*) AS n, count(r) AS k FROM h GROUP BY 1) USING (s1)), c AS (SELECT count(*) AS n FROM cand), p AS (SELECT count(*) AS n_s1, avg((n_hit = n_true)::INT) AS all_found, avg({_f05('n_hit', 'n_true', 'n_hit')}) AS ceiling FROM per)
        SELECT c.n AS n_candidates, round(c.n / n_s1, 6) AS per_record, round(1 - c.n / (n_s1::DOUBLE * (SELECT count(*) FROM part)), 6) AS reduction, round((SELECT count(r) / count(*) FROM h), 6) AS pair_recall, round(all_found, 6) AS all_found, round(ceiling, 6) AS ceiling,
        {', '.join(f"round((SELECT count(*) FILTER (r < {k}) / count(*) FROM h), 6) AS recall_at_{k}" for k in (1, 3, 5))} FROM c, p""",
    "found_by_method": f"WITH {HITS}, {COLLAPSED}, {TRUTH}, h AS (SELECT flat.* FROM truth JOIN flat USING (s1, s23)) " + " UNION ALL ".join(f"SELECT '{m}' AS method, count(score_{m}) AS found, count(*) FILTER (score_{m} IS NOT NULL AND n_methods = 1) AS \"only\" FROM h" for m in "ANR"),
    "recall_variants": f"WITH {HITS}, {COLLAPSED}, {_trim(15, 0)}, {TRUTH}, h AS (SELECT candidate_rank AS r FROM truth LEFT JOIN cand USING (s1, s23)) " + " UNION ALL ".join(f"SELECT {c} AS cap, count(*) FILTER ({t}) AS found, count(*) AS pairs, round(count(*) FILTER ({t}) / count(*), 6) AS recall FROM h" for c, t in ((1, "r < 1"), (2, "r < 2"), (4, "r < 4"), (-1, "r IS NOT NULL"))),
    "error_examples": f"""WITH {PAIRS}, {TRUTH}, {OWN}, {KEEP}, e AS (SELECT s1, s23, p, 'false_positive' AS kind FROM kept ANTI JOIN truth USING (s1, s23) UNION ALL SELECT s1, s23, p, 'false_negative' FROM (SELECT * FROM pairs SEMI JOIN truth USING (s1, s23)) ANTI JOIN kept USING (s1, s23))
        SELECT s1, s23, round(p, 6) AS p, kind FROM e QUALIFY row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'false_positive' THEN -p ELSE p END, s1, s23) <= 20""",
    "error_counts": f"WITH {PAIRS}, {TRUTH}, {OWN}, {KEEP} SELECT 'false_positive' AS kind, count(*) AS n FROM kept ANTI JOIN truth USING (s1, s23) UNION ALL SELECT 'false_negative', count(*) FROM (SELECT * FROM pairs SEMI JOIN truth USING (s1, s23)) ANTI JOIN kept USING (s1, s23)",
    "threshold_grid": f"""WITH {PAIRS}, {TRUTH}, {RECORDS}, {OWN}, g AS (SELECT round(0.30 + 0.05 * i, 2)::DOUBLE AS t FROM range(13) r(i)), a AS (SELECT s1, t, count(*) AS n_pred, count(u.s1) AS n_hit FROM (SELECT own.s1, own.s23, t FROM own JOIN g ON p >= t) LEFT JOIN (SELECT * FROM truth) u USING (s1, s23) GROUP BY ALL),
        w AS (SELECT s1, count(*) AS n FROM truth GROUP BY 1), z AS (SELECT g.t, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_true FROM records r CROSS JOIN g LEFT JOIN a ON a.s1 = r.s1 AND a.t = g.t LEFT JOIN w ON w.s1 = r.s1) SELECT t, round(avg({_f05('n_pred', 'n_true', 'n_hit')}), 6) AS macro_f05 FROM z GROUP BY 1""",
    "auc": "WITH r AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)), k AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rk FROM r) SELECT round((sum(rk) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2) / (count(*) FILTER (toxic = 1)::DOUBLE * count(*) FILTER (toxic = 0)), 6) AS auc FROM k",
    "quantiles": "WITH p AS (SELECT l_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), q AS (SELECT [0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[] AS s, quantile_cont(n, [0.1, 0.25, 0.5, 0.75, 0.9]) AS v FROM p) SELECT unnest(s) AS share, unnest(v) AS value FROM q",
    "score_correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr, round(avg({a}), 6) AS mean_a, round(stddev_samp({a}), 6) AS std_a FROM lineitem" for a in ("l_quantity", "l_discount", "l_tax") for b in ("l_quantity", "l_discount", "l_tax")),
    "budget_limit": f"WITH {PAIRS}, q AS (SELECT s1, s23, (s1 * 7919 + s23 * 104729) % 9973 / 9973.0::DOUBLE AS p FROM pairs), u AS (SELECT *, abs(p - 0.5) AS off FROM q WHERE abs(p - 0.5) < 0.499), l AS (SELECT off FROM u ORDER BY off LIMIT 1 OFFSET 500) SELECT s1, s23, round(p, 6) AS p FROM u WHERE off < coalesce((SELECT off FROM l), 0.499)",
    "blend_two": f"WITH {PAIRS}, a AS (SELECT * FROM pairs WHERE source = 2 OR p > 0.5), b AS (SELECT * FROM pairs WHERE source = 3 OR p > 0.5) SELECT s1, s23, round(0.6 * coalesce(a.p, 0) + 0.4 * coalesce(b.p, 0), 6) AS p FROM a FULL JOIN b USING (s1, s23)",
    "ensemble_mean": f"WITH {HITS}, {COLLAPSED} SELECT s1, s23, round((coalesce(score_A, 0) + coalesce(score_N, 0) + coalesce(score_R, 0)) / n_methods, 6) AS ce, n_methods AS n_runs FROM flat",
    "pseudo_labels": f"WITH {PAIRS}, {OWN} SELECT s1, s23, 1 AS label FROM own WHERE p >= 0.9 UNION ALL SELECT s1, s23, 0 FROM pairs WHERE p <= 0.1",
    "pseudo_pairs": f"WITH {PAIRS}, {OWN}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s23) AS k, max(p) OVER (PARTITION BY s1) AS b FROM pairs) SELECT s1, s23, 'positive' AS stratum FROM own WHERE p >= 0.9 UNION ALL SELECT s1, s23, CASE WHEN b <= 0.1 THEN 'lone' ELSE 'hard' END FROM r WHERE p <= 0.1 AND k <= 3",
    "id_lists": f"WITH {PAIRS}, {OWN}, {KEEP} SELECT o_orderkey AS s1, coalesce(m, '') AS matched FROM orders LEFT JOIN (SELECT s1, string_agg(s23::VARCHAR, ',' ORDER BY s23) AS m FROM kept GROUP BY 1) ON s1 = o_orderkey",
    "truth_explode": f"WITH {TRUTH} SELECT s1 AS source1_entity_id, s23::VARCHAR AS entity_id FROM truth",
    "row_numbers": "SELECT c_name AS entity_id, row_number() OVER (ORDER BY c_name) - 1 AS row FROM customer",
    "levenshtein_similarity": f"SELECT s_suppkey, c_custkey, round({LEV.format(a='s_name', b='c_name')}, 6) AS sim FROM supplier JOIN customer ON s_nationkey = c_nationkey",
    "jaro_winkler": f"WITH {NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS sim FROM np",
    "rival_scores": f"""WITH one AS (SELECT p_partkey AS s1, p_brand AS key, lower(p_name) AS name1 FROM part), sup AS (SELECT s_suppkey AS s23, lower(s_name) AS name, 'Brand#' || (s_nationkey % 5 + 1) || (s_nationkey % 5 + 1) AS key FROM supplier),
        pr AS (SELECT DISTINCT l_partkey AS s1, l_suppkey AS s23 FROM lineitem), p AS (SELECT pr.s1, pr.s23, name, sup.key, o.key AS own_key, round({LEV.format(a='name', b='o.name1')}, 6) AS own FROM pr JOIN sup USING (s23) JOIN one o ON o.s1 = pr.s1),
        m AS (SELECT p.*, r.s1 AS rival, round({LEV.format(a='p.name', b='r.name1')}, 6) AS sc FROM p LEFT JOIN (SELECT * FROM one WHERE key IN (SELECT key FROM one GROUP BY 1 HAVING count(*) <= 300)) r ON r.key = p.key)
        SELECT s1, s23, CASE WHEN count(rival) > 0 THEN any_value(own) END AS own, (any_value(key) = any_value(own_key))::INT AS key_eq, nullif(count(rival), 0) AS n_rivals, round(any_value(own) - max(sc), 6) AS gap_best, CASE WHEN count(rival) > 0 THEN count(*) FILTER (sc > own) END AS n_better,
        CASE WHEN count(rival) > 0 THEN count(*) FILTER (sc = own) - count(*) FILTER (rival = s1) END AS n_tie, round(any_value(own) - max(sc) FILTER (rival <> s1), 6) AS gap_second FROM m GROUP BY ALL""",
    "sibling_expansion": f"""WITH {PAIRS}, {OWN}, {KEEP.replace("kept AS", "every AS")}, kept AS (SELECT * FROM every WHERE s23 % 3 = 0), k AS (SELECT p_partkey AS s23, p_brand || '|' || p_size AS key FROM part), g AS (SELECT key, count(*) AS gsize FROM k GROUP BY 1 HAVING count(*) <= 30)
        SELECT kept.s1, k2.s23, count(*) AS n_seeds, max(gsize) AS gsize FROM kept JOIN k USING (s23) JOIN g USING (key) JOIN k k2 ON k2.key = g.key WHERE k2.s23 NOT IN (SELECT s23 FROM kept) GROUP BY ALL""",
    "word_difference": f"""WITH {NAMES}, x AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM np), z AS (SELECT a, b, list_distinct(list_filter(y, lambda v: NOT list_contains(x, v))) AS added, list_distinct(list_filter(x, lambda v: NOT list_contains(y, v))) AS lost, len(list_distinct(list_filter(x, lambda v: list_contains(y, v)))) AS n_common FROM x)
        SELECT a, b, n_common, len(added) AS n_added, len(lost) AS n_lost, array_to_string(list_sort(added), ' ') AS added, array_to_string(list_sort(lost), ' ') AS lost FROM z""",
    "word_map_learning": f"WITH {SWAPS} SELECT extra, missing, count(*) AS n FROM (SELECT extra, unnest(missing) AS missing FROM (SELECT unnest(extra) AS extra, missing FROM df2)) GROUP BY ALL",
}
