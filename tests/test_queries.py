"""Every linkage query equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

from linkloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def said(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, (str, bool)):
        return str(v)
    return repr(round(float(v), 9) + 0.0)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(oracles.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(said, r)) for r in df.select(*cols).collect()) == sorted(tuple(said(r[i]) for i in at) for r in want.fetchall())


def plain_ratio(a, b):
    """From the textbook table of common subsequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_indel_family_against_plain_definition(spark):
    for r in queries.indel_family(spark, SF).collect():
        ordered = [" ".join(sorted(t.split())) for t in (r.a, r.b)]
        short, long_ = sorted((r.a, r.b), key=len)
        ways = [(short, long_), (long_, short)] if len(short) == len(long_) else [(short, long_)]
        assert abs(r.ratio - round(plain_ratio(r.a, r.b), 6)) < 1e-6 and abs(r.token_sort - round(plain_ratio(*ordered), 6)) < 1e-6
        if (len(r.a) * len(r.b)) % 7 == 0:
            assert abs(r.partial - round(max(plain_ratio(s, t[max(0, e - len(s)) : e]) for s, t in ways for e in range(1, len(t) + len(s))), 6)) < 1e-6


def test_queries_with_limits_give_rows(spark):
    for name in ("budget_limit", "sibling_expansion"):
        assert getattr(queries, name)(spark, SF).count() > 0
    assert queries.rival_scores(spark, SF).where("n_rivals IS NOT NULL AND n_tie IS NOT NULL").count() > 0


def test_models_separate(spark):
    got = queries.gbdt_scores(spark, SF).toPandas()
    assert len(got) and got["p"].between(0, 1).all()


def test_pair_features_of_every_candidate(spark):
    df = queries.pair_features(spark, SF)
    got = df.toPandas()
    assert len(got.columns) - 2 >= 69 - 2 and len(got) > 0 and not got.duplicated(["s1", "s23"]).any()
    assert got[["name_partial", "name_ratio", "name_token_set"]].apply(lambda c: c.between(0, 100).all()).all()
    assert got["name_jaro_winkler"].between(0, 1).all() and (got["name_partial"] >= got["name_ratio"] - 1e-9).mean() > 0.99


def test_pair_features_are_of_documents(spark):
    from linkloom.operators import blocking

    cand, _, two = queries._proposed(spark, SF)
    known = {r.doc_id for r in queries.load(spark, SF, "documents").select("doc_id").collect()}
    assert {r.s23 for r in two.select("s23").collect()} == known
    got = cand.collect()
    assert got and {r.s23 for r in got} <= known
    assert max(r.candidate_rank for r in got) == blocking.MAX_CANDIDATES - 1


def test_gbdt_scores_use_the_operators_rounds_and_stop_early(spark, monkeypatch):
    from linkloom.operators import learning

    seen = []
    monkeypatch.setattr(learning, "fit_gbdt", lambda rows, names, label="label", **kw: seen.append((rows, kw)) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises((StopIteration, RuntimeError)):
        queries.gbdt_scores(spark, SF)
    rows, kw = seen[0]
    assert kw == {"validation": "stop"} and {r.stop for r in rows.select("stop").distinct().collect()} == {False, True}


def test_levenshtein_of_names_that_many_hold(spark, tmp_path):
    """As the SQL says, in all tasks, and a name that many rows hold is compared once (below the rows that it spreads to)."""
    con = duckdb.connect()
    con.execute("create table supplier as select i as s_suppkey, case when i % 7 > 0 then 'Supplier ' || i % 5 end as s_name, case when i % 11 > 0 then i % 3 end as s_nationkey from range(60) t(i)")
    con.execute("create table customer as select i as c_custkey, case when i % 6 > 0 then 'Customer#' || i % 4 else '' end as c_name, i % 3 as c_nationkey from range(90) t(i)")
    for t in ("supplier", "customer"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    df = queries.levenshtein_similarity(spark, str(tmp_path))
    want = con.sql(oracles.SQL["levenshtein_similarity"]).fetchall()
    assert sorted(tuple(map(said, r)) for r in df.collect()) == sorted(tuple(map(said, r)) for r in want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode(c_custkey") < plan.index("levenshtein(")


def test_sibling_support_weighs_the_texts_once(spark):
    files = queries.sibling_support(spark, SF).inputFiles()
    assert files and not any("documents" in f or "benchmark" in f for f in files)
