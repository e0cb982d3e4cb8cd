"""Small fixtures with nulls, empty and repeated rows, against brute force or exact round trips."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import chat, common, embeddings, exact_dedup, language_id, minhash, mixing, packing, queries, substring_dedup, toxicity, url_filter
from linkloom.llm.common import components
from linkloom.llm.words import shingles, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(300)]
    rows = []
    for i in range(40):
        base = list(rng.choice(words, 90))
        rows.append((10 * i, " ".join(base), "en", f"s{i % 3}", 0))
        if i % 4 == 0:
            near = base[:]
            near[5] = "CHANGED"
            rows += [(10 * i + 1, " ".join(near), "en", "s0", 0), (10 * i + 2, " ".join(base), "en", None, 0)]
    shared = " ".join(rng.choice(words, 60))
    rows += [(1000 + k, " ".join(rng.choice(words, 40)) + " " + shared + " " + " ".join(rng.choice(words, 40)), "en", "s1", 0) for k in range(3)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "one", "en", "s1", 3), (2003, "ONE", "en", "s1", 3), (2002, "one", "en", "s1", 3), (None, "one", "en", "s1", 3)]
    rows += [(2004, " ".join(words * 40), "en", "s2", 0), (2005, "\t\n ", "en", "s2", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumn("kept", F.lit(7)).withColumn("size", F.lit("x"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 1)], "a long, b long")
    assert {r.id: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 10: 1, 4: 4, 5: 4, 7: 7}


def test_exact(docs, empty):
    got = exact_dedup.exact_duplicates(docs, bucket_keys=8).collect()
    by = {}
    for i, t in texts(docs):
        by.setdefault(t or "", []).append(i)
    assert len(got) == docs.count()
    for r in got:
        t = next(k for k in by if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(by[t]) and r.keep_id == max((i for i in by[t] if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by)
    left = exact_dedup.drop_exact_duplicates(docs.withColumn("row", F.lit(1)).withColumn("copies", F.array(F.lit(2))), bucket_keys=4)
    assert left.columns == [*docs.columns, "row", "copies"] and sorted((r.text or "", r.doc_id or -1) for r in left.collect()) == sorted((t, max((i for i in v if i is not None), default=-1)) for t, v in by.items())
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs.select("doc_id", F.col("doc_id").alias("text"))).count() == docs.select("doc_id").distinct().count()
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_collisions(docs):
    """Four key bits: nearly all texts collide and are chained in their owner's table."""
    got = exact_dedup.exact_duplicates(docs, key_bits=4, bucket_keys=4)
    want = exact_dedup.exact_duplicates(docs)
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and got.where("chain > 0").count() > 0


def test_exact_directory_is_read_back(docs):
    """Two owners, buckets of three keys: they split; every key lies in its slot's bucket, every slot has one."""
    rows = exact_dedup.rows_of(docs, "doc_id", "text")
    index = exact_dedup.build_index(rows, bucket_keys=3, owner_bits=1)
    directory, depth = exact_dedup.slots(index)
    slots = {r.slot: r.bucket for r in directory.collect()}
    pages = index.where("key IS NOT NULL").collect()
    assert depth > 2 and sorted(slots) == list(range(1 << depth)) and len(set(slots.values())) == index.where("key IS NULL").count()
    sizes = {}
    for p in pages:
        assert slots[p.key % (1 << 64) >> (64 - depth)] == p.bucket and p.owner == p.key % (1 << 64) >> 63
        sizes.setdefault(p.bucket, set()).add(p.key)
    assert max(map(len, sizes.values())) <= 3 and len(pages) == rows.select("text").distinct().count()


def test_table_splits_and_chains():
    t = exact_dedup.Table(1, 1, 2, max_depth=5)
    keys = [(1 << 63) + (k << 58) for k in (0, 0, 1, 2, 2, 3, 30, 31)]
    for n, key in enumerate(keys):
        t.insert(key, f"t{n}", n, 1)
    t.insert(keys[-1], "t7", 70, 4)
    t.close()
    pages = [p for p in t.out if p[3] is not None]
    assert {(p[3] % (1 << 64), p[6]) for p in pages} == {*zip(keys[:-1], range(7)), (keys[-1], 70)} and max(p[4] for p in pages) == 1
    assert [p[7] for p in pages if p[6] == 70] == [5] and t.depth == 5
    deep = {p[1] % (1 << 64): p[2] for p in t.out}
    assert sum(1 << (5 - d) for d in deep.values()) == 16  # the buckets tile the owner's half
    full = {}
    for p in pages:
        full.setdefault(p[1], set()).add(p[3])
    assert max(map(len, full.values())) <= 2


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i], items[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def shingle_set(t, n):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_minhash(docs, empty):
    rows = sorted((r for r in texts(docs) if r[0] is not None), key=lambda r: r[0])
    sets = [(i, shingle_set(t, 2)) for i, t in rows]
    root = brute_components(sets, lambda a, b: a[0] == b[0] or (a[1] and b[1] and 100 * len(a[1] & b[1]) >= 80 * len(a[1] | b[1])))
    want = sorted((i, len(s), sets[r][0]) for (i, s), r in zip(sets, root))
    got = minhash.near_duplicates(docs, width=2)
    assert sorted(tuple(r) for r in got.where("doc_id IS NOT NULL").select("doc_id", "n_shingles", "component_id").collect()) == want
    assert got.where("doc_id IS NULL AND NOT kept AND component_id IS NULL").count() == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b, c = pool[:1000], pool[100:1100], pool[2000:]
    assert (np.maximum(minhash.sketch(a), minhash.sketch(c)) == minhash.sketch(np.concatenate([a, c]))).all()  # mergeable
    compare = lambda x, y: minhash.likely(*[np.array([v]) for v in ((x > y).sum(), (x < y).sum())], np.array([1000.0]), np.array([1000.0]), 0.8)[0]
    assert compare(minhash.sketch(a), minhash.sketch(b)) and not compare(minhash.sketch(a), minhash.sketch(c))


def test_mixing(docs, empty):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    assert all(r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"] for r in got)
    for s in sizes:
        target = next(r["target"] for r in got if r["source"] == s)
        assert target <= 3 * sizes[s] + 1e-6 and abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= max(r["size"] for r in got if r["source"] == s)
    assert sum(r["taken"] for r in got) == mixing.mixed_documents(docs).select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)))).first()[0]
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns


def test_mixing_against_brute_force(docs):
    """Per source: whole passes, then rows in order of hash as long as all below fit, then the fills."""
    rows = mixing._rows(docs, "doc_id", "text", "source")
    of = {}
    for r in rows.collect():
        of.setdefault(r.source, []).append((r.hash, r.size))
    targets = mixing.water_fill({s: sum(x[1] for x in v) for s, v in of.items()}, sum(x[1] for v in of.values() for x in v))
    for s, size, target, whole, below, most, *_ in mixing.planned(rows)[0]:
        assert target == targets[s] and size == sum(x[1] for x in of[s])
        left, own = target - whole * size, sorted(of[s])
        want = [target - whole * size]
        for b, m in zip(below, most):
            taken = sum(x[1] for x in own if x[0] < b and x[1] <= m)
            assert taken <= left + 1e-6  # the threshold fits the budget, and the next row would not
            rest = [x for x in own if x[0] >= b and x[1] <= m]
            if rest:
                assert taken + sum(x[1] for x in rest if x[0] == rest[0][0]) > left - 1e-6 or left <= 0
            left, own = left - taken, [x for x in own if not (x[0] < b and x[1] <= m)]
        assert 0 <= left + 1e-6 <= want[0] + 2e-6


def test_mixing_splits_copies(spark):
    """Rows that repeat, rows without id: as many of the copies as the budget says, each at most thrice."""
    rows = [(7, "one two three four", "a")] * 1000 + [(None, "x y", "b")] * 700 + [(None, "x y z", "b")] * 300 + [(i, "w " * 5, "c") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumn("row", F.lit(1)).withColumn("place", F.lit("p"))
    got = mixing.mix(df, total=9000.0)
    per = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    for r in per.values():
        assert abs(r.taken - r.target) < 5 and r.most <= 3
    copies = mixing.mixed_documents(df, total=9000.0)
    words = {r.source: r.n for r in copies.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert copies.columns == df.columns and words == {s: r.taken for s, r in per.items()}


def test_water_fill():
    got = mixing.water_fill({"a": 10, "b": 100, None: 10}, 120)
    assert got["a"] == 30 and got[None] == pytest.approx(30) and sum(got.values()) == pytest.approx(120)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    slow = Tokenizer.from_file(path)
    known = {}
    for i, t in texts(docs):
        known.setdefault(i, []).append(np.array(slow.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    got = packing.pack(docs, path).toPandas()
    seqs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (seqs["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    assert seqs["length"].sum().max() <= 1024
    for i, own in got[got.doc_id.notna() & (got.doc_id != 2002)].groupby("doc_id"):
        ids, at = known[int(i)][0], 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    assert got["length"].sum() == sum(len(x) for v in known.values() for x in v)
    assert packing.pack(empty, path).count() == 0


def test_packing_cuts_only_on_need(spark, docs):
    path = queries.tokenizer_path()
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"], int(n)))) for i, n in enumerate(rng.integers(1, 900, 600))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path).toPandas()
    lengths = got.groupby("sequence_id")["length"].sum()
    assert sum(1024 - n for n in lengths if n & (n - 1)) <= 0.01 * lengths.sum()
    pieces, need = got.groupby("doc_id").size(), -(-got.groupby("doc_id")["doc_tokens"].first() // 1024)
    assert (pieces > need).sum() < 0.35 * len(rows)


def test_tokens_are_those_of_the_library():
    """Special tokens' strings, long runs, parts of long texts."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    encode, slow = packing.encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    for text in ["a <|endoftext|> b", "<|endoftext|>", " " * 10**6, "a" * 10**5, "\t\n " * 5000 + "x", "don't  stop " * 200000, "é日 " * 5000 + "🙂" * 2000] + ["".join(rng.choice(list("ab '1.\n\té日"), 300)) for _ in range(50)]:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids, text[:40]


def test_differencing():
    sets = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for s in sets for i in s) == [0, 1, 2, 3, 4] and abs(sum([8, 7, 6, 5, 4][i] for i in sets[0]) - 15) <= 1
    assert all(sum(n for _, _, n in w) <= 1024 for w in packing.windows_of([700, 700, 700], 1024))
    assert packing.windows_of([], 10) == []


@pytest.mark.parametrize("seed", range(20))
def test_windows_against_brute_force(seed):
    """Differencing is near the best of all partitions; windows hold each item once and fit."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 100, int(rng.integers(1, 9))).tolist()
    sums = lambda sets: [sum(sizes[i] for i in s) for s in sets]
    best = min(max(sums([[i for i, x in enumerate(p) if x == j] for j in range(3)])) for p in itertools.product(range(3), repeat=len(sizes)))
    got = packing.differencing(sizes, 3)
    assert sorted(i for s in got for i in s) == list(range(len(sizes))) and max(sums(got)) <= 4 / 3 * best
    for k in (None, 2):
        if k and sum(sizes) > 2 * 150:
            continue
        windows = packing.windows_of(sizes, 150, k)
        assert all(sum(n for _, _, n in w) <= 150 for w in windows) and len(windows) <= (k or -(-sum(sizes) // 150)) + packing.RISES
        for i, size in enumerate(sizes):
            at = 0
            for a, n in sorted((a, n) for w in windows for j, a, n in w if j == i):
                assert a == at and n > 0
                at += n
            assert at == size


def test_language_id(spark, docs, empty):
    all_ = queries.table(spark, SF, "documents")
    model = language_id.fit(all_.where(~language_id.held_out(all_["doc_id"])))
    got = language_id.identify(all_, model).join(all_.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    said = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert said[2000].lang_pred == said[2001].lang_pred == said[2005].lang_pred == "und" and said[2000].rejected and said[2002].lang_pred != "und"
    none = language_id.fit(empty)
    assert language_id.identify(docs, none).where("lang_pred <> 'und'").count() == 0 and language_id.identify(empty, model).count() == 0


def test_substrings(docs, empty):
    got = substring_dedup.repeated_passages(docs)
    rows = [r for r in texts(docs) if r[0] is not None]
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    held = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for v in held.values() if len(v) > 1 for i in v}
    found = {x for r in got.collect() for x in (r.doc_id, r.other_id)}
    assert want <= found and {1000, 1001, 1002} <= found
    for r in got.collect():
        a = set(zip(*[words[r.doc_id][r.start + k : r.start + r.n_words] for k in range(5)]))
        b = set(zip(*[words[r.other_id][r.other_start + k : r.other_start + r.other_words] for k in range(5)]))
        assert len(a & b) / len(a | b) >= 0.8 - 1e-9
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(3)
    h = np.concatenate([rng.permutation(60), rng.integers(0, 5, 40), np.zeros(20), [1] * 6]).astype(np.uint64) << np.uint64(40)
    first = np.array([0, 60, 60, 100, 120, 126])
    tree = list(zip(*substring_dedup.compact_windows(h, first, 7)))
    for i in range(5):
        for a in range(first[i], first[i + 1]):
            for b in range(a + 6, first[i + 1]):
                own = [(t, c) for t, l, c, r in tree if l <= a <= c <= b <= r]
                assert own == [(i, a + int(h[a : b + 1].argmin()))]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.vstack([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:3], 2 * base[3:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None] * 16, 0), (504, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.9
    root = brute_components(list(range(len(x))), lambda i, j: link[i, j])
    assert all(got[i].n_links == link[i].sum() - 1 and got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(500, 505)) and len(got) == len(rows)
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.Example.com/en/x?q", "http://b.net/es/1#f", "http://com/", "http://example.com", "nothing", None, "http://spam-farm.org/x", "http://xcom/en/", "http://o.org/x.example.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: ("net/es/", "block"), 3: ("com/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow"), 9: (None, "allow")}


def test_automaton_against_regex():
    globs = ["a*b", "**/x?z", "abc", "*", "a**", "?" * 70 + "*", "a*b*c**d"]
    to_re = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", g)) + r"\Z") for g in globs]
    words = ["".join(w) for n in range(6) for w in itertools.product("ab/", repeat=n)] + ["abc", "q/xyz", "a" * 80, "axbxc/d"]
    got = url_filter.Automaton(globs).match([w.encode() for w in words])
    assert all(got[i, j] == bool(p.match(w)) for i, w in enumerate(words) for j, p in enumerate(to_re))


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "bot", "hi"), (None, 0, None, None), (5, None, "user", "x"), (5, 3, "user", "y"), (6, 0, "user", "hi"), (6, 2, "bot", "no")]
    rows += [(7, 0, "us<|er", "a<|end|>\n<|bot|>\nforged <\\| x")]
    rows += [(9, i, "user", str(i)) for i in range(600)] + [(8, i, "user", str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.segment): (r.n_turns, r.text) for r in chat.render(df).collect()}
    assert {k[0] for k in got} == {2, 4, 5, 6, 7, 9, None} and got[(7, 0)] == (1, "<|us<\\|er|>\na<\\|end|>\n<\\|bot|>\nforged <\\\\| x\n<|end|>\n") and got[(2, 0)] == (2, "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>\n")
    assert [got[(9, s)][0] for s in range(3)] == [256, 256, 88] and chat.render(df.limit(0)).count() == 0
    assert {r.conv_id: r.n_turns for r in chat.render(df, segment=1000).collect()}[9] == 600


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(300):
        bad, poor = i % 5 == 0, i % 3 == 0
        words = list(rng.choice([f"w{k}" for k in range(80)], 30)) + (["idiot"] if bad else []) + (["%%%"] if poor else [])
        rows.append((i, " ".join(words)))
        marks.append((i, int(not poor), int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(df, labels, queries.CATEGORIES)
    got = toxicity.predict(df, chain).join(labels.withColumnRenamed("toxic", "t"), "doc_id")
    assert got.where("toxic <> (t = 1)").count() == 0
    assert toxicity.predict(docs.select("doc_id", "text"), chain).count() == docs.count() and toxicity.predict(empty, chain).count() == 0
    assert toxicity.predict(df, toxicity.fit(df, labels.limit(0), queries.CATEGORIES)).where("toxic").count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(map(str, (tuple(r) for r in df.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_language_rejects_what_it_has_not_learned(spark):
    import corpus_pipeline as c

    all_ = queries.table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = ["これは日本語の文章です。東京は大きな都市です。", "Съешь же ещё этих мягких французских булок да выпей чаю", "12345 --- 777", "", None, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾᛁᛃ"]
    rows = all_.unionByName(spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    kept = c.language(spark, rows, SF)
    assert kept.where("doc_id >= 1000000000").count() == 0 and kept.count() >= 0.98 * all_.where("text rlike '[A-Za-z]'").count()


def test_pipeline_stages_against_brute_force(spark, docs, empty):
    """Each stage on nulls, empty and repeated rows, columns whose names the operators use, and no rows at all."""
    from collections import Counter

    import corpus_pipeline as c

    stages = dict(c.STAGES)
    docs = docs.withColumns({n: F.lit(1) for n in ("row", "copies", "key", "src", "place", "hash", "whole", "copy", "digest", "source_size")})
    as_rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    every = as_rows(docs)
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])))
    assert as_rows(stages["language"](spark, docs, SF)) == Counter({k: n for k, n in every.items() if not model.judge(k[1])[2]})

    best = {}
    for i, t in every:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    got = stages["exact"](spark, docs, SF)
    assert Counter((-1 if i is None else i, t or "") for i, t in as_rows(got).elements()) == Counter((i, t) for t, i in best.items())

    own = sorted({i for i, _ in every if i is not None})
    sets = [(i, [shingle_set(t, 5) for j, t in every if j == i]) for i in own]
    root = brute_components(sets, lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in a[1] for y in b[1]))
    stay = {own[r] for r in root} | {None}
    assert as_rows(stages["near"](spark, docs, SF)) == Counter({k: n for k, n in every.items() if k[0] in stay})

    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.size] += r.taken // r.size if r.size else 0
    mixed = stages["mixture"](spark, docs, SF)
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((i, size(t)) for i, t in as_rows(mixed).elements() if size(t)) == +taken
    for name in ("language", "exact", "near", "mixture"):
        assert stages[name](spark, docs, SF).columns == docs.columns
        none = stages[name](spark, empty, SF)
        assert none.columns == empty.columns and none.count() == 0
    pieces = stages["packed"](spark, docs, SF)
    assert pieces.select("doc_id", "start").where("start = 0").count() == sum(every.values()) and stages["packed"](spark, empty, SF).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from linkloom.llm.common import shared_dir

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError):
            shared_dir(session)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_words_in_pieces(n):
    """Hashes don't depend on how bytes are cut into pieces, nor on the batch."""
    import pyarrow as pa

    from linkloom.llm import words

    rng = np.random.default_rng(n)
    rows = [None, "", " a ", "x" * 40] + ["".join(rng.choice(list("aB \n\té"), 30)) for _ in range(n)]
    whole, first = words.word_hashes(pa.array(rows, pa.string()))
    for size in (1, 7, 64):
        try:
            words._CHUNK, kept = size, words._CHUNK
            hashes, at = words.word_hashes(pa.array(rows, pa.string()))
        finally:
            words._CHUNK = kept
        assert (hashes == whole).all() and (at == first).all()
    counts = np.diff(first).tolist()
    assert counts == [len(WORD.findall(t or "")) for t in rows]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as c

    now = queries.table(spark, SF, "documents")
    for i, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < len(c.STAGES) - 1:
            assert after.columns == now.columns
        if name == "exact":
            assert after.count() == after.select("text").distinct().count() == now.select("text").distinct().count()
        now = after
    assert now.count() > 0 and now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_substrings_of_frequent_lines(spark):
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 10)) for _ in range(20)]
    fresh = lambda n: " ".join(f"x{x}" for x in rng.integers(0, 10**9, n))
    passages = [" ".join(lines[k] for k in rng.permutation(20)[:6]) for _ in range(150)]
    rows = [(d * 1000 + i, f"{fresh(30)} {p} {fresh(30)}") for i, p in enumerate(passages) for d in (0, 1)]
    rows += [(5000 + i, " ".join(f"{fresh(9)} {p}" for p in passages[4 * i : 4 * i + 4])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words, held = {i: t.split() for i, t in rows}, {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), set()).add((i, k))
    got = substring_dedup.repeated_passages(docs).collect()
    spans = {}
    for r in got:
        assert words[r.doc_id] != words[r.other_id]
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.n_words))
    for who in held.values():
        first = min(i for i, _ in who)
        for i, k in who:
            assert i == first or any(a <= k and k + 50 <= b for a, b in spans.get(i, [])), (i, k)


def test_minhash_of_a_document_with_two_texts(spark):
    rng = np.random.default_rng(12)
    a, b = (" ".join(f"{c}{x}" for x in rng.integers(0, 10**6, 80)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " more")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_toxicity_on_rows_it_has_not_seen(spark):
    """Fitted on half of the labels, judged on the others."""
    folder = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    chain = toxicity.fit(docs, labels.where(half == 0), queries.CATEGORIES)
    rest = labels.where(half == 1).select("doc_id", F.col("toxic").alias("t"))
    n = {(r.t, r.toxic): r["count"] for r in toxicity.predict(docs.join(rest, "doc_id", "left_semi"), chain).join(rest, "doc_id").groupBy("t", "toxic").count().collect()}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.03 * (n[0, False] + n.get((0, True), 0))


@pytest.mark.parametrize("few", [256, 0])
def test_substrings_alike_only_to_an_explained_one(spark, monkeypatch, few):
    """b is like a, c is like b but not like a: c meets b although both share their values with a."""
    monkeypatch.setattr(substring_dedup, "FEW", few)
    rows, n = [], 9  # on pairs of a tenth triple only one hash agrees, which is left to chance
    for k in range(n):
        b = [f"w{k}x{i}" for i in range(56)]
        a, c = list(b), list(b)
        a[20], c[35] = f"a{k}", f"c{k}"
        rows += [(k, " ".join(a)), (n + k, " ".join(b)), (2 * n + k, " ".join(c))]
    got = {(r.doc_id, r.other_id): r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(n + k, k) for k in range(n)} <= set(got)
    assert {(2 * n + k, n + k) for k in range(n)} <= set(got)
    assert set(got) <= {x for k in range(n) for x in ((n + k, k), (2 * n + k, n + k))}
    assert all(r.similarity == 47 / 57 for r in got.values())


@pytest.mark.parametrize("bytes_", [1 << 24, 2000])
def test_same_stretches_are_compared_once(monkeypatch, bytes_):
    """Each once if all are remembered, and with the same result if they are not."""
    calls, alike = [], substring_dedup._alike
    monkeypatch.setattr(substring_dedup, "REMEMBERED", bytes_)
    monkeypatch.setattr(substring_dedup, "_alike", lambda *a: calls.append(a) or alike(*a))
    rng = np.random.default_rng(4)
    x = [rng.integers(0, 1 << 32, 60).astype("<u4") for _ in range(4)]
    asked = [(a.tobytes(), np.r_[np.arange(k, dtype="<u4"), b].tobytes(), k) for a in x for b in x for k in (0, 3)] * 3
    compared = substring_dedup._comparing(46, 2 * 0.8 / 1.8, 0.8)
    got = [compared(*a) for a in asked]
    assert got == [alike(*a, 46, 2 * 0.8 / 1.8, 0.8) for a in asked] and sum(map(len, got)) == 24
    assert len(calls) == 32 if bytes_ > 2000 else 32 < len(calls) <= 96


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, few):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, i) for i in range(2001, 2030)]
    link = {frozenset(e) for e in edges}
    ids = sorted({x for e in edges for x in e})
    written, materialise = [], common.materialise
    monkeypatch.setattr(common, "IN_MEMORY", few)
    monkeypatch.setattr(common, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = brute_components(ids, lambda a, b: frozenset((a, b)) in link)
    assert got == {x: ids[root[i]] for i, x in enumerate(ids)}
    assert len(written) == 1 if few else len(written) > 4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_pairs_are_made_across_components_only(most):
    rng = np.random.default_rng(4)
    key, comp = rng.integers(0, 6, 90), np.where(rng.random(90) < 0.8, 0, rng.integers(1, 9, 90))
    made = [(int(a), int(b)) for i, j in minhash._pairs_across(key, comp, most) for a, b in zip(i, j)]
    want = {frozenset((a, b)) for a in range(90) for b in range(a) if key[a] == key[b] and comp[a] != comp[b]}
    assert len(made) == len(want) and {frozenset(p) for p in made} == want
    assert not list(minhash._pairs_across(key[:0], comp[:0]))


def test_ends_of_passages_off_the_diagonal():
    x = np.arange(100, 160, dtype="<u4")
    y = np.concatenate([np.arange(5), x[:30], [7], x[30:], [100]]).astype("<u4")  # moved by one in the middle; x[0] comes twice
    assert substring_dedup._alike(x.tobytes(), y.tobytes(), 5, 46, 0.8, 0.8) == [(0, 5, 60, 61, 60 / 61)]
    assert substring_dedup._alike(x.tobytes(), y.tobytes(), 6, 46, 0.8, 0.8) == [(0, 5, 60, 61, 60 / 61)]


def test_sequences_are_made_once(spark, monkeypatch):
    """Copies by the representative, by pairs of values and by hashes of whole passages read the same table."""
    rng = np.random.default_rng(5)
    x = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 70)) for _ in range(3)]
    rows = [(1, x[0]), (2, x[0] + " more"), (3, x[1]), (4, f"{x[2]} {x[1]}"), (5, "short text"), (5, x[2]), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, sequences = [], substring_dedup.sequences
    monkeypatch.setattr(substring_dedup, "sequences", lambda *a: made.append(a) or sequences(*a))
    got = {(r.doc_id, r.start, r.n_words, r.other_id, r.other_start) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(2, 0, 70, 1, 0), (4, 70, 70, 3, 0), (5, 0, 70, 4, 0)} and len(made) == 1
    held = sequences(docs.selectExpr("doc_id AS doc", "text"), 46, 5).collect()
    assert {r.id: len(r.seq) // 4 for r in held} == {1: 66, 2: 67, 3: 66, 4: 136, 5: 66} and len(held) == 5
    words, first = word_hashes(pa.array([x[0]]))
    want = (shingles(words, 5) >> np.uint64(32)).astype("<u4").tobytes()
    assert all(bytes(r.seq)[: len(want)] == want for r in held if r.id < 3)


def test_values_without_windows(monkeypatch):
    rng = np.random.default_rng(6)
    texts_ = [" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (0, 49, 50, 51, 300, 3, 2000)] + [None, "a " * 120]
    batch = pa.record_batch([pa.array(range(len(texts_))), pa.array(texts_)], ["doc", "text"])
    monkeypatch.setattr(substring_dedup, "TOGETHER", 400)
    want = [(i, n.tolist(), k.tolist()) for i, n, k, w in substring_dedup._keyed(batch, 46, 5)]
    monkeypatch.setattr(substring_dedup, "_nearest_below", None)  # not needed for values alone
    got = [(i, n.tolist(), k.tolist()) for i, n, k, w in substring_dedup._keyed(batch, 46, 5, False) if w is None]
    assert got == want and len(got) > substring_dedup.HASHES
