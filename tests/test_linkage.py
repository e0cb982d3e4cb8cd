"""The whole run on a small synthetic world of two countries, and the operators it adds."""

import random

from linkloom.__main__ import main
from linkloom.operators import blocking, learning, vectors
from linkloom.sources import tsv
from pyspark.sql import functions as F


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join("\t".join(r) for r in [header, *rows]) + "\n", encoding="utf-8")


def world(folder, n=50):
    """Records with one to three noisy copies each: typos, legal words lost or written out, cities left out."""
    rng = random.Random(5)
    heads, trades = ["Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir", "Gorse", "Hazel"], ["Bakery", "Traders", "Hardware", "Textiles", "Foods"]
    ends, streets, cities = ["Inc", "Ltd", "LLC"], ["Main St", "Park Rd", "Hill Ave"], ["Springfield", "Riverton"]
    truth = {}
    for split in ("train", "test"):
        own, noisy = [], {2: [], 3: []}
        for i in range(n):
            name = f"{rng.choice(heads)}{rng.randrange(1000)} {rng.choice(trades)} {rng.choice(ends)}"
            addr, country = f"{rng.randrange(1, 900)} {rng.choice(streets)}, {rng.choice(cities)}", "AB"[i % 2]
            own.append([f"{split}-1-{i}", name, addr, country])
            for k in range(rng.randrange(1, 4)):
                copy = name if rng.random() < 0.4 else name.rsplit(" ", 1)[0].upper()
                copy = copy.replace("a", "", 1) if rng.random() < 0.3 else copy
                source, near = rng.choice([2, 3]), f"{split}-x-{i}-{k}"
                noisy[source].append([near, copy, addr.split(",")[0] if rng.random() < 0.3 else addr, country])
                truth.setdefault(split, {}).setdefault(f"{split}-1-{i}", []).append(near)
        for number, rows in ((1, own), *noisy.items()):
            write(folder / split / f"{split}_source{number}.tsv", tsv.RECORD, rows)
        write(folder / split / f"{split}_ground_truth.tsv", ["source1_entity_id", "matched_entity_ids"], [[k, ",".join(v)] for k, v in truth[split].items()])
    return truth


def test_from_tsv_to_matches(spark, tmp_path, capsys):
    truth = world(tmp_path / "data")
    main(["all", "--data-dir", str(tmp_path / "data"), "--work-dir", str(tmp_path / "work"), "--rounds", "4"], spark)
    assert "pair_recall" in capsys.readouterr().out
    got = {r.source1_entity_id: set(filter(None, r.matched_entity_ids.split(","))) for r in tsv.read_tsv(spark, str(tmp_path / "work/output/test_matches"), ["source1_entity_id", "matched_entity_ids"]).collect()}
    want = {k: set(v) for k, v in truth["test"].items()}
    hits, said = sum(len(got[k] & want[k]) for k in want), sum(map(len, got.values()))
    assert set(got) == set(want) and hits >= 0.9 * said and hits >= 0.7 * sum(map(len, want.values()))
    candidates = spark.read.parquet(str(tmp_path / "work/test/candidates"))
    sides = [spark.read.parquet(str(tmp_path / f"work/test/{t}")) for t in ("s1", "s23")]
    crossed = learning.named_pairs(candidates, *sides, ["country"]).where("country_1 <> country_23")
    assert candidates.count() and crossed.count() == 0  # each country is searched by itself


def test_sampling_and_order(spark):
    rows = spark.createDataFrame([(i, 10 * i + r, r) for i in range(30) for r in range(8)], "s1 long, s23 long, candidate_rank int")
    truth = spark.createDataFrame([(i, 10 * i + 7) for i in range(30)], "s1 long, s23 long")
    got = learning.hard_pairs(rows, truth, 10)
    assert got.count() == 70 and got.where("label = 1").count() == 10 and learning.used(rows, got, "s1").count() == 80
    texts = spark.createDataFrame([(w,) for w in ("a", "ccc", "bb", "")], "t string").coalesce(1)
    assert [r.t for r in learning.by_length(texts, "t").collect()] == ["ccc", "bb", "a", ""]
    ranged = blocking.by_quantiles(rows, "s1", 4).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("s1").alias("a"), F.max("s1").alias("b"), F.count("*").alias("n")).collect()
    assert len(ranged) == 4 and all(x.b < y.a for x, y in zip(sorted(ranged, key=lambda r: r.a), sorted(ranged, key=lambda r: r.a)[1:]))
    numbers = texts.select(F.explode(vectors.hashed(vectors.char_ngrams(F.lit("abc abc")), 10)).alias("g")).distinct().collect()
    assert 1 <= len(numbers) <= 3 and all(0 <= r.g < 1024 for r in numbers)


def test_running_sum(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(100)], "k long, v long").repartition(7)
    got = {r.k: r.before for r in blocking.running_before(rows, "v", "k", "before").collect()}
    assert all(got[k] == sum((i * 7) % 5 for i in range(k)) for k in range(100))
