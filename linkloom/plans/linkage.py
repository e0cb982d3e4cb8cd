"""From TSV files to matched lists: clean, search, pair features, a two-stage model, decisions.

A folder holds <split>/<split>_source{1,2,3}.tsv, and train/train_ground_truth.tsv. Every step is a
Parquet table in the work folder that a later run reads instead of computing it again.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import blocking, decisions, evaluation, features, learning, ranking, vectors
from linkloom.sources import tsv

METHODS = ["name_addr_fwd", "name_addr_rev"]
#: What stage two sees besides stage one's probability and the record features.
LIST = ["p1", "p_rank", "p_others_max", "p_others_sum", "n_sure_others", "prev_p", "next_p", "mass_above", "mass_below", "gap_prev", "gap_next"]


class Linkage:
    """One run over a data folder and a work folder."""

    def __init__(self, spark: SparkSession, data: str, work: str, *, rounds: int = 40, depth: int = 5, countries: list[str] | None = None):
        self.spark, self.data, self.work, self.rounds, self.depth, self.countries = spark, data, work, rounds, depth, countries

    def step(self, split: str, name: str, make) -> DataFrame:
        return tsv.saved_step(self.spark, f"{self.work}/{split}/{name}", make)

    def records(self, split: str) -> tuple[DataFrame, DataFrame]:
        """Both sides cleaned and numbered: (s1, ...) and (s23, source, ...)."""

        def clean(rows: DataFrame, number: str) -> DataFrame:
            rows = rows.where(F.col("country").isin(self.countries)) if self.countries else rows
            rows = tsv.with_row_number(rows, number).withColumn("parts", text.name_struct(text.basic_clean(F.col("business_name"))))
            return rows.select("*", "parts.*", text.clean_address(text.basic_clean(F.col("business_address"))).alias("addr_clean")).drop("parts")

        folder = f"{self.data}/{split}"
        return self.step(split, "s1", lambda: clean(tsv.read_source1(self.spark, folder, split), "s1")), self.step(split, "s23", lambda: clean(tsv.read_source23(self.spark, folder, split), "s23"))

    def weights(self, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """TF-IDF of both sides' names and addresses, each country by itself, and the countries' sizes."""
        s1, s23 = self.records(split)
        side = lambda rows, name, n: rows.select(F.lit(name).alias("side"), F.col(n).alias("id"), "country", F.concat_ws(" ", "name_core", "addr_clean").alias("t"))
        both = side(s1, "a", "s1").unionByName(side(s23, "b", "s23"))
        sizes = both.groupBy("country").agg(F.count("*").alias("n"))
        ids = ["side", "id", "country"]
        w = vectors.tfidf(vectors.postings(both, vectors.char_ngrams(F.col("t")), ids), sizes, ids, scope=["country"]).drop("n")
        one = w.where("side = 'a'").select(F.col("id").alias("s1"), "country", "gram", "w", "df")
        two = w.where("side = 'b'").select(F.col("id").alias("s23"), "country", "gram", "w", "df")
        return one, two.join(s23.select("s23", "source"), "s23"), sizes

    def candidates(self, split: str) -> DataFrame:
        def make() -> DataFrame:
            one, two, sizes = self.weights(split)
            hits = blocking.retrieve(one, two, scope=["country"], n_docs=sizes)
            return blocking.combine_and_trim(hits, METHODS)

        return self.step(split, "candidates", make)

    def truth(self) -> DataFrame:
        def make() -> DataFrame:
            s1, s23 = (rows.withColumnRenamed(n, f"{n}_row") for rows, n in zip(self.records("train"), ("s1", "s23")))
            pairs = tsv.ids_to_rows(tsv.read_ground_truth(self.spark, f"{self.data}/train/train_ground_truth.tsv"), s1, s23)
            return pairs.select(F.col("s1_row").alias("s1"), F.col("s23_row").alias("s23"))

        return self.step("train", "truth", make)

    def words(self) -> tuple[dict[str, str], list[str]]:
        """Spellings and noise words that the true pairs of the training split teach."""

        def make() -> DataFrame:
            s1, s23 = self.records("train")
            return learning.learn_words(learning.named_pairs(self.truth(), s1, s23, ["name_core"]).withColumnsRenamed({"name_core_1": "name1", "name_core_23": "name2"}))

        return learning.word_lists(self.step("train", "words", make))

    def features(self, split: str) -> DataFrame:
        def make() -> DataFrame:
            s1, s23 = self.records(split)
            word_map, noise = self.words()
            found = features.pair_features(self.candidates(split).join(s23.select("s23", "source"), "s23"), s1, s23, word_map, noise)
            fold = text.id_bucket(F.col("entity_id"))
            return found.join(s1.select("s1", fold.alias("bucket")), "s1").withColumn("fold", F.col("bucket") % 2)

        return self.step(split, "features", make)

    def stage_two(self, scored: DataFrame) -> DataFrame:
        """Stage one's probability p1 with its place among the record's and its list's neighbours."""
        return ranking.list_context(ranking.leave_one_out(scored, "p1"), "p1")

    def names(self, rows: DataFrame) -> list[str]:
        return [c for c, kind in rows.dtypes if c not in ("s1", "s23", "source", "bucket", "fold", "label", "p", "p1", *LIST) and kind != "string" and not kind.startswith("array")]

    def train(self) -> DataFrame:
        """Fit both stages, keep the models, and report the holdout: cross-fitted, so no record judges itself."""
        rows = self.features("train").join(self.truth().withColumn("label", F.lit(1.0)), ["s1", "s23"], "left").na.fill(0.0, ["label"])
        names, kw = self.names(rows), {"rounds": self.rounds, "depth": self.depth}
        learning.fit_gbdt(rows, names, **kw).write().overwrite().save(f"{self.work}/models/one")
        crossed = self.step("train", "stage_one", lambda: learning.cross_fit(rows, names, **kw).withColumnRenamed("p", "p1"))
        two = self.stage_two(crossed)
        learning.fit_gbdt(two, [*names, *LIST], **kw).write().overwrite().save(f"{self.work}/models/two")
        scored = self.step("train", "stage_two", lambda: learning.cross_fit(two, [*names, *LIST], **kw).select("s1", "s23", "p"))
        s1, _ = self.records("train")
        return evaluation.holdout(scored, self.candidates("train"), self.truth(), s1)

    def predict(self, split: str = "test") -> DataFrame:
        def make() -> DataFrame:
            rows = self.features(split)
            names = self.names(rows)
            one = learning.score(PipelineModel.load(f"{self.work}/models/one"), rows, names, "p1")
            return learning.score(PipelineModel.load(f"{self.work}/models/two"), self.stage_two(one), [*names, *LIST]).select("s1", "s23", "p")

        return self.step(split, "probabilities", make)

    def assign(self, split: str = "test", method: str = "threshold") -> DataFrame:
        """(source1_entity_id, matched_entity_ids) of every record, also written as TSV."""
        s1, s23 = self.records(split)
        pairs = decisions.keep_rule(self.predict(split)) if method == "threshold" else decisions.decide(self.predict(split), method)
        named = pairs.join(s23.select("s23", "entity_id"), "s23")
        lists = tsv.id_lists(s1.select("s1", F.col("entity_id").alias("source1_entity_id")), named, s1_key="s1", id_col="entity_id", order_col="entity_id", name="matched_entity_ids").drop("s1")
        tsv.write_tsv(lists, f"{self.work}/output/{split}_matches")
        return lists

    def diagnose(self) -> DataFrame:
        """How many true pairs the candidate lists hold, by length of the list."""
        return blocking.recall_variants(self.candidates("train"), self.truth())
