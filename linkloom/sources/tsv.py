"""Tab-separated sources and sinks, and resumable Parquet steps."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = ["entity_id", "business_name", "business_address", "country"]


def read_tsv(spark: SparkSession, path: str, columns: list[str] = RECORD, select: list[str] | None = None) -> DataFrame:
    """All columns are text, quotes are ordinary characters, `NA` stays text, an empty cell is "".

    The first line is a header and is skipped in every file. select prunes columns at the scan.
    """
    rows = spark.read.options(sep="\t", header=True, quote="", nullValue="\u0000", enforceSchema=True).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    return rows.na.fill("").select(*(select or columns))


def source_file(folder: str, split: str, number: int) -> str:
    return f"{folder}/{split}_source{number}.tsv"


def read_source1(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return read_tsv(spark, source_file(folder, split, 1))


def read_source23(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Both noisy sources with a column that tells them apart."""
    two, three = (read_tsv(spark, source_file(folder, split, n)).withColumn("source", F.lit(n)) for n in (2, 3))
    return two.unionByName(three)


def truth_pairs(rows: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids as a comma list) to one row per pair."""
    ids = rows.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("entity_id"))
    return ids.select("source1_entity_id", F.trim("entity_id").alias("entity_id")).where("entity_id <> ''").distinct()


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_pairs(read_tsv(spark, path, ["source1_entity_id", "matched_entity_ids"]))


def ids_to_rows(pairs: DataFrame, s1: DataFrame, s23: DataFrame) -> DataFrame:
    """Id pairs to row pairs; ids that neither table knows are dropped."""
    return pairs.join(s1.select(F.col("entity_id").alias("source1_entity_id"), "s1_row"), "source1_entity_id").join(s23.select("entity_id", "s23_row"), "entity_id").select("s1_row", "s23_row")


def id_lists(s1: DataFrame, pairs: DataFrame, *, s1_key: str, id_col: str, order_col: str, name: str) -> DataFrame:
    """Per S1 record the comma list of its distinct partners in order; records without one keep "".

    A list holds a record's answers, so its length is bounded by the candidates kept per record.
    """
    per = pairs.groupBy(s1_key, id_col).agg(F.min(order_col).alias("_at")).groupBy(s1_key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(id_col).cast("string").alias("_id")))).alias("_all"))
    listed = F.array_join(F.transform("_all", lambda x: x["_id"]), ",")
    return s1.join(per, s1_key, "left").select(*s1.columns, F.coalesce(listed, F.lit("")).alias(name))


def write_tsv(rows: DataFrame, path: str, order_by: str | None = None) -> None:
    """A header and verbatim cells; with order_by in that order over all part files."""
    rows = rows.orderBy(order_by).drop(order_by) if order_by else rows
    rows.write.mode("overwrite").options(sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="").csv(path)


def saved_step(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
    """Run a step once: read its Parquet if a finished run left one, else make and write it."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        writer = make().write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def trim_saved(rows: DataFrame, k: int, rank: str = "candidate_rank") -> DataFrame:
    """A saved candidate table cut to fewer candidates, without searching again."""
    return rows.where(F.col(rank) < k)


def with_row_number(rows: DataFrame, name: str, order_by: str = "entity_id") -> DataFrame:
    """Row numbers 0..n-1 in the key's order, from counts per range partition (no single-task window)."""
    ranged = rows.repartitionByRange(order_by).sortWithinPartitions(order_by).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").count()
    start = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row per partition
    number = F.row_number().over(Window.partitionBy("_p").orderBy(order_by)) - 1
    return ranged.join(start, "_p").withColumn(name, (F.col("_start") + number).cast("long")).drop("_p", "_start")


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_json(path: str, value) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)


def write_report(rows: DataFrame, path: str, limit: int | None = None) -> str:
    """A small table as a Markdown file on the driver; limit guards the driver."""
    rows = rows.limit(limit) if limit else rows
    got = rows.collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path
