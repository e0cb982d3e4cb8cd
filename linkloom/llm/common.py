"""What several corpus operators share: shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges whose components the driver finds in memory: 8 MB. More take rounds over tables.
IN_MEMORY = 1 << 19

_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only in local mode and where that setting is missing (tests) a temporary folder of this
    machine is made and recorded in the session, so that it is made once.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("linkloom.shared.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("linkloom.shared.dir", path)
    return path.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(spark: SparkSession, paths: list[str]) -> None:
    try:
        for path in paths:
            _drop(spark, path)
    except Exception:  # the JVM has gone before the interpreter
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_drop_all, spark, _written[app])
    _written[app].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    for path in {os.path.dirname(p) for p in df.inputFiles()}:
        if "/linkloom/" in path:
            _drop(df.sparkSession, path)


def sweep(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables written so far but those that ``keep`` reads: for long sessions, once results are stored."""
    held = {os.path.dirname(p) for df in keep for p in df.inputFiles()}
    app = spark.sparkContext.applicationId
    for path in list(_written.get(app, [])):
        if not any(h.endswith(path.split(":", 1)[-1].lstrip("/")) for h in held):
            _drop(spark, path)
            _written[app].remove(path)


def lean(run: Callable) -> Callable:
    """A map function for mapInArrow or mapInPandas that gives free memory back to the system when its
    task ends. Workers are reused: what one task held at its largest would stay with them."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def in_groups(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply run to frames that each hold many whole groups, sorted by keys.

    For small groups that is far cheaper than a call for each; a group must fit in memory, so
    callers cut large groups into blocks first.
    """

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held[keys] == held[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(held) - int(last[::-1].cumprod().sum())
            if cut:
                yield run(held.iloc[:cut].reset_index(drop=True))
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None:
            yield run(held)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, so that few bytes don't mean few tasks
    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(lean(whole), schema)


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, smallest vertex of each one's component) of the edges u, v."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        cross = x != y
        a, b, x, y = a[cross], b[cross], x[cross], y[cross]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return ids, ids[root]


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of an edge list: one row (id, root) per vertex, root the smallest id.

    Up to IN_MEMORY distinct edges are joined in the driver's memory. More take alternating large-star
    and small-star rounds until every vertex points at a root only. A round is joins and aggregates with map-side combining, so no vertex's neighbours are collected. A hub
    with a third of all edges is a hot join key; each aggregate is a table before it is joined, so
    both sides of a join are plain scans, which adaptive execution can split (or broadcast, if the
    aggregate's size allows). Every round ends in a table in the shared folder. Edges with a null
    end are ignored; self loops take no part in the rounds and keep their vertex in the result.
    """
    ids = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    # (u, v) with u > v: each vertex points at a smaller one
    whole = materialise(ids.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    if whole.count() <= IN_MEMORY:
        few = whole.toArrow()
        release(whole)
        found = roots_of(few["u"].to_numpy(), few["v"].to_numpy())
        return edges.sparkSession.createDataFrame(pa.table(dict(zip(("id", "root"), found))), "id long, root long")
    loops, now = whole.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("root")), whole.where("u <> v")
    first = True
    while True:
        # done if no vertex points at two others, or at one that itself points on
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        if ends.groupBy("id").agg(F.sum("out").alias("n_out"), F.max("in").alias("n_in")).where("n_out > 1 OR (n_out = 1 AND n_in = 1)").count() == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(after, name)
        for used in (low, large, least):
            release(used)
        if first:
            first = False  # the loops are read from this table at the end
        else:
            release(now)
        now = after
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")))
    return roots.unionByName(loops).groupBy("id").agg(F.min("root").alias("root"))
