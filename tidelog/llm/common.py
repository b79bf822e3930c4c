"""Helpers shared by the training-data operators: shared-folder staging, table access, word expressions."""

from __future__ import annotations

import contextvars
import functools
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space and U+0009..U+000D.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
OWN_SHARED = "/tmp/checkpoints/tidelog"
#: Folders staged by this driver, as far as no query of its own scope deletes them.
_staged: list[str] = []
_scope: contextvars.ContextVar[list[str]] = contextvars.ContextVar("staged", default=_staged)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where it is unset, a local one of our own, in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = OWN_SHARED
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidelog-stage/{uuid.uuid4().hex}/{name}"
    _scope.get().append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation, and the reread table has a known size, so Catalyst
    broadcasts it only when it is under the session's threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged tables: the given ones, else all of this driver's. Results that still read them must be written before."""
    paths = _staged if paths is None else paths
    while paths:
        drop_path(spark, paths.pop().rpartition("/")[0])


def settle(spark: SparkSession, make, name: str) -> tuple[DataFrame, str]:
    """The table that make() returns, staged, and its folder; all that make() stages on the way is deleted."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        made = make()
        _scope.reset(token)
        return stage(made, name), _scope.get()[-1]
    finally:
        if _scope.get() is mine:
            _scope.reset(token)
        release(spark, mine)


def settled(query):
    """A query that stages its result and deletes all that it staged on the way, whatever other queries run beside it."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        return settle(spark, lambda: query(spark, *args), "result")[0]

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (null for a null id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def unit_hash(*cols, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


def component_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b) as (node, component); component is the smallest node reachable.

    Alternating large-star and small-star passes on the edge list only (isolated nodes never move): every pass is one
    aggregation by node plus one join, a hub's neighbours are never collected, and each pass is cut by a staged table.
    The number of passes grows with the logarithm of the longest chain.
    """
    e = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours hang on the smallest one
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: smaller neighbours and the node itself hang on the smallest one
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        nxt = stage(small.where(F.col("u") != F.col("v")).distinct(), "edges")
        # done when every node has one parent and no parent has a parent
        roots = nxt.select(F.col("v").alias("u")).distinct()
        dup = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
        done = nxt.join(roots, "u", "left_semi").unionByName(nxt.join(dup, "u", "left_semi")).isEmpty()
        e = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return nodes.select("node").distinct().join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
