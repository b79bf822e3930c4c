"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a reproducible shuffle, again and again (at most `repeats` times). A document's
virtual finish time is the source's cumulative size, this document included, over the source's target. All documents
are ranged by virtual time (each by the middle of its place) and the line is cut where the total budget is reached.

Defined cases: a null text has size 0; null sources form one source, ranked last; sources without words have target 0
and give nothing; repeated rows are documents of their own (their places in the shuffle come from id and text; rows equal in both are interchangeable); an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, settled, stage, table

ROWS_PER_CELL = 50_000
PLACES = 1 << 52


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """Per source: rank, weight, source_size, n_docs, target. One row per source, so the windows run over a small table.

    Water filling in closed form: in order of cap / weight, the first source whose fair share is under its cap fixes
    the level that all uncapped sources share by weight.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") - 1) % len(cycle) + 1).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("before")) / F.col("weights_left")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level)).withColumn("at", F.row_number().over(by))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("at"))).over(Window.partitionBy()))
    return s.select("source", "rank", "weight", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def fair_queue(sized: DataFrame, seed: int = 17, repeats: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds source_size, target, done (cumulative size in the source's shuffle) and times (rounds that the mix takes).

    sized: source, size, and key (any text or number that is its document's own) or else doc_id; further columns stay.
    Documents are ranged by the middle of their place in the line, the finish time less half of the size over the target:
    so a source ends as near to its target as whole documents allow. The line is cut before the document that would pass
    the budget.
    """
    src = stage(source_targets(sized, cycle, repeats), "sources")
    s = src.select(F.col("source").alias("src_"), "rank", "source_size", "n_docs", "target")
    d = sized.join(s, F.col("source").eqNullSafe(F.col("src_")), "inner").drop("src_")
    d = d.withColumn("u", shuffle_place(F.col("key" if "key" in sized.columns else "doc_id"), seed))
    # a source is cut into cells of the shuffle order, so that a hot source spreads over many tasks
    d = d.withColumn("cell", F.floor(F.col("u") / PLACES * F.ceil(F.col("n_docs") / ROWS_PER_CELL)))
    cells = d.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stage(cells.select("rank", "cell", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)).alias("ahead")), "cells")
    inside = Window.partitionBy("rank", "cell").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("done", F.sum("size").over(inside)).join(cells, ["rank", "cell"]).withColumn("done", F.col("done") + F.col("ahead")).drop("ahead")
    d = stage(d, "queued")

    middle = lambda r: (r * F.col("source_size") + F.col("done") - F.col("size") / 2) / F.col("target")
    total = src.agg(F.sum("source_size").alias("t"), F.sum("n_docs").alias("n")).first()
    budget, n = total["t"] or 0, total["n"] or 0
    ranges = max(1, repeats * n // ROWS_PER_CELL)
    line = d.where("size > 0").select("rank", "done", "size", F.explode(F.array(*[F.struct(F.lit(r).alias("round"), middle(F.lit(r)).alias("middle")) for r in range(repeats)])).alias("e")).select("*", "e.*").drop("e")
    line = line.withColumn("range", F.least(F.floor(F.col("middle") * ranges), F.lit(repeats * ranges)))
    sums = line.groupBy("range").agg(F.sum("size").alias("size"))
    sums = sums.withColumn("upto", F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    edge = sums.where(F.col("upto") > F.lit(budget)).orderBy("range").select("range", (F.col("upto") - F.col("size")).alias("before")).first()
    key = ["middle", "rank", "round", "done"]
    times = F.lit(0)
    if edge is not None:
        # only the range where the budget ends is sorted row by row
        last = line.where(F.col("range") == edge["range"]).withColumn("run", F.sum("size").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)))
        last = last.where(F.col("run") + edge["before"] <= F.lit(budget)).orderBy(*[F.col(k).desc() for k in key]).select(*key).first()
        for r in range(repeats):
            m = middle(F.lit(r))
            taken = F.floor(m * ranges) < edge["range"]
            if last is not None:
                mine = F.struct(m.alias("a"), F.col("rank").alias("b"), F.lit(r).alias("c"), F.col("done").alias("d"))
                ends = F.struct(F.lit(last["middle"]).alias("a"), F.lit(last["rank"]).alias("b"), F.lit(last["round"]).alias("c"), F.lit(last["done"]).alias("d"))
                taken = taken | ((F.floor(m * ranges) == edge["range"]) & (mine <= ends))
            times = times + F.when(taken, 1).otherwise(0)
    elif n:
        times = F.lit(repeats)
    return d.withColumn("times", F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0))


def shuffle_place(key: Column, seed: int) -> Column:
    """A document's place in its source's shuffle, 0 to PLACES: 52 bits of a digest of its key, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")


def sizes(docs: DataFrame, *further: str) -> DataFrame:
    """doc_id, source, size and a key of id and text: rows without an id or with a repeated one have places of their own."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return docs.select("doc_id", "source", *further, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def cut_points(queued: DataFrame, repeats: int = 3) -> DataFrame:
    """Of a fair queue, per source: how far down its shuffle each round is taken (one row per source)."""
    return queued.groupBy("source").agg(*[F.max(F.when(F.col("times") > r, F.struct("u", "size"))).alias(f"cut{r}") for r in range(repeats)])


def mix(docs: DataFrame, seed: int = 17, repeats: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs, each as often as it is taken.

    A round takes a source's shuffle down to one place, so rows are decided by their source's cut points, and texts are
    not shuffled (the cut points have one row per source; Catalyst broadcasts them while that is small). Rows that are equal
    in id and text share one place and are taken alike.
    """
    cuts = stage(cut_points(fair_queue(stage(sizes(docs), "sizes"), seed, repeats, cycle), repeats).withColumnRenamed("source", "src_"), "cuts")
    own = sizes(docs.select(F.struct("*").alias("row_"), "doc_id", "source", "text"), "row_")
    own = own.select("row_", "source", F.struct(shuffle_place(F.col("key"), seed).alias("u"), "size").alias("at_"))
    got = own.join(cuts, F.col("source").eqNullSafe(F.col("src_")))
    times = sum((F.coalesce(F.col("at_") <= F.col(f"cut{r}"), F.lit(False)).cast("int") for r in range(repeats)), F.lit(0))
    times = F.when(F.col("at_.size") > 0, times).otherwise(0)
    return got.withColumn("times_", times).where("times_ > 0").withColumn("round_", F.explode(F.sequence(F.lit(1), F.col("times_")))).select("row_.*")


@settled
def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = fair_queue(stage(sizes(table(spark, sf_dir, "documents")), "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source")
