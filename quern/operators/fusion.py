"""Rank fusion, gap-adaptive cut-offs, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT
from quern.functions import fixed
from quern.storage import written

#: Ranked rows up to which they are sent to all workers, to meet the corpus there.
BROADCAST = 500_000


def adaptive_cut(ranked: DataFrame, buffer: int = 5, ratio: float = 0.9, least: int = 3, most: int = 200) -> DataFrame:
    """F2. ``ranked``: (query_id, score, rank, ...). Each list is cut ``buffer`` places after its widest gap, which is
    sought in the first ``ratio`` of its gaps; lists of at most ``least`` rows stay."""
    w = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    gaps = ranked.withColumn("_gap", F.round(F.col("score") - F.lead("score").over(w), 12)).withColumn("_n", F.count("*").over(whole)).withColumn("_c", F.floor((F.col("_n") - 1) * ratio))
    widest = F.max(F.when(F.col("rank") <= F.col("_c"), F.struct(F.col("_gap"), -F.col("rank")))).over(whole)
    k = F.when(F.col("_n") <= least, F.col("_n")).when(F.col("_c") <= 0, F.lit(least)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), -widest["col2"] + buffer)))
    return gaps.withColumn("_k", k).filter(F.col("rank") <= F.col("_k")).drop("_gap", "_n", "_c", "_k")


def fuse(lists: list[tuple[DataFrame, float | Column]], top_k: int = 500, k: int = DEFAULT.rrf_k) -> DataFrame:
    """F1, A3. Weighted reciprocal-rank fusion of ranked lists: (query_id, idx, score, rank). Ties go to the row that
    comes first in the first list that has it."""
    parts = [df.select("query_id", "idx", ((F.lit(w) if isinstance(w, (int, float)) else w) / (k + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("at")) for i, (df, w) in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    summed = union.groupBy("query_id", "idx").agg(F.sum("s").alias("score"), F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "at")
    return summed.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top_k).drop("at")


def fuse_weighted(near: DataFrame, sparse: DataFrame, top_k: int) -> DataFrame:
    """:func:`fuse` of two lists whose rows carry the weights ``_wd`` and ``_ws`` of their query."""
    return fuse([(near, F.col("_wd")), (sparse, F.col("_ws"))], top_k)


def keyword_query(query: Column) -> Column:
    """P14. Whether a query names articles or documents."""
    return F.lower(query).rlike(f"(?U){fixed.KEYWORD_QUESTION}")


def situational_query(query: Column) -> Column:
    """P13. Whether a query asks about a situation, not about a term or a rule."""
    return ~F.lower(query).rlike(fixed.RULE_QUESTION)


def hydrate(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """J3. Ranked rows with their corpus rows: chunk columns of a retrieved chunk. Positions without a row are skipped."""
    have = set(corpus.columns)
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    rows = corpus.select("idx", F.coalesce(F.nullif(col("chunk_id"), F.lit("")), F.col("idx").cast("string")).alias("chunk_id"), F.coalesce(F.nullif(col("doc_id"), F.lit("")), F.col("idx").cast("string")).alias("doc_id"), col("article_id").alias("article_id"), col("title").alias("doc_title"), col("text").alias("content"), col("so_ky_hieu").alias("so_ky_hieu"))
    # few rows are found: they go to the corpus, whose texts then stay where they are
    found = written(ranked, "ranked")
    if found.limit(BROADCAST + 1).count() <= BROADCAST:
        found = F.broadcast(found)
    return found.join(rows, "idx").withColumns({"retrieval_score": F.col("score"), "source": F.lit("hybrid")})


def first_seen(chunks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """J8, W5. ``chunks``: (query_id, query_order, rank, chunk_id, ...). The first row of each chunk id in the order of
    (query_order, rank), without the chunk ids in ``seen``."""
    new = chunks if seen is None else chunks.join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("query_id", "chunk_id").orderBy("query_order", "rank")
    return new.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def boost(chunks: DataFrame, titles: DataFrame, factor: float = 1.2) -> DataFrame:
    """J9, F7. Scores of chunks whose document is among a query's matched ``titles`` (query_id, title) are multiplied."""
    hit = titles.select("query_id", F.col("title").alias("doc_title"), F.lit(True).alias("_hit")).distinct()
    return chunks.join(hit, ["query_id", "doc_title"], "left").withColumn("score", F.when(F.col("_hit"), F.col("score") * factor).otherwise(F.col("score"))).drop("_hit")


def only_matched(chunks: DataFrame, titles: DataFrame, least: int = 10) -> DataFrame:
    """P11. Of each query only the chunks of matched titles, if at least ``least`` remain; else all."""
    hit = titles.select("query_id", F.col("title").alias("doc_title"), F.lit(True).alias("_hit")).distinct()
    n = F.count("_hit").over(Window.partitionBy("query_id"))
    return chunks.join(hit, ["query_id", "doc_title"], "left").withColumn("_n", n).filter((F.col("_n") < least) | F.col("_hit").isNotNull()).drop("_hit", "_n")
