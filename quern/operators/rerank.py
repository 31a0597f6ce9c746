"""Reranking and reconstruction (R1-R5). ``chunks``: (query_id, rank, article_id, doc_title, content, score, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators.models import PairModel, score_pairs


def overlap_logit(query: Column, content: Column) -> Column:
    """A stand-in scorer: four times the share of the query's distinct terms that the content has, minus two."""
    q = F.array_distinct(t.terms(query))
    share = F.size(F.array_intersect(q, t.terms(content))) / F.greatest(F.size(q), F.lit(1))
    return 4 * share - 2


def _by_rank(chunks: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_old")
    return chunks.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).drop("_old")


def rerank(chunks: DataFrame, k: int = 50, scorer: Callable[[Column, Column], Column] | PairModel = overlap_logit) -> DataFrame:
    """R1, R2, W6, L4. The scorer's logits over (query, truncated content), as probabilities stretched to 0..1 within each
    query; a single candidate keeps its probability, equal ones become 0. Ties keep their order. A scorer is an expression, or
    a model that takes batches of pairs."""
    if isinstance(scorer, PairModel):
        chunks, logit = score_pairs(chunks, scorer, out="_logit"), F.col("_logit")
    else:
        logit = scorer(F.col("query"), t.truncate_at_word(F.col("content")))
    p = 1 / (1 + F.exp(-logit))
    w = Window.partitionBy("query_id")
    low, high, n = F.min("_p").over(w), F.max("_p").over(w), F.count("*").over(w)
    score = F.when(n == 1, F.col("_p")).when(high - low > 1e-12, (F.col("_p") - low) / (high - low)).otherwise(0.0)
    return _by_rank(chunks.withColumn("_p", p).withColumn("score", score).withColumns({"rerank_score": F.col("score"), "_old": F.col("rank")}).drop("_p", "_logit"), k)


def rerank_by_choice(chunks: DataFrame, chosen: Callable[[DataFrame], DataFrame], k: int = 30, batch: int = 15) -> DataFrame:
    """R3, L5. Batches of ``batch`` candidates go to ``chosen``, which takes rows with ``batch`` and ``place`` (0-based) and
    returns (query_id, batch, reply) - 1-based positions as text; chosen rows score 1, others 0."""
    placed = chunks.withColumns({"batch": F.floor((F.col("rank") - 1) / batch), "place": F.pmod(F.col("rank") - 1, F.lit(batch))})
    replies = chosen(placed).select("query_id", "batch", t.number_list(F.col("reply"), batch).alias("_picks"))
    hit = F.coalesce(F.array_contains("_picks", F.col("place").cast("int")), F.lit(False))
    scored = placed.join(replies, ["query_id", "batch"], "left").withColumn("score", hit.cast("double")).withColumns({"rerank_score": F.col("score"), "_old": F.col("rank")})
    return _by_rank(scored.drop("batch", "place", "_picks"), k)


def two_stage(chunks: DataFrame, chosen: Callable[[DataFrame], DataFrame], k: int = 30, scorer: Callable[[Column, Column], Column] = overlap_logit) -> DataFrame:
    """R4. The first to twice ``k``, the second to ``k``."""
    return rerank_by_choice(rerank(chunks, 2 * k, scorer), chosen, k)


def reconstruct(chunks: DataFrame) -> DataFrame:
    """R5, A4, L6. Chunks of one article become one row: contents joined in order of rank (if shorter than 50 characters,
    the first one's), the highest score, the other fields of the first. Ties: articles before rows without one."""
    fields = ["doc_id", "so_ky_hieu", "retrieval_score", "rerank_score", "content"]
    own = [f for f in fields if f in chunks.columns]
    merged = chunks.filter("article_id != ''").groupBy("query_id", "doc_title", "article_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("_all"), F.max("score").alias("score"), F.min_by(F.struct(*own), "rank").alias("_first"), F.min("rank").alias("_old"))
    text = F.array_join(F.transform("_all", lambda x: x["content"]), "\n")
    articles = merged.select("query_id", F.concat(F.lit("merged_"), "doc_title", F.lit("_"), "article_id").alias("chunk_id"), "doc_title", "article_id", *(F.col(f"_first.{f}").alias(f) for f in own if f != "content"), F.when(F.length(text) < 50, F.col("_first.content")).otherwise(text).alias("content"), "score", F.lit("reconstructed").alias("source"), F.lit(0).alias("_plain"), "_old")
    plain = chunks.filter("article_id = ''").select("query_id", "chunk_id", "doc_title", "article_id", *(f for f in own if f != "content"), "content", "score", "source", F.lit(1).alias("_plain"), F.col("rank").alias("_old"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "_plain", "_old")
    return articles.unionByName(plain).withColumn("rank", F.row_number().over(w).cast("long")).drop("_plain", "_old")
