"""Queries over questions, what the service returns, and results that come as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import answer as a
from quern.operators import fusion
from quern.operators.rerank import reconstruct
from quern.queries.base import documents, query, table
from quern.queries.search import _HYBRID, _MERGED, _RERANK, _reranked
from quern.sources.readers import last_results
from quern.storage import shared_dir
from quern.streaming.streams import upsert_results

#: Questions about rules and terms, and about situations.
_FORMS = ["Điều kiện gì với ", "Khái Niệm ", "Tôi phải làm sao khi ", "Công ty muốn biết ", "THẾ NÀO là "]


@query(f"SELECT doc_id, NOT regexp_matches(lower([{', '.join(repr(x) for x in _FORMS)}][(doc_id % 5 + 1)::INT] || text), '{fixed.RULE_QUESTION}') AS situational FROM documents")
def situational(spark, sf_dir):
    """P13. Questions of five forms, each about a document's text."""
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", fusion.situational_query(F.concat(form, "text")).alias("situational"))


@query(f"WITH {_HYBRID}, {_RERANK}, {_MERGED} SELECT query_id, rank, 'merged_' || doc_title || '_' || article_id AS chunk_id, article_id, doc_title AS title, md5(content) AS text, round(score, 6) AS score, 'reconstructed' AS source, doc_title || '/' || article_id AS so_ky_hieu FROM rc")
def api_rows(spark, sf_dir):
    """P18. What the service returns for the chunks of every question."""
    rows = a.api_rows(reconstruct(_reranked(spark, sf_dir, 20)))
    return rows.select("query_id", "rank", "chunk_id", "article_id", "title", F.md5("text").alias("text"), F.round("score", 6).alias("score"), "source", "so_ky_hieu")


@query("SELECT conv_id AS query_id, coalesce(arg_max(role || turn, turn) FILTER (turn % 2 = 1), arg_max(role || turn, turn)) AS answer FROM conversations GROUP BY conv_id")
def stream_upsert(spark, sf_dir):
    """ST2, W10. Results of even turns, then of odd ones, as two batches of a stream: of each conversation the last batch's
    result counts."""
    at = shared_dir(spark)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.concat("role", F.col("turn").cast("string")).alias("answer"))
    for odd in (0, 1):
        last = turns.filter(F.col("turn") % 2 == odd).groupBy("query_id").agg(F.max_by("answer", "turn").alias("answer"))
        last.coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("query_id long, answer string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    upsert_results(stream, f"{at}/out", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return last_results(spark.read.parquet(f"{at}/out"), "batch").select("query_id", "answer")
