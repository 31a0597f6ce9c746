"""Answer assembly: context, citations, used chunks, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT
from quern.functions import text as t


def context_gate(chunks: DataFrame, threshold: float = 0.95, least: int = 5, final: int = DEFAULT.final_top_k) -> DataFrame:
    """P9. Rows of at least ``threshold`` if there are ``least`` of them, else the first ``final``."""
    good = F.col("score") >= threshold
    n = F.count_if(good).over(Window.partitionBy("query_id"))
    return chunks.withColumn("_n", n).filter(F.when(F.col("_n") >= least, good).otherwise(F.col("rank") <= final)).drop("_n")


def _listed(chunks: DataFrame, line: Column, separator: str, name: str) -> DataFrame:
    """Lines of the first row of each (title, article), in order, labelled by their place before that."""
    first = chunks.groupBy("query_id", "doc_title", "article_id").agg(F.min_by(F.struct("rank", "content"), "rank").alias("c"))
    lines = first.select("query_id", F.struct(F.col("c.rank").alias("rank"), line.alias("line")).alias("l"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), separator).alias(name))


def _label(default: str) -> Column:
    title = F.when(F.col("doc_title") != "", F.col("doc_title")).otherwise(F.lit(default))
    return F.concat(F.lit("["), F.col("c.rank").cast("string"), F.lit("] "), title, F.when(F.col("article_id") != "", F.concat(F.lit(" - Điều "), "article_id")).otherwise(""))


def context(chunks: DataFrame, most: int = 1500) -> DataFrame:
    """R6. The text that a model gets: label and the first ``most`` characters of each distinct article."""
    return _listed(chunks, F.concat(_label("Văn bản"), F.lit("\n"), F.substring("c.content", 1, most)), "\n\n", "context")


def summary(chunks: DataFrame, most_chunks: int = 20, most: int = 300) -> DataFrame:
    """R7. One line for each distinct article among the first chunks."""
    return _listed(chunks.filter(F.col("rank") <= most_chunks), F.concat(_label("Văn bản"), F.lit(": "), F.translate(F.substring("c.content", 1, most), "\n", " ")), "\n", "summary")


def citations(answer: Column) -> Column:
    """R8. Distinct references in an answer, as written."""
    return F.array_distinct(F.transform(t.references(answer), lambda r: r["match"]))


def used(chunks: DataFrame, answers: DataFrame, final: int = DEFAULT.final_top_k, share: float = 0.98, strict: bool = False) -> DataFrame:
    """R9, P12, J14, W7. ``answers``: (query_id, answer). Of the first ``final`` rows those that the answer cites, and those
    of at least ``share`` of the first row's score; else the first row. With ``strict`` a cited number must end where the
    article's does."""
    w = Window.partitionBy("query_id").orderBy("rank")
    number = t.strip(F.replace(F.lower("article_id"), F.lit("điều"), F.lit("")))
    mark = F.concat(F.lit("điều "), number)
    text = F.lower("answer")
    found = F.contains(text, mark)
    if strict:
        found = found & F.rlike(text, F.concat(mark, F.lit("(?![0-9])")))
    cited = F.when(F.col("article_id") != "", found).otherwise((F.col("doc_title") != "") & F.contains("answer", F.col("doc_title")))
    marked = chunks.withColumn("_top", F.first("score").over(w)).filter(F.col("rank") <= final).join(answers, "query_id").withColumn("_used", F.coalesce(cited, F.lit(False)) | (F.col("score") >= F.col("_top") * share))
    none = ~F.max("_used").over(Window.partitionBy("query_id"))
    return marked.withColumn("_none", none).filter(F.col("_used") | (F.col("_none") & (F.col("rank") == 1))).drop("_top", "_used", "_none", "answer")


def relevant(used_chunks: DataFrame) -> DataFrame:
    """T30. Per query the sorted distinct keys ``code|title`` and ``code|title|article`` of used chunks."""
    title = t.clean_title(F.col("doc_title"))
    doc = F.when(F.col("doc_title") != "", F.concat_ws("|", "so_ky_hieu", title))
    article = F.when(F.col("article_id") != "", F.concat_ws("|", "so_ky_hieu", title, t.format_article(F.col("article_id"))))
    return used_chunks.groupBy("query_id").agg(F.sort_array(F.collect_set(doc)).alias("relevant_docs"), F.sort_array(F.collect_set(article)).alias("relevant_articles"))


def confidence(chunks: DataFrame) -> DataFrame:
    """A5. The highest score of each query, 0 without rows (``chunks`` may hold null scores for such queries)."""
    return chunks.groupBy("query_id").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"))


def predictions(used_chunks: DataFrame, most: int = 50) -> DataFrame:
    """T29, M6. Per query the first ``most`` distinct ``code#article`` in order of rank."""
    ids = used_chunks.withColumn("_id", t.corpus_id(F.col("so_ky_hieu"), F.col("article_id"))).filter("_id IS NOT NULL").groupBy("query_id", "_id").agg(F.min("rank").alias("rank"))
    return ids.groupBy("query_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "_id"))), lambda x: x["_id"]), 1, most).alias("predicted_articles"))


def api_rows(chunks: DataFrame) -> DataFrame:
    """P18. What the service returns for a chunk."""
    return chunks.select("query_id", "rank", "chunk_id", "doc_id", "article_id", F.col("doc_title").alias("title"), F.col("content").alias("text"), "score", "source", F.coalesce("so_ky_hieu", F.lit("")).alias("so_ky_hieu"))
