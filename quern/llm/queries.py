"""The registered queries of this package: ``(spark, sf_dir) -> DataFrame`` over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bwt_dedup, chroma, kneser_ney, lexical, line_dedup, mixing, near_dedup, packing, quality, rules, substring_dedup, toxicity, vector_codes


#: Target weights of the mixing query, by language.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_docs(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_docs(spark, sf_dir), width=2)


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.report(_docs(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: what is cut, also for repeats inside its own text, and the other documents that keep it."""
    return substring_dedup.plan(_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_docs(spark, sf_dir), _table(spark, sf_dir, "labels"), TARGETS)


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.report(_table(spark, sf_dir, "conversations"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.report(_docs(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op7_line_dedup, op8_quality, op10_toxicity, op5_quality_rules, op6_best_fit_packing, op4_near_dedup, op1_kneser_ney, op9_substring_dedup, op3_mixing, op2_chroma, op11_suffix_dedup, op12_vector_codes, op13_lexical_search)}


#: DuckDB over the view ``documents``: all pairs of documents that share a shingle, and components by propagation.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE e.b > r.root),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": NEAR_SQL, "op7_line_dedup": line_dedup.ORACLE_SQL, "op11_suffix_dedup": bwt_dedup.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
