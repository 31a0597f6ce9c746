"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, mixing to target weights, best-fit packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of ``documents``. :func:`run` applies them to the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, near_dedup, packing, quality
from quern.llm.common import fresh, written
from quern.llm.queries import TARGETS


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged as texts without tokens; every row is
    judged by itself, so repeated rows and ids don't matter; labels of other documents don't count."""
    score = fresh("_score", docs.columns)
    model = quality.trained(docs, _labels(spark, sf_dir))
    return quality.scored(docs, model, name=score).filter(F.col(score) >= 0.3).select(*docs.columns)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents (rows) go; ``n_chars`` follows. Null texts stay null, also in ``n_chars``; a
    document whose lines all go stays, empty."""
    return line_dedup.drop_common_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five words, similarity of 0.8 or more. Null
    and empty texts, rows without an id, and rows that repeat a kept id and text stay."""
    return near_dedup.one_of_each(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the fitted rates say, at least once, so that languages reach their target weights. Rows that
    repeat an id have one rate; rows without an id come once; null and empty texts have no tokens and come as the prior says.
    What the fit reached can be had from :func:`quern.llm.mixing.fitted`."""
    covered = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("domain")).join(_labels(spark, sf_dir).select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    return mixing.mixed(docs, covered, TARGETS, least=1.0)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens. A null or empty text is its end token; every
    row is packed for itself."""
    return packing.packed(docs)


STAGES = [("quality", good_quality), ("line_dedup", common_lines), ("near_dedup", near_copies), ("mixing", target_weights), ("packing", sequences)]

#: SQL has no classifier of this kind, no MinHash and no tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
