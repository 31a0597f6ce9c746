"""What the registered queries share: a registry, tables, and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL of the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose i-th line starts with an article mark of number i."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Điều "), (i + 1).cast("string"), F.lit(". "), x))
    return documents(spark, sf_dir).withColumn("text", F.array_join(lines, "\n"))


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """A SQL table of literals."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


WORD = r"[\p{L}\p{N}_]"
#: CTE: structured documents.
STRUCTURED = "s AS (SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: 'Điều ' || i || '. ' || x), chr(10)) AS text FROM documents)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g'), ' '), lambda w: w <> '')"


def terms(text: str) -> str:
    """SQL: the search terms of a text."""
    return f"regexp_extract_all(lower({text}), '{WORD}{{2,}}')"
