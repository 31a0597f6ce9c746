"""The one schema of corpus rows, and helpers that bring rows to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text columns of a corpus row; a missing value is the empty string, never null.
TEXTS = ["text", "title", "doc_id", "article_id", "so_ky_hieu", "source", "chunk_id", "article_title", "doc_type", "doc_number", "issuing_authority", "issuance_date", "hierarchy", "question"]


def empty_if_null(c: Column | str) -> Column:
    """Null counts as the empty string."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_full(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def conform(df: DataFrame, *extra: str) -> DataFrame:
    """The corpus columns in order, empty where ``df`` lacks them; ``extra`` columns (such as ``seq``) follow."""
    have = set(df.columns)
    return df.select(*(empty_if_null(F.col(c).cast("string")).alias(c) if c in have else F.lit("").alias(c) for c in TEXTS), *extra)


#: Where a row stands in its source: the id as a number (text ids after all numbers), as text, the part of the document,
#: and what tells rows of one id apart.
ORDER = "struct<number:bigint,id:string,part:int,sub:string>"


def order_key(id_col: Column, part: Column | int = 0, sub: Column | str = "") -> Column:
    """The value of ``seq``: typed parts of any length, which sort as numbers where they are numbers."""
    text = id_col.cast("string")
    number = F.coalesce(text.try_cast("bigint"), F.lit(2**63 - 1))
    return F.struct(number.alias("number"), empty_if_null(text).alias("id"), (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"), (F.lit(sub) if isinstance(sub, str) else sub).alias("sub"))


def existing(df: DataFrame, *candidates: str) -> str | None:
    """The first candidate that is a column of ``df``."""
    return next((c for c in candidates if c in df.columns), None)
