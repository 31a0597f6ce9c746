"""The corpus build: filters, enrichment, union in order, first-wins deduplication, statistics (P, J1-J2, U1, W4, A, L)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as t
from quern.operators.extract import articles, chunk_documents
from quern.schema import TEXTS, conform, empty_if_null, first_full, order_key
from quern.storage import written

LEAST_WORDS = 30


def keep_types(df: DataFrame, col: str = "legal_type") -> DataFrame:
    """P1, P2. Rows of the kept types; null and unlisted types are dropped."""
    return df.filter(F.col(col).isin(fixed.KEPT_TYPES))


def _meeting(c: Column) -> Column:
    """Ids as they meet: numeric ones as numbers, whatever their type."""
    return F.coalesce(c.cast("string").try_cast("bigint").cast("string"), c.cast("string"))


def last_by_id(metadata: DataFrame, order: str | None = None) -> DataFrame:
    """W10. Of rows that repeat an id the last, in the order of the column ``order`` (or as the table is scanned, which only a
    table of one file fixes); ids as text. ``order`` goes."""
    fields = [c for c in metadata.columns if c not in ("id", order)]
    placed = metadata.withColumn("_id", _meeting(F.col("id"))).withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
    last = placed.filter("_id IS NOT NULL").groupBy("_id").agg(F.max_by(F.struct(*fields), "_at").alias("_m"))
    return last.select(F.col("_id").alias("id"), *(F.col(f"_m.`{c}`").alias(c) for c in fields))


def join_metadata(content: DataFrame, metadata: DataFrame, inner: bool, order: str | None = None) -> DataFrame:
    """J1, J2. Content with its document's metadata by id; without ``inner``, rows without metadata stay with empty fields. Of
    metadata that repeat an id the last row counts (:func:`last_by_id`). Catalyst broadcasts the metadata if it is small."""
    fields = [c for c in metadata.columns if c not in ("id", order)]
    meta = last_by_id(metadata, order).withColumnRenamed("id", "_id")
    joined = content.withColumn("_id", _meeting(F.col("id"))).join(meta, "_id", "inner" if inner else "left").drop("_id")
    return joined if inner else joined.na.fill("", [c for c in fields if metadata.schema[c].dataType.simpleString() == "string"])


def extract_documents(docs: DataFrame, source: str, least: int = 20, article_only: bool = False, also: list[str] | None = None) -> DataFrame:
    """E3, P8. ``docs``: (id, title, content, doc_type, doc_number, issuing_authority, issuance_date). One row an article;
    with ``article_only`` documents without any article go. Columns named in ``also`` stay."""
    rows = articles(F.col("content"), F.col("title"), F.col("doc_number"), least)
    kept = docs.withColumn("_rows", rows)
    if article_only:
        kept = kept.filter(F.exists("_rows", lambda r: r["article_id"] != ""))
    tall = kept.select(F.concat(F.lit("tvpl_"), F.col("id").cast("string")).alias("doc_id"), F.lit(source).alias("source"), "doc_type", "doc_number", "issuing_authority", "issuance_date", *(also or []), F.posexplode("_rows").alias("part", "r"))
    return tall.select("r.*", "doc_id", "source", "doc_type", "doc_number", "issuing_authority", "issuance_date", "part", *(also or []))


def enrich_codes(df: DataFrame) -> DataFrame:
    """P7. ``so_ky_hieu``: what is there, else the document number, else the code in the title."""
    return df.withColumn("so_ky_hieu", first_full(F.col("so_ky_hieu"), F.col("doc_number"), t.doc_code(F.col("title"))))


def bare_article(c: Column) -> Column:
    """P6. Without the article mark in front."""
    return F.when(F.startswith(c, F.lit("Điều ")), t.strip(F.substring(c, 6, 1_000_000))).otherwise(c)


def dedup_key(df: DataFrame) -> DataFrame:
    """``key``: code and article, else the chunk id, else null (such rows are never duplicates)."""
    pair = (F.col("so_ky_hieu") != "") & (F.col("article_id") != "")
    return df.withColumn("key", F.when(pair, F.concat("so_ky_hieu", F.lit("||"), "article_id")).when(F.col("chunk_id") != "", F.col("chunk_id")))


def with_status(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """P4, W4, A10. ``status`` of each row: short (too few words; never registered), duplicate (a row of the same key comes
    before it, by ``seq``) or kept. Rows without a key are no duplicates.

    The rows are written once, with a number each. The first of a key comes from a partial aggregation, and meets the rows by
    its number, so neither a common key nor the rows without one come together in a task.
    """
    long = F.size(t.words(F.col("text"))) >= least_words
    keyed = written(dedup_key(rows.withColumn("article_id", bare_article(F.col("article_id")))).withColumns({"_long": long, "_row": F.monotonically_increasing_id()}), "keyed")
    first = keyed.filter(F.col("_long") & F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("seq", "_row")).alias("_first")).select(F.col("_first._row").alias("_row"), F.lit(True).alias("_is_first"))
    joined = keyed.join(first, "_row", "left")
    status = F.when(~F.col("_long"), "short").when(F.col("key").isNotNull() & F.col("_is_first").isNull(), "duplicate").otherwise("kept")
    return joined.withColumn("status", status).drop("_long", "_row", "_is_first")


def first_wins(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The kept rows of :func:`with_status`."""
    return with_status(rows, least_words).filter("status = 'kept'").drop("status", "key")


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``idx``: 0-based position in the given order, which must be total. Ranges of the order are sorted and written in
    parallel; the sizes of the ranges before a row's range are added to its place in it, so no task sees all rows."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = written(rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    # the id holds the range above its 33rd bit and the place in it below
    placed = ranged.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # a row for each range
    return placed.join(F.broadcast(before), "_range").withColumn("idx", F.col("_before") + F.col("_place")).drop("_at", "_range", "_place", "_before")


def build_corpus(sources: list[DataFrame], least_words: int = LEAST_WORDS, codes: list[bool] | None = None, sections: list[bool] | None = None) -> DataFrame:
    """U1. The sources in order of priority (each with corpus columns and an order column ``seq``, made by
    :func:`quern.schema.order_key` or of any type that it takes), enriched, cut into sections, filtered and deduplicated,
    with ``idx``. ``codes`` and ``sections`` say which sources are enriched and cut (all, if nothing is said). Rows that are
    equal in all columns are told apart by nothing; one of them stays if they have a key."""
    own = lambda s: F.col("seq") if s.schema["seq"].dataType.typeName() == "struct" else order_key(F.col("seq"))
    yes = [True] * len(sources)
    parts = None
    for k, (source, enriched, cut) in enumerate(zip(sources, codes or yes, sections or yes, strict=True)):
        rows = conform(source, F.struct(F.lit(k).alias("_source"), own(source).alias("_seq")).alias("seq"))
        rows = enrich_codes(rows) if enriched else rows
        rows = chunk_documents(rows) if cut else rows.withColumn("part", F.lit(0))
        parts = rows if parts is None else parts.unionByName(rows)
    # equal places happen where a source repeats a row: the text decides, so that the order is total
    ordered = parts.withColumn("seq", F.struct("seq._source", "seq._seq", "part", F.md5("text").alias("hash")))
    return number_rows(first_wins(ordered, least_words), ["seq"]).select("idx", *TEXTS)


def counters(kept: DataFrame, content: DataFrame, metadata: DataFrame) -> DataFrame:
    """A10. One row about an extraction: ``content`` (id) and ``metadata`` (id) that went in, ``kept`` (id, article_id) that
    came out: documents without metadata, documents with metadata but without any article, articles."""
    known = metadata.select(_meeting(F.col("id")).alias("_id"), F.lit(1).alias("_meta")).distinct()
    out = kept.filter("article_id != ''").groupBy(_meeting(F.col("id")).alias("_id")).agg(F.count("*").alias("_n"))
    docs = content.select(_meeting(F.col("id")).alias("_id")).join(known, "_id", "left").join(out, "_id", "left")
    met = F.col("_meta").isNotNull()
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(~met).alias("no_meta"), F.count_if(met & F.col("_n").isNull()).alias("no_articles"), F.coalesce(F.sum(F.when(met, F.col("_n"))), F.lit(0)).alias("n_articles"))


def statistics(corpus: DataFrame) -> DataFrame:
    """A1. Per source: rows, rows with an article, rows with a code; and the total (source null)."""
    return corpus.rollup("source").agg(F.count("*").alias("n"), F.count_if(F.col("article_id") != "").alias("with_article"), F.count_if(F.col("so_ky_hieu") != "").alias("with_code"))


def top_codes(corpus: DataFrame, most: int = 15) -> DataFrame:
    """L8. The most frequent codes, ties by first appearance."""
    return corpus.filter("so_ky_hieu != ''").groupBy("so_ky_hieu").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")).orderBy(F.desc("n"), "first_idx").limit(most)


def histogram(df: DataFrame, col: str) -> DataFrame:
    """A11. Rows of each value and the share of all rows in percent."""
    total = df.count()
    counts = df.groupBy(empty_if_null(col).alias(col)).agg(F.count("*").alias("n"))
    return counts.select(col, "n", (F.lit(100.0) * F.col("n") / F.lit(total)).alias("percent"))


def rows_at(corpus: DataFrame, positions: list[int]) -> DataFrame:
    """S13. Rows by position; negative positions count from the end."""
    n = corpus.agg(F.max("idx")).first()[0] if any(p < 0 for p in positions) else -1
    return corpus.filter(F.col("idx").isin([p if p >= 0 else n + 1 + p for p in positions]))


@dataclass
class Store:
    """S13. A corpus on disk by position: a folder for each range of ``width`` positions, and a manifest with the rows and the
    range. Rows, slices and the length open the folders that hold them only, and no row is held in memory."""

    spark: SparkSession
    path: str

    @classmethod
    def save(cls, corpus: DataFrame, path: str, width: int = 100_000) -> Store:
        """``corpus``: with ``idx``, 0, 1, 2, ... The manifest comes last."""
        spark = corpus.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = corpus.withColumn("_range", F.floor(F.col("idx") / width)).repartitionByRange(parts, "idx").sortWithinPartitions("idx")
        ranged.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
        count = spark.read.parquet(f"{path}/rows").count()
        spark.createDataFrame([(count, width)], "n long, width long").coalesce(1).write.mode("overwrite").parquet(f"{path}/size")
        return cls(spark, path)

    def _size(self) -> tuple[int, int]:
        r = self.spark.read.parquet(f"{self.path}/size").first()
        return r.n, r.width

    def __len__(self) -> int:
        return self._size()[0]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def __getitem__(self, at: int | slice | list[int]) -> DataFrame:
        """The rows at a position, in a slice or in a list of positions, as a table with ``idx``; negative positions count from
        the end. A position that isn't there raises IndexError; of a slice what is there counts."""
        n, width = self._size()
        if isinstance(at, slice):
            places = range(*at.indices(n))
            if not len(places):
                return self.rows().drop("_range").limit(0)
            low, high = min(places[0], places[-1]), max(places[0], places[-1])
            own = self.rows().filter(F.col("_range").between(low // width, high // width) & F.col("idx").between(low, high))
            return (own if abs(places.step) == 1 else own.filter((F.col("idx") - low) % abs(places.step) == 0)).drop("_range")
        places = [p if p >= 0 else n + p for p in (at if isinstance(at, list) else [at])]
        if any(not 0 <= p < n for p in places):
            raise IndexError(f"{at} of {n} rows")
        return self.rows().filter(F.col("_range").isin(sorted({p // width for p in places})) & F.col("idx").isin(places)).drop("_range")

    def __iter__(self) -> Iterator[Row]:
        """All rows in order, a range of positions in memory at a time."""
        n, width = self._size()
        for low in range(0, n, width):
            yield from self[low : low + width].orderBy("idx").toLocalIterator()


def batch(queries: DataFrame, number: int, size: int, key: str = "query_id") -> DataFrame:
    """L10. The rows of one batch in the order of ``key``."""
    return number_rows(queries, [key]).filter(F.col("idx").between(number * size, (number + 1) * size - 1)).drop("idx")
