"""Sources: readers that bring each source's columns to corpus rows (S1-S13), sinks, and the registry.

Each function takes the raw DataFrames, so that any Spark source (Parquet, JSON, CSV, tables) can feed it; ``REGISTRY``
maps a source's name to its function, in order of priority; :func:`load_corpus` goes from paths to a corpus. Column names that differ between files are resolved by
candidates. Every result carries ``seq``, a stable order of its rows.

A scan has no order of its own: Spark packs larger files first. :func:`numbered` gives every row its place - files by name,
rows by their place in the file - and the readers take order, "the last row counts" and missing ids from it. Tables without
places are ordered by their ids.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as t
from quern.operators.corpus import build_corpus, extract_documents, join_metadata, keep_types, last_by_id, number_rows
from quern.schema import conform, existing, first_full, order_key
from quern.storage import complete, current, fingerprint, forget, note


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Parquet, JSON lines (bad lines are dropped) or CSV with a header, by the path's ending unless ``kind`` is given."""
    kind = kind or path.rstrip("/*").rsplit(".", 1)[-1]
    if kind in ("json", "jsonl"):
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    return spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)


#: The column of places: 1 for the first row of the first file.
NUMBER = "_row_place"


def numbered(df: DataFrame, kind: str = "parquet") -> DataFrame:
    """``df``, a table that :func:`read` gave, with the place of each row. Of Parquet only the rows of each file are counted;
    lines of other formats are dealt by ranges and counted (:func:`quern.operators.corpus.number_rows`)."""
    if kind != "parquet":
        places = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at_line": F.monotonically_increasing_id()})
        return number_rows(places, ["_file", "_block", "_at_line"]).withColumn(NUMBER, F.col("idx") + 1).drop("idx", "_file", "_block", "_at_line")
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    size = placed.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = size.select("_file", F.coalesce(F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # a row a file
    return placed.join(F.broadcast(before), "_file").withColumn(NUMBER, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def _place(df: DataFrame, id_col: Column, part: Column | int = 0, sub: Column | str = "") -> Column:
    """``seq``: by place, or by id where the table has none."""
    return order_key(F.col(NUMBER) if NUMBER in df.columns else id_col, part, sub).alias("seq")


def _numbers(df: DataFrame) -> list[str]:
    return [NUMBER] if NUMBER in df.columns else []


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces what is there; Spark commits whole results only."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, "json" if kind in ("json", "jsonl") else "parquet")(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """S15. What is at the path, built and written first if no whole table is there or ``force`` says so."""
    if force or not complete(spark, path):
        write(build(), path)
    return spark.read.parquet(path)


def _text(df: DataFrame, *names: str) -> Column:
    name = existing(df, *names)
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")


def _long(c: str, least: int) -> Column:
    return F.length(t.strip(F.col(c))) >= least


def phapdien(df: DataFrame) -> DataFrame:
    """S1, P5. Codified articles: code and type from the source note, article from the dotted id."""
    if not existing(df, "content_text", "text", "content"):
        raise ValueError(f"no text column among {df.columns}")
    own = df.select(_text(df, "content_text", "text", "content").alias("text"), _text(df, "article_id").alias("_a"), _text(df, "article_title").alias("_t"), _text(df, "record_id", "id").alias("_r"), _text(df, "source_note_text").alias("_n"), _text(df, "subject_id").alias("_s"), *_numbers(df)).filter(_long("text", 20))
    parts = F.split(F.when(F.startswith("_a", F.lit("Điều ")), F.substring("_a", 6, 10_000)).otherwise(F.col("_a")), r"\.")
    dotted = F.size(parts) >= 2
    code = first_full(F.regexp_extract("_n", f"(?U){fixed.NOTE_CODE}", 1), F.when(dotted, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")))
    kind = F.regexp_extract("_n", fixed.NOTE_TYPE, 1)
    heading = F.when(F.startswith("_t", F.lit("Điều ")) & (F.locate(". ", F.col("_t"), 6) > 0), F.substring(F.col("_t"), F.locate(". ", F.col("_t"), 6) + 2, F.length("_t"))).otherwise(F.col("_t"))
    out = own.withColumns({"so_ky_hieu": code, "_k": kind, "article_id": F.element_at(parts, -1), "_h": heading})
    title = F.when((F.col("_k") != "") & (F.col("so_ky_hieu") != ""), F.concat("_k", F.lit(" "), "so_ky_hieu")).otherwise(first_full(F.col("so_ky_hieu"), F.col("_h"), F.concat(F.lit("Điều "), F.col("article_id"))))
    ready = out.withColumns({"title": title, "text": t.clean_text(F.col("text")), "doc_id": F.concat(F.lit("phapdien_"), first_full(F.col("_s"), F.col("_r"))), "source": F.lit("phapdien")})
    return conform(ready, _place(ready, F.col("_r"), 0, F.col("_a")))


def _metadata(df: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Of each id the last row's fields, as text."""
    own = df.select(F.col(id_col).alias("id"), *(_text(df, c).alias(n) for c, n in fields.items()), *_numbers(df))
    return last_by_id(own, NUMBER if NUMBER in df.columns else None)


def _extracted(docs: DataFrame, source: str, least: int, article_only: bool) -> DataFrame:
    """The articles of documents with metadata, in the order of the documents."""
    named = docs.withColumn("title", first_full(F.col("title"), F.concat(F.lit("VB "), F.col("id").cast("string"))))
    out = extract_documents(named, source, least, article_only, _numbers(docs))
    return conform(out, _place(out, F.substring("doc_id", 6, 1_000_000), F.col("part")))


def vohuutridung(content: DataFrame, metadata: DataFrame, filtered: bool = True, article_only: bool = False, least: int = 20) -> DataFrame:
    """S3, J1. Documents with metadata: kept types only, or all, with empty fields where metadata are missing. Of an id's
    metadata the last row counts, and its type decides."""
    meta_id, content_id = existing(metadata, "id") or metadata.columns[0], existing(content, "id") or content.columns[0]
    meta = keep_types(_metadata(metadata, meta_id, {"title": "title", "legal_type": "legal_type", "document_number": "doc_number", "issuing_authority": "issuing_authority", "issuance_date": "issuance_date"}))
    body = content.select(F.col(content_id).alias("id"), _text(content, "content", "content_text", "text").alias("content"), *_numbers(content)).filter(_long("content", 30))
    docs = join_metadata(body, meta, inner=filtered).withColumnRenamed("legal_type", "doc_type")
    return _extracted(docs, "vohuutridung", least, article_only)


def th1nhng0(content: DataFrame, metadata: DataFrame, article_only: bool = True, unclosed: bool = True) -> DataFrame:
    """S4-S7, J2. HTML documents with metadata; ids meet as numbers. ``unclosed``: as in :func:`quern.functions.text.html_text`."""
    meta = _metadata(metadata, "id", {"title": "title", "loai_van_ban": "doc_type", "so_ky_hieu": "doc_number", "co_quan_ban_hanh": "issuing_authority", "ngay_ban_hanh": "issuance_date"})
    body = content.select("id", t.html_text(_text(content, "content_html"), unclosed).alias("content"), *_numbers(content)).filter(_long("content", 30))
    return _extracted(join_metadata(body, meta, inner=True), "th1nhng0", 20, article_only)


def uts_vlc(df: DataFrame) -> DataFrame:
    """S8."""
    out = df.select(F.col("id").cast("string").alias("_id"), _text(df, "title").alias("title"), _text(df, "content").alias("text"), *_numbers(df)).filter(_long("text", 20))
    ready = out.withColumns({"text": t.clean_text(F.col("text")), "title": first_full(F.col("title"), F.concat(F.lit("VB "), F.col("_id"))), "doc_id": F.concat(F.lit("utslvc_"), F.col("_id")), "source": F.lit("utslvc")})
    return conform(ready, _place(ready, F.col("_id")))


def kiencute(df: DataFrame) -> DataFrame:
    """S9. Pretraining documents with nested metadata; too short and too long ones go. A document without an id is named by
    its place, counted over all rows; in a table without places, by a hash of its text."""
    meta = lambda c: F.coalesce(F.col(f"metadata.{c}").cast("string"), F.lit(""))
    own = df.select(_text(df, "doc_content").alias("text"), meta("DocName").alias("title"), meta("Id").alias("_id"), meta("OrganName").alias("issuing_authority"), *_numbers(df))
    out = own.filter(_long("text", 30) & (F.length("text") <= 500_000))
    place = F.col(NUMBER).cast("string") if NUMBER in df.columns else F.concat(F.lit("n"), F.sha2("text", 256))
    out = out.withColumn("_id", first_full(F.col("_id"), place))
    ready = out.withColumns({"text": t.clean_text(F.col("text")), "title": first_full(F.col("title"), F.concat(F.lit("VB "), F.col("_id"))), "doc_id": F.concat(F.lit("kiencute_"), F.col("_id")), "source": F.lit("kiencute")})
    return conform(ready, _place(ready, F.col("_id")))


def pbgdpl(df: DataFrame) -> DataFrame:
    """S10. Questions and answers: the answer is the text, the question's first 200 characters the title."""
    out = df.select(F.col("item_id").cast("string").alias("_id"), _text(df, "question_text", "question").alias("question"), _text(df, "answer_text", "answer").alias("text"), *_numbers(df)).filter(_long("text", 20))
    ready = out.withColumns({"text": t.clean_text(F.col("text")), "title": first_full(F.substring("question", 1, 200), F.concat(F.lit("QA "), F.col("_id"))), "doc_id": F.concat(F.lit("pbgdpl_"), F.col("_id")), "source": F.lit("pbgdpl")})
    return conform(ready, _place(ready, F.col("_id")))


def relationships(df: DataFrame) -> DataFrame:
    """S6. The edge table as it is."""
    return df


@dataclass(frozen=True)
class Source:
    """S11. A source: its reader; the tables that it takes, in order; how the corpus build calls it; which tables ``max_docs``
    cuts, and at how many rows if nothing is said; whether the build completes its codes (P7) and cuts its texts (E2)."""

    reader: Callable[..., DataFrame]
    tables: tuple[str, ...]
    options: dict = field(default_factory=dict)
    cut: tuple[str, ...] = ()
    max_docs: int | None = None
    codes: bool = True
    sections: bool = True


#: Name -> source, in order of priority.
REGISTRY: dict[str, Source] = {
    "phapdien": Source(phapdien, ("articles",), cut=("articles",)),
    "vohuutridung": Source(vohuutridung, ("content", "metadata"), {"article_only": True, "least": 100}, cut=("content",), sections=False),
    "th1nhng0": Source(th1nhng0, ("content", "metadata"), {"article_only": False}, cut=("content", "metadata")),
    "utslvc": Source(uts_vlc, ("documents",), cut=("documents",)),
    "kiencute": Source(kiencute, ("documents",), cut=("documents",), max_docs=5000, codes=False, sections=False),
    "pbgdpl": Source(pbgdpl, ("items",), cut=("items",)),
}


def load_source(spark: SparkSession, name: str, paths: dict[str, str], max_docs: int | None = None, options: dict | None = None) -> DataFrame:
    """S1-S10, L9. The rows of a source whose tables lie at ``paths`` (table -> path, see :func:`read`). ``max_docs``: only so
    many rows, the first by their place. ``options``: of the reader, beside the registry's."""
    source = REGISTRY[name]
    most = max_docs or source.max_docs
    tables = []
    for table in source.tables:
        own = paths[table].rstrip("/*").rsplit(".", 1)[-1]
        rows = numbered(read(spark, paths[table]), own if own in ("json", "jsonl", "csv") else "parquet")
        tables.append(rows.filter(F.col(NUMBER) <= most) if most and table in source.cut else rows)
    return source.reader(*tables, **(source.options | (options or {})))


def load_sources(spark: SparkSession, paths: dict[str, dict[str, str]], names: list[str] | None = None, max_docs: int | None = None, options: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """S11. The named sources (all with paths, if none are named) in order of priority. Unknown names, and sources whose
    tables are missing or lack a column, are left out with a warning. ``options``: of the readers, by source."""
    out = {}
    for name in names or [n for n in REGISTRY if n in paths]:
        try:
            out[name] = load_source(spark, name, paths[name], max_docs, (options or {}).get(name))
        except (KeyError, ValueError, PySparkException) as e:
            warnings.warn(f"source {name} is left out: {type(e).__name__} {str(e)[:200]}", stacklevel=2)
    return {name: out[name] for name in REGISTRY if name in out}


def build_from(sources: dict[str, DataFrame]) -> DataFrame:
    """Q12, U1. The corpus of loaded sources, each completed and cut as its plan says."""
    plans = [REGISTRY[name] for name in sources]
    return build_corpus(list(sources.values()), codes=[p.codes for p in plans], sections=[p.sections for p in plans])


def load_corpus(spark: SparkSession, path: str, paths: dict[str, dict[str, str]] | None = None, names: list[str] | None = None, max_docs: int | None = None, max_chunks: int | None = None, force: bool = False) -> DataFrame:
    """S12, S15. The corpus at ``path``, built there from the sources first if nothing is there, if it was built from other
    files, names or ``max_docs`` than those now given, or if ``force`` says so; without ``paths`` what is there is taken.
    ``max_chunks``: only the first so many rows. Rows are read when they are asked for (:class:`quern.operators.corpus.Store`)."""
    known = {n: p for n, p in (paths or {}).items() if n in REGISTRY and (not names or n in names)}
    mark = ""
    for name, tables in sorted(known.items()):
        for table, at in sorted(tables.items()):
            try:
                mark += fingerprint(read(spark, at), source=name, table=table, max_docs=max_docs)
            except PySparkException:  # what can't be read is left out, with a warning, when the corpus is built
                mark += f"{name}.{table} missing"
    if force or not complete(spark, path) or (paths and not current(spark, f"{path}.mark", mark)):
        sources = load_sources(spark, paths or {}, names, max_docs)
        if not sources:
            raise ValueError("no source could be loaded")
        forget(spark, f"{path}.mark")
        write(build_from(sources), path)
        note(spark, f"{path}.mark", mark)
    corpus = spark.read.parquet(path)
    return corpus.filter(F.col("idx") < max_chunks) if max_chunks else corpus


def evaluation_set(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """S18, J4, A6. Queries with their sorted distinct references; none is an empty list."""
    refs = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("corpus_id")).alias("reference_articles"))
    return queries.select("query_id", "question").join(refs, "query_id", "left").withColumn("reference_articles", F.coalesce("reference_articles", F.array().cast("array<string>")))


def last_results(lines: DataFrame, order: str) -> DataFrame:
    """S19, W10. Of each query the last row in the given order."""
    return lines.groupBy("query_id").agg(F.max_by(F.struct(*(c for c in lines.columns if c != "query_id")), order).alias("_r")).select("query_id", "_r.*")
