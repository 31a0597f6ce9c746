"""Row-generating operators: sections, articles, chunks and windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import fixed
from quern.functions import text as t
from quern.storage import pieces

ARTICLE_START, CHAPTER_START, SECTION_TITLE = (f"(?U){p}" for p in (fixed.ARTICLE_START, fixed.CHAPTER_START, fixed.SECTION_TITLE))
#: Documents at least so long are cut into sections; shorter sections are dropped.
CHUNK_CHARS, SECTION_CHARS = 1800, 20
_ROWS = "array<struct<text: string, title: string, article_title: string, article_id: string, hierarchy: string>>"
#: Chunking tiers: words of a window, overlap, whether articles come first.
TIERS = {"article": (0, 0, True), "semantic": (512, 128, False), "long": (2048, 256, False)}


def _let(c: Column, f) -> Column:
    """``f`` of the column, computed once however often ``f`` names it (an expression that comes twice is evaluated twice)."""
    return F.transform(F.array(c), f)[0]


def sections(c: Column) -> Column:
    """E1. array<struct<title, article_id, content>>: the text before every article mark, or else every chapter mark."""
    parts = F.when(c.rlike(ARTICLE_START), F.split(c, f"(?={ARTICLE_START})")).otherwise(F.split(c, f"(?={CHAPTER_START})"))
    full = F.filter(F.transform(parts, t.strip), lambda s: s != "")

    def one(s: Column) -> Column:
        return _let(F.regexp_extract(s, SECTION_TITLE, 1), lambda title: F.struct(title.alias("title"), F.regexp_extract(title, r"(?U)^Điều\s+(\d+)", 1).alias("article_id"), t.strip(F.substring(s, F.length(title) + 1, F.length(s))).alias("content")))

    whole = F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("article_id"), c.alias("content")))
    return _let(full, lambda parts: F.when(F.size(parts) == 0, whole).otherwise(F.transform(parts, one)))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """E2. Long documents without an article become their sections; the others pass. ``docs`` has the corpus columns and
    an order column ``seq``; sections follow their document's place."""
    long = (F.col("article_id") == "") & (F.length("text") >= CHUNK_CHARS)
    marked = docs.withColumn("_sections", F.when(long, sections(F.col("text"))).otherwise(F.array()))
    whole = F.struct(F.lit(0).alias("part"), F.lit(False).alias("cut"), F.lit("").alias("title"), F.lit("").alias("article_id"), F.col("text").alias("content"))
    numbered = F.transform("_sections", lambda s, i: F.struct(i.alias("part"), F.lit(True).alias("cut"), s["title"].alias("title"), s["article_id"].alias("article_id"), s["content"].alias("content")))
    pieces = F.when(F.size("_sections") > 1, F.filter(numbered, lambda s: F.length(s["content"]) >= SECTION_CHARS)).otherwise(F.array(whole))
    tall = marked.select(*docs.columns, F.explode(pieces).alias("s"))
    cut = lambda new, old: F.when(F.col("s.cut"), new).otherwise(F.col(old))
    code = F.when(F.col("so_ky_hieu") != "", F.col("so_ky_hieu")).otherwise(t.doc_code(F.col("title")))
    chunk_id = F.concat("doc_id", F.lit("_art"), F.when(F.col("s.article_id") != "", F.col("s.article_id")).otherwise(F.col("s.part").cast("string")))
    title = F.when(F.col("s.title") != "", F.concat("title", F.lit(" - "), F.col("s.title"))).otherwise(F.col("title"))
    return tall.withColumns({"text": F.col("s.content"), "so_ky_hieu": cut(code, "so_ky_hieu"), "chunk_id": cut(chunk_id, "chunk_id"), "title": cut(title, "title"), "article_id": cut(F.col("s.article_id"), "article_id"), "part": F.col("s.part")}).drop("s")


def articles(content: Column, title: Column, number: Column, least: int = 20) -> Column:
    """E3. array<struct<text, title, article_title, article_id, hierarchy>> of line-structured text.

    Articles start at lines of an article mark with ``.`` or ``:``; what stands before the first is dropped. Without any
    article, and where all are shorter than ``least``, the document is one row.
    """
    body = t.strip(content)
    parts = F.filter(F.transform(F.split(body, r"\n(?=(?U:Điều\s+\d+\s*[.:]))"), t.strip), lambda p: p != "")
    start = r"(?U)^Điều\s+(\d+)\s*[.:]\s*([^\n]*)"

    def row(text: Column, own_title: Column, heading: Column, article: Column, path: Column) -> Column:
        return F.struct(text.alias("text"), own_title.alias("title"), heading.alias("article_title"), article.alias("article_id"), path.alias("hierarchy"))

    def article(p: Column) -> Column:
        heading = F.regexp_replace(t.strip(F.regexp_extract(p, start, 2)), r"^\d+\.\s*", "")
        named = lambda own: row(p, F.when(own["h"] == "", title).otherwise(F.concat(title, F.lit(" - Điều "), own["n"])), own["h"], F.concat(F.lit("Điều "), own["n"]), F.when(number != "", F.concat(number, F.lit("/"), own["n"])).otherwise(""))
        return _let(F.struct(F.regexp_extract(p, start, 1).alias("n"), heading.alias("h")), named)

    whole = lambda text: F.array(row(text, title, F.lit(""), F.lit(""), number))
    # of marked parts the long ones are taken before anything is made of them
    long = lambda parts: F.filter(parts, lambda p: F.length(p) >= least)
    made = lambda parts, marked: F.when((F.size(marked) == 0) & (F.size(parts) == 1), _let(long(parts), lambda one: F.when(F.size(one) == 0, F.array().cast(_ROWS)).otherwise(whole(one[0])))).otherwise(F.transform(long(marked), article))
    found = _let(parts, lambda own: _let(F.filter(own, lambda p: p.rlike(start)), lambda marked: made(own, marked)))
    return _let(found, lambda rows: F.when(F.size(rows) == 0, whole(content)).otherwise(rows))


def windows(c: Column, size: int, overlap: int) -> Column:
    """E6. Overlapping windows of words; the whole text if it has no more than ``size`` words (or ``size`` is 0).

    The last window is the first that reaches the last word.
    """
    if size == 0:
        return F.array(c)
    w = t.words(c)
    step = size - overlap
    last = F.ceil((F.size(w) - size) / F.lit(step)).cast("int") * step
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.when(F.size(w) <= size, F.array(c)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " ")))


def _cut_at_sentences(words: list[str], size: int, overlap: int) -> list[str]:
    out, at, n = [], 0, len(words)
    while True:
        end = min(at + size, n)
        text = " ".join(words[at:end])
        stop = text.rfind(".")
        if end < n and text[-1] not in ".!?" and stop > len(text) // 2:
            end = at + len(text[:stop].split(" ")) - (text[:stop].endswith(" ") or not text[:stop])
            text = " ".join(words[at:end])
        out.append(text)
        if end >= n:
            return out
        at = max(end - overlap, at + 1)


def sentence_windows(c: Column, size: int, overlap: int) -> Column:
    """E6 with sentence ends. Like :func:`windows`, but a window that is not the last and does not end with a sentence goes
    back to the last full stop in it, if that lies beyond its middle (in characters); the next one starts ``overlap`` words
    before the end, and at least one word on. The last window is the first that reaches the last word.

    Each window depends on the one before, so texts of more than one window go to Python.
    """
    if size == 0:
        return F.array(c)
    w = t.words(c)
    kind = pa.list_(pa.string())

    def run(texts: pa.Array) -> pa.Array:
        # words are listed a text at a time; what a batch holds is its texts, and their windows
        return pa.chunked_array([pa.array([None if x is None else _cut_at_sentences(x.split(" "), size, overlap) for x in part.to_pylist()], kind) for part in pieces(texts)], kind).combine_chunks()

    long = F.size(w) > size
    cut = F.arrow_udf(run, T.ArrayType(T.StringType()))
    return F.when(long, cut(F.when(long, F.array_join(w, " ")))).otherwise(F.array(c))


def chunks(docs: DataFrame, size: int, overlap: int, hierarchical: bool) -> DataFrame:
    """E4. ``docs``: (doc_id, title, text). Chunks with section, article_id and chunk_id: per article with windows of
    articles that are half as long again as a window, or windows of the whole text."""
    parts = docs.withColumn("_s", sections(F.col("text")) if hierarchical else F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("article_id"), F.col("text").alias("content"))))
    by_article = F.lit(hierarchical) & (F.size("_s") > 1)
    tall = parts.select("doc_id", "title", "text", by_article.alias("_by"), F.explode("_s").alias("s"), F.size("_s").alias("_n")) if hierarchical else parts.select("doc_id", "title", "text", by_article.alias("_by"), F.col("_s")[0].alias("s"), F.lit(1).alias("_n"))
    tall = tall.withColumn("_text", F.when(F.col("_by"), F.col("s.content")).otherwise(F.col("text")))
    small = F.col("_by") & ((F.lit(size) == 0) | (F.size(t.words(F.col("_text"))) <= 1.5 * size))
    pieces = tall.select("*", small.alias("_small"), F.posexplode(F.when(small, F.array("_text")).otherwise(windows(F.col("_text"), size, overlap))).alias("_j", "_piece"))
    head = F.concat("doc_id", F.lit("_art"), F.when(F.col("s.article_id") != "", F.col("s.article_id")).otherwise("0"))
    tail = F.concat(F.lit("_chunk"), F.col("_j").cast("string"))
    chunk_id = F.when(F.col("_small"), head).when(F.col("_by"), F.concat(head, tail)).otherwise(F.concat("doc_id", tail))
    empty = lambda c: F.when(F.col("_by"), F.col(c)).otherwise("")
    return pieces.select("doc_id", chunk_id.alias("chunk_id"), empty("s.article_id").alias("article_id"), "title", empty("s.title").alias("section"), F.col("_piece").alias("text"))


def tiered_chunks(docs: DataFrame) -> DataFrame:
    """E5. The chunks of the three tiers."""
    out = [chunks(docs, *spec).withColumn("tier", F.lit(name)) for name, spec in TIERS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def cross_references(chunks_: DataFrame, most_chunks: int = 20, most: int = 10) -> DataFrame:
    """E7. ``chunks_``: (query_id, rank, content). Up to ``most`` distinct references per query in the first 2000
    characters of the first ``most_chunks`` chunks, in the order of the text."""
    head = F.substring("content", 1, 2000)
    found = F.concat(*(F.regexp_extract_all(head, F.lit(f"(?U){p}"), F.lit(1)) for p in fixed.CROSS_REFERENCES))
    tall = chunks_.filter(F.col("rank") <= most_chunks).select("query_id", "rank", F.posexplode(found).alias("pos", "ref")).withColumn("ref", t.strip(F.col("ref")))
    first = tall.filter((F.length("ref") > 5) & (F.length("ref") < 200)).groupBy("query_id", "ref").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "ref"))).filter(F.col("n") <= most).select("query_id", "ref", "n")


def fan_out(queries: DataFrame) -> DataFrame:
    """E8. ``queries``: (query_id, query, expansions array). The query, then its expansions, blanks left out."""
    every = F.filter(F.concat(F.array("query"), F.coalesce("expansions", F.array().cast("array<string>"))), lambda q: t.clean_text(q) != "")
    return queries.select("query_id", F.posexplode(every).alias("query_order", "query"))
