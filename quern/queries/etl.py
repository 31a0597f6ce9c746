"""Queries over extraction and the corpus build."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import corpus as c
from quern.operators import extract as x
from quern.queries.base import STRIP, STRUCTURED, WORDS, documents, query, structured, table
from quern.schema import conform

_KEPT = ", ".join(f"'{k}'" for k in fixed.KEPT_TYPES)
_TYPE = "CASE WHEN quality = 0 THEN 'Quyết định' WHEN toxic = 1 THEN 'Công văn' ELSE 'Luật' END"


@query(f"SELECT d.doc_id, coalesce(legal_type, '') AS legal_type FROM documents d LEFT JOIN (SELECT doc_id, {_TYPE} AS legal_type FROM labels) m ON d.doc_id = m.doc_id AND m.legal_type IN ({_KEPT})")
def allowlist_join(spark, sf_dir):
    meta = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.expr(_TYPE).alias("legal_type"))
    content = documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return c.join_metadata(content, c.keep_types(meta), inner=False).select(F.col("id").alias("doc_id"), "legal_type")


_SECTIONS = rf"""
p AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(regexp_replace(text, '(Điều\s+\d+[.\s])', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS parts FROM s),
e AS (SELECT doc_id, source, text, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM p),
t AS (SELECT *, regexp_extract(part, '^(Điều\s+\d+[^.]*?\.|Chương\s+\w+[^.]*?\.|Mục\s+\w+[^.]*?\.)', 1) AS title FROM e),
sections AS (SELECT doc_id, source, text, n, pos, title, regexp_extract(title, '^Điều\s+(\d+)', 1) AS article_id, {STRIP.format('part[length(title) + 1:]')} AS content FROM t)"""


@query(f"WITH {STRUCTURED}, {_SECTIONS} SELECT doc_id, pos, title, article_id, md5(content) AS content FROM sections")
def split_sections(spark, sf_dir):
    return structured(spark, sf_dir).select("doc_id", F.posexplode(x.sections(F.col("text"))).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s.title", "s.article_id", F.md5("s.content").alias("content"))


@query(rf"""WITH {STRUCTURED},
p AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(regexp_replace({STRIP.format('text')}, '\n(Điều\s+\d+\s*[.:])', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS parts FROM s),
l AS (SELECT doc_id, source, text, list_filter(parts, lambda x: length(x) >= 20) AS parts FROM p),
e AS (SELECT doc_id, source, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM l WHERE len(parts) > 0),
f AS (SELECT *, regexp_extract(part, '^Điều\s+(\d+)\s*[.:]\s*([^\n]*)', 1) AS n, regexp_replace({STRIP.format("regexp_extract(part, '^Điều" + chr(92) + "s+(" + chr(92) + "d+)" + chr(92) + "s*[.:]" + chr(92) + "s*([^" + chr(92) + "n]*)', 2)")}, '^\d+\.\s*', '') AS heading FROM e)
SELECT doc_id, pos, 'Điều ' || n AS article_id, CASE WHEN heading = '' THEN source ELSE source || ' - Điều ' || n END AS title, heading AS article_title, lang_n AS hierarchy, md5(part) AS text FROM (SELECT f.*, doc_id || '/' || n AS lang_n FROM f)
UNION ALL SELECT doc_id, 0, '', source, '', doc_id::VARCHAR, md5(text) FROM l WHERE len(parts) = 0""")
def extract_articles(spark, sf_dir):
    rows = x.articles(F.col("text"), F.col("source"), F.col("doc_id").cast("string"))
    return structured(spark, sf_dir).select("doc_id", F.posexplode(rows).alias("pos", "r")).select("doc_id", F.col("pos").cast("long").alias("pos"), "r.article_id", "r.title", "r.article_title", "r.hierarchy", F.md5("r.text").alias("text"))


def _rows(spark, sf_dir):
    return conform(structured(spark, sf_dir).select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.col("source").alias("title"), "text", "source", F.col("doc_id").alias("seq")), "seq")


_CHUNKS = f"""{_SECTIONS},
chunks AS (
  SELECT 'doc_' || doc_id AS doc_id, doc_id AS seq, 0 AS part, '' AS chunk_id, '' AS article_id, source AS title, text, source FROM s WHERE length(text) < 1800 OR doc_id IN (SELECT doc_id FROM e WHERE n = 1)
  UNION ALL
  SELECT 'doc_' || doc_id, doc_id, pos, 'doc_' || doc_id || '_art' || CASE WHEN article_id <> '' THEN article_id ELSE pos::VARCHAR END, article_id, CASE WHEN title <> '' THEN source || ' - ' || title ELSE source END, content, source
  FROM sections WHERE length(text) >= 1800 AND n > 1 AND length(content) >= 20)"""


@query(f"WITH {STRUCTURED}, {_CHUNKS} SELECT doc_id, part, chunk_id, article_id, title, md5(text) AS text FROM chunks")
def chunk_documents(spark, sf_dir):
    return x.chunk_documents(_rows(spark, sf_dir)).select("doc_id", F.col("part").cast("long").alias("part"), "chunk_id", "article_id", "title", F.md5("text").alias("text"))


@query(f"""WITH w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents),
j AS (SELECT doc_id, w, unnest(generate_series(0, ceil((len(w) - 512) / 384.0)::BIGINT * 384, 384)) AS s FROM w WHERE len(w) > 512)
SELECT doc_id, s // 384 AS j, md5(array_to_string(w[s + 1:s + 512], ' ')) AS piece FROM j UNION ALL SELECT doc_id, 0, md5(text) FROM w WHERE len(w) <= 512""")
def window_chunks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(x.windows(F.col("text"), 512, 128)).alias("j", "p")).select("doc_id", F.col("j").cast("long").alias("j"), F.md5("p").alias("piece"))


def _windows(tier: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT '{tier}' AS tier, doc_id || '_chunk' || (s // {step}) AS chunk_id, '' AS article_id, '' AS section, md5(array_to_string(w[s + 1:s + {size}], ' ')) AS text FROM (SELECT doc_id, w, unnest(generate_series(0, ceil((len(w) - {size}) / {step}.0)::BIGINT * {step}, {step})) AS s FROM wd WHERE len(w) > {size})
UNION ALL SELECT '{tier}', doc_id || '_chunk0', '', '', md5(text) FROM wd WHERE len(w) <= {size}"""


@query(f"""WITH {STRUCTURED}, {_SECTIONS}, wd AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM s)
SELECT 'article' AS tier, doc_id || '_art' || CASE WHEN article_id <> '' THEN article_id ELSE '0' END AS chunk_id, article_id, title AS section, md5(content) AS text FROM sections WHERE n > 1
UNION ALL SELECT 'article', doc_id || '_chunk0', '', '', md5(text) FROM s WHERE doc_id IN (SELECT doc_id FROM e WHERE n = 1)
UNION ALL {_windows('semantic', 512, 128)} UNION ALL {_windows('long', 2048, 256)}""")
def tiered_chunks(spark, sf_dir):
    docs = structured(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), "text")
    return x.tiered_chunks(docs).select("tier", "chunk_id", "article_id", "section", F.md5("text").alias("text"))


def _coded(spark, sf_dir):
    """Rows whose key is (source, text)."""
    rows = documents(spark, sf_dir).select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.col("source").alias("so_ky_hieu"), F.concat(F.lit("Điều "), F.md5("text")).alias("article_id"), "text", "source", F.col("doc_id").alias("seq"))
    return conform(rows, "seq")


_STATUS = f"""k AS (SELECT doc_id, source, md5(text) AS h, len({WORDS.format('text')}) >= 30 AS long FROM documents),
st AS (SELECT doc_id, source, CASE WHEN NOT long THEN 'short' WHEN doc_id <> min(doc_id) FILTER (long) OVER (PARTITION BY source, h) THEN 'duplicate' ELSE 'kept' END AS status FROM k)"""


@query(f"WITH {_STATUS} SELECT doc_id, status FROM st")
def dedup_first_wins(spark, sf_dir):
    return c.with_status(_coded(spark, sf_dir)).select(F.col("seq").alias("doc_id"), "status")


@query(f"WITH {_STATUS} SELECT status, count(*) AS n FROM st GROUP BY status")
def dedup_counters(spark, sf_dir):
    return c.with_status(_coded(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {STRUCTURED}, {_CHUNKS},
o AS (SELECT *, CASE WHEN source < 'src5' THEN 0 ELSE 1 END AS src, len({WORDS.format('text')}) >= 30 AS long FROM chunks),
f AS (SELECT *, CASE WHEN chunk_id <> '' THEN row_number() OVER (PARTITION BY chunk_id ORDER BY src, seq, part) ELSE 1 END AS k FROM o WHERE long)
SELECT row_number() OVER (ORDER BY src, seq, part) - 1 AS idx, doc_id, chunk_id, article_id, md5(text) AS text FROM f WHERE k = 1""")
def build_corpus(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    built = c.build_corpus([rows.filter("source < 'src5'"), rows.filter("source >= 'src5'")])
    return built.select("idx", "doc_id", "chunk_id", "article_id", F.md5("text").alias("text"))


@query("SELECT source, count(*) AS n, count(*) FILTER (n_chars > 1800) AS with_article, count(*) FILTER (lang <> 'en') AS with_code FROM documents GROUP BY ROLLUP (source)")
def corpus_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source", F.when(F.col("n_chars") > 1800, "1").otherwise("").alias("article_id"), F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("so_ky_hieu"))
    return c.statistics(rows)


@query("SELECT source AS so_ky_hieu, count(*) AS n, min(doc_id) AS first_idx FROM documents GROUP BY source ORDER BY n DESC, first_idx LIMIT 15")
def top_codes(spark, sf_dir):
    return c.top_codes(documents(spark, sf_dir).select(F.col("doc_id").alias("idx"), F.col("source").alias("so_ky_hieu")))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang")
def type_histogram(spark, sf_dir):
    return c.histogram(documents(spark, sf_dir), "lang").withColumn("percent", F.round("percent", 6))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM conversations")
def number_rows(spark, sf_dir):
    return c.number_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", "turn", "idx")


@query(f"SELECT source AS so_ky_hieu, md5(text) AS article_id, 1 AS n FROM documents WHERE len({WORDS.format('text')}) >= 30 GROUP BY source, md5(text)")
def stream_dedup(spark, sf_dir):
    """First-wins deduplication as a stream over the documents, run to the end of what is there: rows of each key."""
    from quern.storage import shared_dir
    from quern.streaming.streams import dedup_stream

    at = shared_dir(spark)
    docs = documents(spark, sf_dir)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/documents.parquet*")
    rows = conform(stream.select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), F.col("source").alias("so_ky_hieu"), F.md5("text").alias("article_id"), "text", "source", F.col("doc_id").alias("seq")), "seq")
    dedup_stream(rows, all_keys=True).select("seq", "so_ky_hieu", "article_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("so_ky_hieu", "article_id").agg(F.count("*").alias("n"))
