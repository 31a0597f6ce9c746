"""Queries over sources, laws and the corpus build, on tables derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import corpus as c
from quern.operators import extract as x
from quern.operators import lawmatch
from quern.queries.base import STRIP, STRUCTURED, WORDS, documents, query, structured, table
from quern.sources import readers
from quern.storage import written

_SPACED = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


def _codified(spark, sf_dir):
    """Codified articles: dotted or plain ids, source notes for every second one, ids of more than twenty characters."""
    i = F.col("doc_id")
    return documents(spark, sf_dir).select(
        F.concat(F.lit("record-of-the-codified-articles-"), i).alias("record_id"),
        F.when(i % 3 == 0, F.concat(F.lit("Điều 1."), (i % 9).cast("string"), F.lit(".LQ."), (i % 5).cast("string"))).when(i % 3 == 1, F.concat((i % 4).cast("string"), F.lit("."), (i % 7).cast("string"))).otherwise(F.concat(F.lit("Điều "), (i % 6).cast("string"))).alias("article_id"),
        F.concat(F.lit("Điều 8. "), "source").alias("article_title"), F.col("text").alias("content_text"),
        F.when(i % 2 == 0, F.concat(F.lit("Nghị định số "), (i % 11).cast("string"), F.lit("/2019/NĐ-CP"))).otherwise("").alias("source_note_text"), F.lit("").alias("subject_id"))


# an id without a dot and without the article mark's prefix stays whole
_PHAPDIEN = rf"""
raw AS (SELECT doc_id, 'record-of-the-codified-articles-' || doc_id AS rid, CASE doc_id % 3 WHEN 0 THEN 'Điều 1.' || (doc_id % 9) || '.LQ.' || (doc_id % 5) WHEN 1 THEN (doc_id % 4) || '.' || (doc_id % 7) ELSE 'Điều ' || (doc_id % 6) END AS aid, source, text, CASE WHEN doc_id % 2 = 0 THEN 'Nghị định số ' || (doc_id % 11) || '/2019/NĐ-CP' ELSE '' END AS note FROM documents WHERE length({STRIP.format('text')}) >= 20),
dot AS (SELECT *, string_split(regexp_replace(aid, '^Điều ', ''), '.') AS parts FROM raw),
ph0 AS (SELECT *, parts[-1] AS article_id, CASE WHEN note <> '' THEN regexp_extract(note, 'số (.*)', 1) WHEN len(parts) >= 2 THEN array_to_string(parts[1:len(parts) - 1], '.') ELSE '' END AS code FROM dot),
ph AS (SELECT 'phapdien_' || rid AS doc_id, rid, aid, article_id, code AS so_ky_hieu, CASE WHEN note <> '' THEN 'Nghị định ' || code WHEN code <> '' THEN code ELSE source END AS title, {_SPACED.format('text')} AS text FROM ph0)"""


@query(f"WITH {_PHAPDIEN} SELECT doc_id, article_id, so_ky_hieu, title, md5(text) AS text FROM ph")
def source_phapdien(spark, sf_dir):
    return readers.phapdien(_codified(spark, sf_dir)).select("doc_id", "article_id", "so_ky_hieu", "title", F.md5("text").alias("text"))


def _acts(spark, sf_dir):
    """Documents whose articles come again after four (so a code and an article come again within a document, and in other
    documents of the source), and their metadata, whose ids are text with zeros in front."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("Điều "), ((i + 1) % 4).cast("string"), F.lit(". "), s))
    number = F.col("doc_id") + 10**15
    content = documents(spark, sf_dir).select(number.alias("id"), F.array_join(lines, "\n").alias("content"))
    kinds = F.when(F.col("lang") == "en", "Luật").when(F.col("lang") == "de", "Công văn").otherwise("Nghị định")
    meta = documents(spark, sf_dir).select(F.lpad(number.cast("string"), 24, "0").alias("id"), F.concat(F.lit("Văn bản "), "source").alias("title"), kinds.alias("legal_type"), F.concat("source", F.lit("/2020")).alias("document_number"))
    return content, meta


_ACTS = rf"""
ac AS (SELECT 1000000000000000 + doc_id AS id, doc_id AS n, source, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: 'Điều ' || (i % 4) || '. ' || x), chr(10)) AS content FROM documents),
ap AS (SELECT *, list_filter(list_transform(string_split(regexp_replace({STRIP.format('content')}, '\n(Điều\s+\d+\s*[.:])', chr(1) || '\1', 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND length(x) >= 20) AS parts FROM ac WHERE lang <> 'de' AND length({STRIP.format('content')}) >= 30),
ae AS (SELECT id, source, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS part, true AS art FROM ap WHERE len(parts) > 0 UNION ALL SELECT id, source, content, 0, false FROM ap WHERE len(parts) = 0),
vo AS (SELECT id, part, 'tvpl_' || id AS doc_id, CASE WHEN art THEN regexp_extract(text, '^Điều\s+(\d+)', 1) ELSE '' END AS article_id, source || '/2020' AS so_ky_hieu, text FROM ae)"""


@query(f"WITH {_ACTS} SELECT doc_id, part, article_id, md5(text) AS text FROM vo")
def source_vohuutridung(spark, sf_dir):
    """Ids of content are numbers, those of metadata text with zeros in front."""
    rows = readers.vohuutridung(*_acts(spark, sf_dir))
    return rows.select("doc_id", F.col("seq.part").cast("long").alias("part"), c.bare_article(F.col("article_id")).alias("article_id"), F.md5("text").alias("text"))


@query(rf"""WITH {_PHAPDIEN}, {_ACTS},
every AS (SELECT 0 AS src, rid AS a, aid AS b, 0::BIGINT AS id, 0 AS part, doc_id, article_id, so_ky_hieu, text FROM ph
  UNION ALL SELECT 1, '', '', id, part, doc_id, article_id, so_ky_hieu, text FROM vo),
long AS (SELECT *, CASE WHEN so_ky_hieu <> '' AND article_id <> '' THEN so_ky_hieu || '||' || article_id END AS key, row_number() OVER (ORDER BY src, id, a, part, b) AS place FROM every WHERE len({WORDS.format('text')}) >= 30),
first AS (SELECT key, min(place) AS place FROM long WHERE key IS NOT NULL GROUP BY key),
kept AS (SELECT * FROM long WHERE key IS NULL OR place IN (SELECT place FROM first))
SELECT row_number() OVER (ORDER BY place) - 1 AS idx, doc_id, article_id, so_ky_hieu, md5(text) AS text FROM kept""")
def build_corpus_sources(spark, sf_dir):
    """U1, W4, P4, P6, P7 through two readers: repeated keys within and between documents, rows without a key, long ids."""
    built = c.build_corpus([readers.phapdien(_codified(spark, sf_dir)), readers.vohuutridung(*_acts(spark, sf_dir))])
    return built.select("idx", "doc_id", "article_id", "so_ky_hieu", F.md5("text").alias("text"))


@query("SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last_role, md5(arg_max(text, turn)) AS last_text FROM conversations GROUP BY conv_id")
def metadata_last(spark, sf_dir):
    """J1, J2. Metadata that repeat an id: the last row counts, and no row of the content is multiplied."""
    turns = table(spark, sf_dir, "conversations")
    meta = turns.select(F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("id"), "role", "text", "turn")
    joined = c.join_metadata(turns.select(F.col("conv_id").alias("id")), meta, True, "turn")
    return joined.groupBy(F.col("id").alias("conv_id")).agg(F.count("*").alias("n"), F.max("role").alias("last_role"), F.md5(F.max("text")).alias("last_text"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source WHEN lang = 'de' THEN lang || '/' || doc_id WHEN lang = 'fr' THEN '7/2020/QH14' ELSE '' END AS code, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE source END AS article FROM documents")
def enrich_codes(spark, sf_dir):
    """P6, P7."""
    of = lambda lang, value: F.when(F.col("lang") == lang, value).otherwise("")
    rows = documents(spark, sf_dir).select("doc_id", of("en", F.col("source")).alias("so_ky_hieu"), of("de", F.concat("lang", F.lit("/"), "doc_id")).alias("doc_number"), of("fr", F.lit("Luật 7/2020/QH14")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Điều  "), "doc_id")).otherwise(F.col("source")).alias("a"))
    return c.enrich_codes(rows).select("doc_id", F.col("so_ky_hieu").alias("code"), c.bare_article(F.col("a")).alias("article"))


@query(f"WITH {_ACTS}, n AS (SELECT id, count(*) FILTER (article_id <> '') AS n FROM vo GROUP BY id) SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM documents WHERE lang = 'de') AS no_meta, (SELECT count(*) FROM documents WHERE lang <> 'de') - (SELECT count(*) FROM n WHERE n > 0) AS no_articles, (SELECT sum(n)::BIGINT FROM n) AS n_articles")
def extraction_counters(spark, sf_dir):
    """A10."""
    content, meta = _acts(spark, sf_dir)
    kept = readers.vohuutridung(content, meta).select(F.substring("doc_id", 6, 30).alias("id"), "article_id")
    return c.counters(kept, content, c.keep_types(meta).select("id"))


_TITLES = r"""
ti0 AS (SELECT doc_id, ['Luật', 'Nghị định', 'Thông tư'][(doc_id % 3 + 1)::INT] AS kind, regexp_extract_all(lower(text), '\p{L}{3,}') AS w FROM documents),
ti1 AS (SELECT kind || ' ' || array_to_string(w[1:4], ' ') AS title, min(doc_id) AS first_idx FROM ti0 WHERE len(w) >= 4 GROUP BY 1),
ti AS (SELECT title, first_idx, lower(regexp_extract(title, '^(Luật|Nghị định|Thông tư)', 1)) AS kind, regexp_replace(title, '^(Luật|Nghị định|Thông tư) ', '') AS name, list_distinct(string_split(regexp_replace(title, '^(Luật|Nghị định|Thông tư) ', ''), ' ')) AS words FROM ti1),
na AS (SELECT doc_id AS name_id, CASE doc_id % 4 WHEN 0 THEN 'luật ' || w[2] || ' ' || w[1] || ' ' || w[4] WHEN 1 THEN w[3] || ' ' || w[2] || ' ' || w[9] WHEN 2 THEN 'luật ' || w[3] ELSE w[1] || ' ' || w[2] || ' ' || w[3] || ' ' || w[4] || ' ' || w[5] END AS name FROM ti0 WHERE len(w) >= 9)"""


@query(rf"""WITH {_TITLES},
q AS (SELECT name_id, CASE WHEN name LIKE 'luật %' THEN 'luật' ELSE '' END AS kind, regexp_replace(name, '^luật ', '') AS core FROM na),
qw AS (SELECT *, string_split(core, ' ') AS ws FROM q),
h AS (SELECT name_id, title, first_idx, len(list_filter(ws, lambda x: list_contains(words, x))) AS hits, len(ws) AS n FROM qw, ti WHERE length(title) >= 10 AND (qw.kind = '' OR qw.kind = ti.kind)),
bw AS (SELECT name_id, arg_min(title, -round(hits / n::DOUBLE, 9) * 1e9 + first_idx) AS t FROM h WHERE hits >= 2 AND hits / n::DOUBLE >= 0.6 GROUP BY name_id),
bn AS (SELECT name_id, arg_min(title, first_idx) AS t FROM q, ti WHERE length(core) > 3 AND length(ti.name) > 3 AND (q.kind = '' OR q.kind = ti.kind) AND (contains(ti.name, core) OR contains(core, ti.name)) AND name_id NOT IN (SELECT name_id FROM bw) GROUP BY name_id)
SELECT name_id, coalesce(bw.t, bn.t) AS title FROM q LEFT JOIN bw USING (name_id) LEFT JOIN bn USING (name_id)""")
def law_match(spark, sf_dir):
    """F5, F6, J5, J7. Names of mixed words against titles; all pairs in the SQL."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1))
    # the texts are taken apart once; of the words no more than nine are asked for
    own = written(documents(spark, sf_dir).select("doc_id", F.slice(w, 1, 9).alias("w")), "words")
    word = lambda i: F.try_element_at("w", F.lit(i))
    kind = F.element_at(F.array(*map(F.lit, ("Luật", "Nghị định", "Thông tư"))), (F.col("doc_id") % 3 + 1).cast("int"))
    titles = own.filter(F.size("w") >= 4).select(F.col("doc_id").alias("idx"), F.concat_ws(" ", kind, F.slice("w", 1, 4)).alias("title"), F.lit("").alias("so_ky_hieu"))
    i = F.col("doc_id") % 4
    name = F.when(i == 0, F.concat_ws(" ", F.lit("luật"), word(2), word(1), word(4))).when(i == 1, F.concat_ws(" ", word(3), word(2), word(9))).when(i == 2, F.concat_ws(" ", F.lit("luật"), word(3))).otherwise(F.concat_ws(" ", F.slice("w", 1, 5)))
    return lawmatch.match(own.filter(F.size("w") >= 9).select(F.col("doc_id").alias("name_id"), name.alias("name")), written(lawmatch.title_index(titles), "titles"))


@query("WITH t AS (SELECT 'Luật ' || source || ' ' || (doc_id % 50) || '/2020/QH14' AS title, (doc_id % 50) || '/2020/QH14' AS code, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT doc_id AS name_id, (SELECT arg_max(title, length(title) * 1000000 - first) FROM t WHERE code = (d.doc_id % 60) || '/2020/QH14') AS title FROM documents d")
def law_code_match(spark, sf_dir):
    """J6, A12, A13. Names that hold a code: the longest title of that code, the first of these."""
    code = lambda n: F.concat((F.col("doc_id") % n).cast("string"), F.lit("/2020/QH14"))
    docs = documents(spark, sf_dir)
    titles = docs.select(F.col("doc_id").alias("idx"), F.concat_ws(" ", F.lit("Luật"), "source", code(50)).alias("title"), F.lit("").alias("so_ky_hieu"))
    return lawmatch.match(docs.select(F.col("doc_id").alias("name_id"), code(60).alias("name")), written(lawmatch.title_index(titles), "titles"))


# where a window ends: behind its last full stop, if it goes back
_STOP = "CASE WHEN stop < len(w) AND NOT regexp_matches(s, '[.!?]$') AND contains(s, '.') AND length(s) - strpos(reverse(s), '.') > length(s) // 2 THEN start0 + len(list_filter(string_split(s[1:length(s) - strpos(reverse(s), '.')], ' '), lambda x: x <> '')) ELSE stop END"


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents),
r AS (
  SELECT doc_id, w, 0 AS j, 0 AS start0, least(64, len(w)) AS stop, array_to_string(w[1:64], ' ') AS s FROM w WHERE len(w) > 64
  UNION ALL
  SELECT doc_id, w, j + 1, next, least(next + 64, len(w)), array_to_string(w[next + 1:next + 64], ' ') FROM (
    SELECT *, greatest(stop2 - 16, start0 + 1) AS next FROM (SELECT *, {_STOP} AS stop2 FROM r)) WHERE stop2 < len(w)),
o AS (SELECT doc_id, j, array_to_string(w[start0 + 1:{_STOP}], ' ') AS piece FROM r)
SELECT doc_id, j, md5(piece) AS piece FROM o UNION ALL SELECT doc_id, 0, md5(text) FROM w WHERE len(w) <= 64""")
def sentence_windows(spark, sf_dir):
    """E6 with sentence ends."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(x.sentence_windows(F.col("text"), 64, 16)).alias("j", "p")).select("doc_id", F.col("j").cast("long").alias("j"), F.md5("p").alias("piece"))


@query(f"WITH {STRUCTURED}, n AS (SELECT *, string_split(text, chr(10)) AS l FROM s) SELECT doc_id, len(l) AS n FROM n WHERE len(list_filter(l, lambda x: length({STRIP.format('x')}) >= 60)) > 0")
def article_only(spark, sf_dir):
    """P8. Documents that have an article of at least sixty characters."""
    docs = structured(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), *(F.lit("").alias(n) for n in ("doc_type", "doc_number", "issuing_authority", "issuance_date")))
    kept = c.extract_documents(docs, "x", 60, article_only=True).select(F.substring("doc_id", 6, 20).cast("long").alias("doc_id")).distinct()
    return structured(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n")).join(kept, "doc_id", "left_semi")


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN i IN (0, 7, 31, n - 1, n - 20) THEN 'row' ELSE 'batch' END AS found FROM n WHERE i IN (0, 7, 31, n - 1, n - 20) OR i // 30 = 3")
def rows_at(spark, sf_dir):
    """S13 (a lookup of five positions, two of them from the end) and L10 (the fourth batch of thirty)."""
    docs = documents(spark, sf_dir).select("doc_id")
    rows = c.rows_at(c.number_rows(docs, ["doc_id"]), [0, 7, 31, -1, -20]).select("doc_id", F.lit("row").alias("found"))
    return rows.unionByName(c.batch(docs, 3, 30, "doc_id").join(rows, "doc_id", "left_anti").select("doc_id", F.lit("batch").alias("found")))
