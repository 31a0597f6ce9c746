"""Queries over retrieval, fusion, reranking and answer assembly."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quern.operators import answer as a
from quern.operators import bm25, dense, fusion
from quern.operators.models import PairModel, TokenModel, embed_texts
from quern.operators.rerank import reconstruct, rerank
from quern.plans import retrieval as plans
from quern.queries.base import documents, query, table, terms
from quern.storage import shared_dir


def _corpus(spark, sf_dir):
    """Documents as chunks: the source is the title, the language stands for the article."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("idx"), "text", F.col("source").alias("title"), F.col("lang").alias("article_id"), F.concat("source", F.lit("/"), "lang").alias("so_ky_hieu"))


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _embedded(spark, sf_dir):
    return _queries(spark, sf_dir).withColumn("embedding", dense.hashed_vector(F.col("query")))


#: Where the indexes of a table lie, by session and table: built by the first query that needs them, loaded by the others.
_INDEXES: dict[tuple[str, str], str] = {}


def _index_path(spark, sf_dir):
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        _INDEXES[key] = shared_dir(spark)
    return _INDEXES[key]


def _retriever(spark, sf_dir):
    return plans.Retriever.over(_corpus(spark, sf_dir), embed=dense.hashed_vector, path=_index_path(spark, sf_dir))


_BM25 = f"""
dt AS (SELECT doc_id AS idx, {terms('text')} AS ts FROM documents),
dl AS (SELECT idx, len(ts) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT idx, term, count(*) AS tf FROM (SELECT idx, unnest(ts) AS term FROM dt) GROUP BY idx, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({terms('text')}) AS term FROM benchmark),
bm AS (SELECT query_id, tf.idx, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf ON qt.term = tf.term JOIN df ON df.term = tf.term JOIN dl ON dl.idx = tf.idx, st GROUP BY query_id, tf.idx)"""


def _top(source: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, idx) AS rank FROM {source} QUALIFY rank <= {k})"


def _vector(source: str, key: str) -> str:
    return f"(SELECT {key}, slot, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS v FROM (SELECT {key}, slot, count(*)::DOUBLE AS c FROM (SELECT {key}, ('0x' || md5(term)[1:4])::INT % 64 AS slot FROM {source}) GROUP BY {key}, slot))"


_DENSE = f"""
dv AS {_vector('(SELECT idx, unnest(ts) AS term FROM dt)', 'idx')},
qv AS {_vector(f"(SELECT item_id AS query_id, unnest({terms('text')}) AS term FROM benchmark)", 'query_id')},
hit AS (SELECT query_id, idx, sum(qv.v * dv.v) AS score FROM qv JOIN dv ON qv.slot = dv.slot GROUP BY query_id, idx),
dn AS (SELECT q.item_id AS query_id, d.doc_id AS idx, round(coalesce(score, 0), 12) AS score FROM benchmark q, documents d LEFT JOIN hit ON hit.query_id = q.item_id AND hit.idx = d.doc_id)"""


def _cut(source: str, most: int) -> str:
    return f"""(SELECT query_id, idx, score, rank FROM (
  SELECT *, CASE WHEN n <= 3 THEN n WHEN c <= 0 THEN 3 ELSE greatest(3, least({most}, m + 5)) END AS k FROM (
    SELECT *, min(rank) FILTER (rank <= c AND gap = top) OVER (PARTITION BY query_id) AS m FROM (
      SELECT *, max(gap) FILTER (rank <= c) OVER (PARTITION BY query_id) AS top FROM (
        SELECT *, floor((count(*) OVER (PARTITION BY query_id) - 1) * 0.9::DOUBLE) AS c, count(*) OVER (PARTITION BY query_id) AS n, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 12) AS gap FROM {source})))) WHERE rank <= k)"""


def _rrf(near: str, sparse: str, wd: float, ws: float, k: int) -> str:
    return f"""(SELECT query_id, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place) AS rank FROM (
  SELECT query_id, idx, sum(s) AS score, min(place) AS place FROM (SELECT query_id, idx, {wd}::DOUBLE / (60 + rank) AS s, rank AS place FROM {near} UNION ALL SELECT query_id, idx, {ws}::DOUBLE / (60 + rank), 1000000 + rank FROM {sparse})
  GROUP BY query_id, idx) QUALIFY rank <= {k})"""


def _out(df):
    return df.select("query_id", "idx", "rank", F.round("score", 6).alias("score"))


_OUT = "SELECT query_id, idx, rank, round(score, 6) AS score FROM "


@query(f"WITH {_BM25} SELECT term, df FROM df")
def bm25_stats(spark, sf_dir):
    return bm25.build(_corpus(spark, sf_dir)).terms


@query(f"WITH {_BM25} SELECT tf.term, count(*) AS df, count(DISTINCT tf.idx // 4096) AS n_blocks, round(max(tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS top FROM tf JOIN dl USING (idx), st GROUP BY tf.term")
def build_index(spark, sf_dir):
    """S16, S17, V3. Builds the indexes of the table if they aren't current; the blocks of each term."""
    blocks = _retriever(spark, sf_dir).index.blocks
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_blocks"), F.round(F.max("top"), 9).alias("top"))


@query(f"WITH {_BM25} {_OUT}{_top('bm', 10)}")
def bm25_block_max(spark, sf_dir):
    """B3, L2. Short blocks and few seeds, so that blocks are skipped on small tables too."""
    path = f"{shared_dir(spark)}/short"
    bm25.build(_corpus(spark, sf_dir)).save(path, width=32)
    return _out(bm25.block_max(bm25.Index.load(spark, path), _queries(spark, sf_dir), 10, seeds=3)[0])


@query(f"WITH {_BM25} SELECT t.query_id, t.idx, t.rank, round(score, 6) AS score, source FROM {_top('bm', 10)} t JOIN documents ON doc_id = t.idx")
def bm25_topk(spark, sf_dir):
    r = _retriever(spark, sf_dir)
    top = _out(bm25.search(r.index, _queries(spark, sf_dir), 10))
    return top.join(r.corpus.select("idx", F.col("title").alias("source")), "idx").select("query_id", "idx", "rank", "score", "source")


@query(f"WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS idx, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 12) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) {_OUT}{_top('d', 20)}")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return _out(dense.search(v.select(F.col("vec_id").alias("idx"), "embedding"), queries, 20))


@query(f"WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS idx, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 12) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) {_OUT}{_top('d', 20)}")
def dense_cells(spark, sf_dir):
    """V2, J12. The same rows as ``dense_topk`` from stored cells; those that can't hold a result are left unread."""
    v, path = table(spark, sf_dir, "embeddings"), f"{shared_dir(spark)}/cells"
    dense.Cells.save(v.select(F.col("vec_id").alias("idx"), "embedding"), path, per_cell=20)
    queries = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return _out(dense.search(dense.Cells.load(spark, path), queries, 20))


@query(f"WITH {_BM25}, {_DENSE}, t AS {_top('dn', 40)} {_OUT}{_cut('t', 40)}")
def adaptive_k(spark, sf_dir):
    r = _retriever(spark, sf_dir)
    return _out(fusion.adaptive_cut(dense.search(r.vectors, _embedded(spark, sf_dir), 40), most=40))


@query(f"WITH {_BM25}, {_DENSE}, a AS {_top('dn', 20)}, b AS {_top('bm', 20)} {_OUT}{_rrf('a', 'b', 0.8, 0.2, 20)}")
def rrf_fusion(spark, sf_dir):
    r, q = _retriever(spark, sf_dir), _embedded(spark, sf_dir)
    return _out(fusion.fuse([(dense.search(r.vectors, q, 20), 0.8), (bm25.search(r.index, q, 20), 0.2)], 20))


_HYBRID = f"{_BM25}, {_DENSE}, ta AS {_top('dn', 400)}, tb AS {_top('bm', 400)}, ca AS {_cut('ta', 400)}, cb AS {_cut('tb', 400)}, fused AS {_rrf('ca', 'cb', 0.7, 0.3, 200)}"


@query(f"WITH {_HYBRID} SELECT query_id, idx, rank, round(score, 6) AS score, source AS doc_title FROM fused JOIN documents ON doc_id = idx")
def hybrid_retrieve(spark, sf_dir):
    """The flagship: BM25 and dense search, both cut at their widest gap, fused and hydrated."""
    found = _retriever(spark, sf_dir).retrieve(_embedded(spark, sf_dir), 200, (0.7, 0.3))
    return found.select("query_id", "idx", "rank", F.round("score", 6).alias("score"), "doc_title")


_RERANK = f"""
hd AS (SELECT f.*, d.source AS doc_title, d.lang AS article_id, d.text AS content, q.text AS query FROM fused f JOIN documents d ON d.doc_id = f.idx JOIN benchmark q ON q.item_id = f.query_id),
tr AS (SELECT *, CASE WHEN length(content) <= 2048 THEN content WHEN strpos(content[1:2048], ' ') > 0 AND 2048 - strpos(reverse(content[1:2048]), ' ') > 1800 THEN content[1:2048 - strpos(reverse(content[1:2048]), ' ')] ELSE content[1:2048] END AS head, list_distinct({terms('query')}) AS qt FROM hd),
lg AS (SELECT *, 1 / (1 + exp(-(4 * len(list_intersect(qt, {terms('head')})) / greatest(len(qt), 1)::DOUBLE - 2))) AS p FROM tr),
mm AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN p WHEN max(p) OVER w - min(p) OVER w > 1e-12 THEN (p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w) ELSE 0 END AS rr FROM lg WINDOW w AS (PARTITION BY query_id)),
rk AS (SELECT query_id, idx, doc_title, article_id, content, rr AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rr, 12) DESC, rank) AS rank FROM mm)"""


def _reranked(spark, sf_dir, k: int):
    found = _retriever(spark, sf_dir).retrieve(_embedded(spark, sf_dir), 200, (0.7, 0.3))
    return rerank(found.join(_queries(spark, sf_dir), "query_id"), k)


@query(f"WITH {_HYBRID}, {_RERANK} SELECT query_id, idx, rank, round(score, 6) AS score FROM rk WHERE rank <= 50")
def rerank_minmax(spark, sf_dir):
    return _out(_reranked(spark, sf_dir, 50))


def _words_of(text: str) -> list[str]:
    return re.findall(r"\w{2,}", text.lower())


def _pair_tokens(pairs: list[tuple[str, str]]) -> list[list[int]]:
    """A stand-in for a tokenizer: ids by first appearance in the batch, the query's distinct words, 0, the content's."""
    known: dict[str, int] = {}
    code = lambda words: [known.setdefault(w, len(known) + 1) for w in words]
    return [[*code(dict.fromkeys(_words_of(q))), 0, *code(_words_of(c))] for q, c in pairs]


def _pair_logits(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Four times the share of the query's words that the content has, minus two."""
    out = []
    for row, on in zip(ids, mask, strict=True):
        own = row[on == 1]
        cut = int(np.flatnonzero(own == 0)[0])
        out.append(4 * np.isin(own[:cut], own[cut + 1 :]).sum() / max(1, cut) - 2)
    return np.array(out)


@query(f"WITH {_HYBRID}, {_RERANK} SELECT query_id, idx, rank, round(score, 6) AS score FROM rk WHERE rank <= 50")
def rerank_pairs(spark, sf_dir):
    """R1. A model that takes batches of tokenized pairs, padded by length."""
    found = _retriever(spark, sf_dir).retrieve(_embedded(spark, sf_dir), 200, (0.7, 0.3))
    return _out(rerank(found.join(_queries(spark, sf_dir), "query_id"), 50, PairModel(_pair_tokens, _pair_logits)))


def _slots(texts: list[str]) -> list[list[int]]:
    """A stand-in for a tokenizer: a token of each search term."""
    return [[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 16 + 1 for w in _words_of(x)] for x in texts]


def _running(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A causal stand-in: the state at a token counts the tokens up to it; states of padding are noise."""
    counts = np.cumsum((ids[:, :, None] == np.arange(1, 17)) * mask[:, :, None], axis=1).astype(np.float64)
    return np.where(mask[:, :, None] == 1, counts, -7.0)


_POOLED = f"SELECT doc_id, slot, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 9) AS v FROM (SELECT doc_id, ('0x' || md5(term)[1:4])::INT % 16 AS slot, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest({terms('text')}[1:512]) AS term FROM documents) GROUP BY ALL)"


@query(_POOLED)
def embed_pooled(spark, sf_dir):
    """V1. Last-token pooling over padded batches of similar length, of at most 512 tokens a text; slots that aren't zero."""
    model = TokenModel(_slots, _running, 512)
    vectors = embed_texts(documents(spark, sf_dir).select("doc_id", "text"), "text", model)
    return vectors.select("doc_id", F.posexplode("embedding").alias("slot", "v")).filter("v > 0").withColumn("v", F.round("v", 9))


_MERGED = """
mg AS (SELECT query_id, doc_title, article_id, CASE WHEN length(string_agg(content, chr(10) ORDER BY rank)) < 50 THEN min_by(content, rank) ELSE string_agg(content, chr(10) ORDER BY rank) END AS content, max(score) AS score, min(rank) AS old FROM rk WHERE rank <= 20 GROUP BY query_id, doc_title, article_id),
rc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, old) AS rank FROM mg)"""


@query(f"WITH {_HYBRID}, {_RERANK}, {_MERGED} SELECT query_id, 'merged_' || doc_title || '_' || article_id AS chunk_id, rank, round(score, 6) AS score, md5(content) AS content FROM rc WHERE rank <= 20")
def retrieve_only(spark, sf_dir):
    out = plans.retrieve_only(_retriever(spark, sf_dir), _embedded(spark, sf_dir), 20)
    return out.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.md5("content").alias("content"))


@query(f"WITH {_HYBRID}, {_RERANK}, {_MERGED} SELECT query_id, md5(string_agg('[' || rank || '] ' || doc_title || ' - Điều ' || article_id || chr(10) || content[1:1500], chr(10) || chr(10) ORDER BY rank)) AS context FROM rc GROUP BY query_id")
def format_context(spark, sf_dir):
    return a.context(reconstruct(_reranked(spark, sf_dir, 20))).select("query_id", F.md5("context").alias("context"))


@query(f"""WITH {_HYBRID}, {_RERANK}, {_MERGED},
u AS (SELECT *, contains('see điều de', 'điều ' || article_id) OR score >= first_value(score) OVER (PARTITION BY query_id ORDER BY rank) * 0.98 AS used FROM rc)
SELECT query_id, rank, article_id FROM (SELECT *, bool_or(used) OVER (PARTITION BY query_id) AS any_used FROM u) WHERE rank <= 20 AND (used OR (NOT any_used AND rank = 1))""")
def used_chunks(spark, sf_dir):
    answers = _queries(spark, sf_dir).select("query_id", F.lit("See Điều de").alias("answer"))
    return a.used(reconstruct(_reranked(spark, sf_dir, 20)), answers).select("query_id", "rank", "article_id")


@query(f"WITH {_HYBRID}, {_RERANK}, {_MERGED} SELECT query_id, array_to_string(list_sort(list(DISTINCT doc_title || '/' || article_id || '|' || doc_title)), ',') AS docs, array_to_string(list_sort(list(DISTINCT doc_title || '/' || article_id || '|' || doc_title || '|Điều ' || article_id)), ',') AS articles FROM rc GROUP BY query_id")
def relevant_keys(spark, sf_dir):
    keys = a.relevant(reconstruct(_reranked(spark, sf_dir, 20)))
    return keys.select("query_id", F.array_join("relevant_docs", ",").alias("docs"), F.array_join("relevant_articles", ",").alias("articles"))


@query(f"WITH {_HYBRID}, {_RERANK}, {_MERGED} SELECT query_id, string_agg(doc_title || '/' || article_id || '#' || article_id, ',' ORDER BY rank) AS predicted FROM rc GROUP BY query_id")
def predictions(spark, sf_dir):
    rows = a.predictions(reconstruct(_reranked(spark, sf_dir, 20)))
    return rows.select("query_id", F.array_join("predicted_articles", ",").alias("predicted"))


_HOPS = "bq AS (SELECT item_id * 2 + k AS item_id, 'Điều ' || n AS text FROM (SELECT item_id, 0 AS k, item_id % 50 AS n FROM benchmark UNION ALL SELECT item_id, 1, 7 FROM benchmark WHERE item_id % 50 <> 7))"


def _of_hops(sql: str) -> str:
    return sql.replace("FROM benchmark", "FROM bq")


@query(f"""WITH {_HOPS}, {_of_hops(_BM25)}, {_of_hops(_DENSE)}, a AS {_top('dn', 20)}, b AS {_top('bm', 20)}, ca AS {_cut('a', 20)}, cb AS {_cut('b', 20)}, f AS {_rrf('ca', 'cb', 0.8, 0.2, 10)}
SELECT query_id // 2 AS query_id, idx, round(score * 0.85, 6) AS score, 'multi_hop' AS source FROM f WHERE idx <> 3 QUALIFY row_number() OVER (PARTITION BY query_id // 2, idx ORDER BY query_id, rank) = 1""")
def multi_hop(spark, sf_dir):
    """F8, E7. Documents hold no cross-references, so every question of the benchmark has a chunk that names two articles, and
    one that has been seen."""
    own = F.concat(F.lit("theo Điều "), (F.col("query_id") % 50).cast("string"), F.lit(" của Luật này và tại Điều 7 Luật kia"))
    asked = _queries(spark, sf_dir)
    chunks = asked.select("query_id", F.lit(1).cast("long").alias("rank"), F.lit("x").alias("chunk_id"), own.alias("content"))
    seen = asked.select("query_id", F.lit(2).cast("long").alias("rank"), F.lit("3").alias("chunk_id"), F.lit("không có").alias("content"))
    return plans.multi_hop(_retriever(spark, sf_dir), chunks.unionByName(seen), 20, dense.hashed_vector).select("query_id", "idx", F.round("score", 6).alias("score"), "source")


_AGENT_HYBRID = f"{_BM25}, {_DENSE}, ta AS {_top('dn', 1000)}, tb AS {_top('bm', 1000)}, ca AS {_cut('ta', 1000)}, cb AS {_cut('tb', 1000)}, fused AS {_rrf('ca', 'cb', 0.7, 0.3, 500)}"
_AGENT_MERGED = _MERGED.replace("FROM rk WHERE rank <= 20", "FROM rk WHERE rank <= 50")


@query(rf"""WITH {_AGENT_HYBRID}, {_RERANK}, {_AGENT_MERGED},
gate AS (SELECT *, count(*) FILTER (score >= 0.7) OVER (PARTITION BY query_id) AS good FROM rc WHERE rank <= 60),
top AS (SELECT query_id, doc_title || ' - Điều ' || article_id || ': ' || string_split(content[1:1500], chr(10))[1][1:400] AS answer FROM gate WHERE rank = 1 AND (good < 5 OR score >= 0.7)),
an AS (SELECT item_id AS query_id, text AS query, coalesce(regexp_replace(answer, '^\s+|\s+$', '', 'g'), 'No passage was found.') AS answer FROM benchmark LEFT JOIN top ON top.query_id = item_id),
us AS (SELECT rc.*, contains(lower(answer), 'điều ' || lower(article_id)) OR score >= first_value(score) OVER (PARTITION BY rc.query_id ORDER BY rank) * 0.98 AS used FROM rc JOIN an USING (query_id)),
ur AS (SELECT * FROM (SELECT *, bool_or(used AND rank <= 20) OVER (PARTITION BY query_id) AS any_used FROM us) WHERE rank <= 20 AND (used OR (NOT any_used AND rank = 1))),
ky AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT doc_title || '/' || article_id || '|' || doc_title)), ',') AS docs, count(*)::INT AS n_chunks FROM ur GROUP BY query_id),
cf AS (SELECT query_id, max(score) AS confidence FROM rc GROUP BY query_id)
SELECT query_id, query, 'agentic' AS query_type, answer, docs AS relevant_docs, round(confidence, 6) AS confidence, n_chunks FROM an JOIN ky USING (query_id) JOIN cf USING (query_id)""")
def agent_answer(spark, sf_dir):
    """G1, G2, G4. The agent with the rule model over every question of the benchmark, in one plan; models run in the workers."""
    from quern.plans.agent import Engine
    from quern.plans.batch import answered

    out = answered(Engine(_retriever(spark, sf_dir), embed=dense.hashed_vector), _queries(spark, sf_dir))
    return out.select("query_id", "query", "query_type", "answer", F.array_join("relevant_docs", ",").alias("relevant_docs"), F.round("confidence", 6).alias("confidence"), "n_chunks")
