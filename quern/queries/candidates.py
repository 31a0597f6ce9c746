"""Queries over lists of candidates: neighbours among embeddings as chunks whose label is their document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import answer as a
from quern.operators import bm25, dense, fusion, metrics, rerank
from quern.plans import retrieval as plans
from quern.queries.base import query, table
from quern.queries.search import _BM25, _DENSE, _corpus, _cut, _embedded, _queries, _retriever, _rrf, _top

_NEAR = """
d AS (SELECT q.vec_id AS query_id, q.label AS q_label, v.vec_id AS idx, v.label, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 12) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS rank FROM d QUALIFY rank <= 60)"""


def _near(spark, sf_dir):
    """The sixty nearest vectors of each query."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense.search(v.select(F.col("vec_id").alias("idx"), "embedding"), queries, 60)
    return found.join(v.select(F.col("vec_id").alias("idx"), "label"), "idx")


def _titles(spark, sf_dir):
    """For each query its own label as the title of a document."""
    v = table(spark, sf_dir, "embeddings")
    return v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("title"))


def _score(df, *more):
    return df.select("query_id", "idx", F.round("score", 6).alias("score"), *more)


@query(f"WITH {_NEAR}, g AS (SELECT *, count(*) FILTER (score >= 0.3) OVER (PARTITION BY query_id) AS good FROM n) SELECT query_id, idx, round(score, 6) AS score FROM g WHERE CASE WHEN good >= 5 THEN score >= 0.3 ELSE rank <= 20 END")
def context_gate(spark, sf_dir):
    """P9."""
    return _score(a.context_gate(_near(spark, sf_dir), 0.3, 5, 20))


@query(f"WITH {_NEAR} SELECT query_id, round(max(score), 6) AS confidence FROM n GROUP BY query_id")
def confidence(spark, sf_dir):
    """A5."""
    return a.confidence(_near(spark, sf_dir)).select("query_id", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_NEAR}, o AS (SELECT *, label % 3 AS query_order, 'c' || idx % 17 AS chunk_id FROM n WHERE idx % 17 <> 5) SELECT query_id, idx, round(score, 6) AS score, chunk_id FROM o QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY query_order, rank) = 1")
def first_seen(spark, sf_dir):
    """J8, U2, U4, W5. Several rows of a chunk; one chunk has been seen."""
    chunks = _near(spark, sf_dir).withColumns({"query_order": F.col("label") % 3, "chunk_id": F.concat(F.lit("c"), (F.col("idx") % 17).cast("string"))})
    seen = chunks.select("query_id", F.lit("c5").alias("chunk_id")).distinct()
    return _score(fusion.first_seen(chunks, seen), "chunk_id")


@query(f"WITH {_NEAR} SELECT query_id, idx, round(CASE WHEN label = q_label THEN score * 1.2 ELSE score END, 6) AS score FROM n")
def boost(spark, sf_dir):
    """J9."""
    chunks = _near(spark, sf_dir).withColumn("doc_title", F.col("label").cast("string"))
    return _score(fusion.boost(chunks, _titles(spark, sf_dir)))


@query(f"WITH {_NEAR}, m AS (SELECT *, count(*) FILTER (label = q_label) OVER (PARTITION BY query_id) AS hits FROM n) SELECT query_id, idx, round(score, 6) AS score FROM m WHERE hits < 10 OR label = q_label")
def only_matched(spark, sf_dir):
    """P11."""
    chunks = _near(spark, sf_dir).withColumn("doc_title", F.col("label").cast("string"))
    return _score(fusion.only_matched(chunks, _titles(spark, sf_dir)))


_CHOICE = "c AS (SELECT *, (rank - 1) // 15 AS batch, (rank - 1) % 15 AS place FROM {0}), ch AS (SELECT *, CASE WHEN place IN (2, 0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS chosen FROM c)"


def _chosen(placed):
    return placed.select("query_id", "batch").distinct().withColumn("reply", F.lit("3, 1, 99, x, 7"))


@query(f"WITH {_NEAR}, {_CHOICE.format('n')} SELECT query_id, idx, chosen AS score, row_number() OVER (PARTITION BY query_id ORDER BY chosen DESC, rank) AS pos FROM ch QUALIFY pos <= 30")
def rerank_by_choice(spark, sf_dir):
    """R3, L5, T26. The reply names the third, first and seventh passage of each batch, and two that are none."""
    return rerank.rerank_by_choice(_near(spark, sf_dir), _chosen, 30).select("query_id", "idx", "score", F.col("rank").alias("pos"))


@query(f"""WITH {_NEAR},
p AS (SELECT *, 1 / (1 + exp(-(label - 4.5::DOUBLE) / 3)) AS p FROM n), s AS (SELECT *, round((p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w), 12) AS rr FROM p WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank) AS place1 FROM s), f2 AS (SELECT query_id, idx, place1 AS rank FROM f WHERE place1 <= 40), {_CHOICE.format('f2')}
SELECT query_id, idx, chosen AS score, row_number() OVER (PARTITION BY query_id ORDER BY chosen DESC, rank) AS place2 FROM ch QUALIFY place2 <= 20""")
def two_stage(spark, sf_dir):
    """R4. A scorer by label, then a choice; of sixty candidates forty and twenty stay."""
    chunks = _near(spark, sf_dir).withColumns({"query": F.lit("q"), "content": F.lit("c")})
    return rerank.two_stage(chunks, _chosen, 20, lambda q, c: (F.col("label") - 4.5) / 3).select("query_id", "idx", "score", F.col("rank").alias("place2"))


_LINE = "'[' || min(rank) || '] ' || label || CASE WHEN article <> '' THEN ' - Điều ' || article ELSE '' END || ': ' || 'line ' || min(rank)"


@query(f"WITH {_NEAR}, l AS (SELECT query_id, label, CASE WHEN idx % 3 = 0 THEN '' ELSE (idx % 3)::VARCHAR END AS article, rank FROM n WHERE rank <= 20), m AS (SELECT query_id, min(rank) AS place, {_LINE} AS line FROM l GROUP BY query_id, label, article) SELECT query_id, string_agg(line, chr(10) ORDER BY place) AS summary FROM m GROUP BY query_id")
def summary(spark, sf_dir):
    """R7, W5, W9."""
    article = F.when(F.col("idx") % 3 == 0, "").otherwise((F.col("idx") % 3).cast("string"))
    chunks = _near(spark, sf_dir).withColumns({"doc_title": F.col("label").cast("string"), "article_id": article, "content": F.concat(F.lit("line\n"), F.col("rank").cast("string"))})
    return a.summary(chunks)


@query("SELECT doc_id AS query_id, CASE WHEN quality = 1 THEN 'new' ELSE 'old' END AS state FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)")
def merge_results(spark, sf_dir):
    """U6. Results of labelled documents; those of good quality are replaced."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("query_id")).agg(F.max("quality").alias("quality"))
    done = labels.select("query_id", F.lit("old").alias("state"))
    return metrics.merge_results(done, labels.filter("quality = 1").select("query_id", F.lit("new").alias("state")))


@query(f"WITH {_BM25}, {_DENSE}, a AS (SELECT 'dense' AS side, * FROM {_top('dn', 10)} UNION ALL SELECT 'sparse', * FROM {_top('bm', 10)}) SELECT side, a.query_id, a.idx, a.rank, round(a.score, 6) AS score, source AS doc_title FROM a JOIN documents ON doc_id = a.idx")
def one_sided_search(spark, sf_dir):
    """F4, J3."""
    r, q = _retriever(spark, sf_dir), _embedded(spark, sf_dir)
    both = [df.select(F.lit(side).alias("side"), "query_id", "idx", "rank", F.round("score", 6).alias("score"), "doc_title") for side, df in (("dense", r.dense_search(q, 10)), ("sparse", r.sparse_search(q, 10)))]
    return both[0].unionByName(both[1])


# the benchmark's questions twice: as they are, and with the mark of an article, which weighs the sparse side
_BOTH = "bq AS (SELECT item_id * 2 + k AS item_id, text FROM (SELECT item_id, 0 AS k, text FROM benchmark UNION ALL SELECT item_id, 1, 'điều 5 ' || text FROM benchmark))"


def _both(sql: str) -> str:
    return sql.replace("FROM benchmark", "FROM bq")


def _weighed(k: int, near: str, sparse: str) -> str:
    wd, ws = (0.7, 0.3) if k == 0 else (0.3, 0.7)
    return _rrf(f"(SELECT * FROM {near} WHERE query_id % 2 = {k})", f"(SELECT * FROM {sparse} WHERE query_id % 2 = {k})", wd, ws, 20)


@query(f"""WITH {_BOTH}, {_both(_BM25)}, {_both(_DENSE)}, a AS {_top('dn', 40)}, b AS {_top('bm', 40)}, ca AS {_cut('a', 40)}, cb AS {_cut('b', 40)},
f AS (SELECT * FROM {_weighed(0, 'ca', 'cb')} UNION ALL SELECT * FROM {_weighed(1, 'ca', 'cb')}),
sn AS (SELECT query_id // 2 AS own, idx FROM {_top('bm', 7)} WHERE query_id % 2 = 0),
u AS (SELECT query_id // 2 AS own, query_id % 2 AS k, f.idx, score FROM f ANTI JOIN sn ON sn.own = f.query_id // 2 AND sn.idx = f.idx QUALIFY row_number() OVER (PARTITION BY query_id // 2, f.idx ORDER BY query_id % 2, rank) = 1)
SELECT own AS query_id, idx, k AS query_order, round(CASE WHEN source = 'src1' THEN score * 1.2 ELSE score END, 6) AS score FROM u JOIN documents ON doc_id = idx""")
def multi_query(spark, sf_dir):
    """F7, E8, P14, J8, J9, U2. Each query, a blank expansion that is left out, and one that names an article and so weighs the
    sparse side; chunks that have been seen (the first seven of a plain sparse search) go, those of a matched title are
    boosted."""
    asked = _queries(spark, sf_dir).withColumn("expansions", F.array(F.lit(" "), F.concat(F.lit("điều 5 "), F.col("query"))))
    r = _retriever(spark, sf_dir)
    seen = bm25.search(r.index, asked, 7).select("query_id", F.col("idx").cast("string").alias("chunk_id"))
    found = plans.multi_query(r, asked, 20, dense.hashed_vector, asked.select("query_id", F.lit("src1").alias("title")), seen)
    return _score(found, F.col("query_order").cast("long").alias("query_order"))
