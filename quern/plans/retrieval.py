"""Composed retrieval plans (F3, F7-F10, E8), batched over queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import DEFAULT, Config
from quern.functions import fixed
from quern.functions import text as t
from quern.operators import bm25, dense, fusion
from quern.operators.extract import cross_references, fan_out
from quern.operators.rerank import overlap_logit, reconstruct, rerank
from quern.storage import current, fingerprint, forget, note


@dataclass
class Retriever:
    """A corpus (idx, text, ...), its BM25 index, and vectors (idx, embedding; or stored cells of them) if there are any."""

    corpus: DataFrame
    index: bm25.Index
    vectors: DataFrame | dense.Cells | None = None

    @classmethod
    def over(cls, corpus: DataFrame, config: Config = DEFAULT, embed=None, path: str | None = None, force: bool = False) -> Retriever:
        """V3, S15-S17. ``embed``: a column function of the text; None leaves the dense side out.

        With a ``path`` each index is built and written there if it isn't there yet (or ``force`` says so), and loaded: searches
        then read stored postings and vectors, and no text is tokenized or embedded again. A manifest tells what an index was
        built from - the corpus' plan and files, the parameters, the model's name - and another corpus, parameter or model
        builds it anew. Without a path, every search does that.
        """
        spark = corpus.sparkSession
        own = corpus.select("idx", "text")
        vectors = own.select("idx", embed(F.col("text")).alias("embedding")) if embed else None
        if path is None:
            return cls(corpus, bm25.build(corpus, config.bm25_k1, config.bm25_b), vectors)

        def kept(part: str, build, **settings) -> str:
            place, mark = f"{path}/{part}", fingerprint(own, **settings)
            if force or not current(spark, place, mark):
                forget(spark, place)
                build(place)
                note(spark, place, mark)
            return place

        sparse = kept("sparse", lambda place: bm25.build(corpus, config.bm25_k1, config.bm25_b).save(place), k1=config.bm25_k1, b=config.bm25_b, layout=("ats", bm25.BUCKETS, bm25.WIDTH))
        if vectors is not None:
            model = f"{getattr(embed, '__module__', '')}.{getattr(embed, '__qualname__', repr(embed))}"
            vectors = dense.Cells.load(spark, kept("dense", lambda place: dense.Cells.save(vectors, place), model=model, layout=(dense.PER_CELL, dense.MOST_CELLS)))
        return cls(corpus, bm25.Index.load(spark, sparse), vectors)

    @classmethod
    def stored(cls, corpus: DataFrame, path: str, dense_side: bool = True) -> Retriever:
        """The indexes at the path as they are, whatever they were built from."""
        spark = corpus.sparkSession
        return cls(corpus, bm25.Index.load(spark, f"{path}/sparse"), dense.Cells.load(spark, f"{path}/dense") if dense_side else None)

    def ranked(self, queries: DataFrame, top_k: int = DEFAULT.retrieval_top_k, weights: tuple = (DEFAULT.hybrid_dense_weight, DEFAULT.hybrid_sparse_weight), cut: bool = True) -> DataFrame:
        """F3. ``queries``: (query_id, query) and, for the dense side, embedding; weights may be column expressions over
        the queries' columns. (query_id, idx, score, rank)."""
        wide = 2 * top_k
        sparse = bm25.search(self.index, queries, wide)
        if self.vectors is None or "embedding" not in queries.columns:
            return sparse.filter(F.col("rank") <= top_k)
        near = dense.search(self.vectors, queries, wide)
        if cut:
            near, sparse = (fusion.adaptive_cut(x, DEFAULT.gap_buffer, DEFAULT.gap_ratio, DEFAULT.gap_min_k, wide) for x in (near, sparse))
        if isinstance(weights[0], Column):
            w = queries.select("query_id", weights[0].alias("_wd"), weights[1].alias("_ws"))
            near, sparse = near.join(w, "query_id"), sparse.join(w, "query_id")
            return fusion.fuse_weighted(near, sparse, top_k)
        return fusion.fuse([(near, weights[0]), (sparse, weights[1])], top_k)

    def retrieve(self, queries: DataFrame, top_k: int = DEFAULT.retrieval_top_k, weights: tuple = (DEFAULT.hybrid_dense_weight, DEFAULT.hybrid_sparse_weight), cut: bool = True) -> DataFrame:
        """F3, J3. Chunks of the ranked rows."""
        return fusion.hydrate(self.ranked(queries, top_k, weights, cut), self.corpus)

    def dense_search(self, queries: DataFrame, k: int) -> DataFrame:
        """F4."""
        return fusion.hydrate(dense.search(self.vectors, queries, k), self.corpus)

    def sparse_search(self, queries: DataFrame, k: int) -> DataFrame:
        """F4."""
        return fusion.hydrate(bm25.search(self.index, queries, k), self.corpus)


def retrieve_only(retriever: Retriever, queries: DataFrame, top_k: int = 20, config: Config = DEFAULT, scorer=overlap_logit) -> DataFrame:
    """F10, the flagship: hybrid retrieval, rerank, reconstruction, the first ``top_k``."""
    found = retriever.retrieve(queries, config.retrieve_only_top_k, (config.retrieve_only_dense_weight, config.retrieve_only_sparse_weight))
    ranked = rerank(found.join(queries.select("query_id", "query"), "query_id"), top_k, scorer)
    return reconstruct(ranked).filter(F.col("rank") <= top_k)


def multi_query(retriever: Retriever, queries: DataFrame, top_k: int, embed=None, titles: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """F7, E8, P14, J8, J9, U2. ``queries``: (query_id, query, expansions). Every query of a fan-out is retrieved with the
    weights of its kind; the first sighting of a chunk stays; chunks of matched titles are boosted."""
    fan = fan_out(queries).withColumn("_q", F.concat_ws("/", F.col("query_id").cast("string"), F.col("query_order").cast("string")))
    asked = fan.select(F.col("_q").alias("query_id"), "query", *([embed(F.col("query")).alias("embedding")] if embed else []))
    keyword = fusion.keyword_query(F.col("query"))
    weights = (F.when(keyword, 0.3).otherwise(0.7), F.when(keyword, 0.7).otherwise(0.3))
    found = retriever.retrieve(asked, top_k, weights).withColumnRenamed("query_id", "_q")
    chunks = fusion.first_seen(found.join(fan.select("_q", "query_id", "query_order"), "_q").drop("_q"), seen)
    return fusion.boost(chunks, titles) if titles is not None else chunks


def multi_hop(retriever: Retriever, chunks: DataFrame, top_k: int, embed=None, factor: float = 0.85) -> DataFrame:
    """F8, E7. Chunks that the references in the best chunks lead to and that are not among ``chunks`` yet."""
    refs = cross_references(chunks).withColumn("_q", F.concat_ws("/", F.col("query_id").cast("string"), F.col("n").cast("string")))
    asked = refs.select(F.col("_q").alias("query_id"), F.col("ref").alias("query"), *([embed(F.col("ref")).alias("embedding")] if embed else []))
    found = retriever.retrieve(asked, max(1, top_k // 2)).withColumnRenamed("query_id", "_q").join(refs.select("_q", "query_id", F.col("n").alias("query_order")), "_q").drop("_q")
    new = fusion.first_seen(found, chunks)
    return new.withColumns({"score": F.col("score") * factor, "source": F.lit("multi_hop")})


def query_plan(kinds: DataFrame) -> DataFrame:
    """F9. ``kinds``: (query_id, kind). The plan of each query; unknown kinds are factual."""
    spark = kinds.sparkSession
    names = ["kind", "top_k_retrieval", "top_k_rerank", "top_k_final", "num_query_variations", "use_hyde", "dense_weight", "sparse_weight"]
    table = spark.createDataFrame([(k, *v) for k, v in fixed.QUERY_PLANS.items()], names)
    known = F.when(F.col("kind").isin(list(fixed.QUERY_PLANS)), F.col("kind")).otherwise("factual")
    return kinds.withColumn("kind", known).join(F.broadcast(table), "kind")


def query_kind(reply: Column) -> Column:
    """T25, G6. The kind of question that a classifier's reply names."""
    return t.label_of(reply, fixed.QUERY_KINDS, "factual")
