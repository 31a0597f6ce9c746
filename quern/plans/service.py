"""The service surface as plain functions (S24, P17, P18); :mod:`quern.plans.server` puts them on HTTP."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.config import DEFAULT, Config
from quern.functions import text as t
from quern.operators.answer import api_rows
from quern.operators.corpus import statistics
from quern.operators.rerank import overlap_logit
from quern.plans.agent import Engine, Model
from quern.plans.retrieval import Retriever, retrieve_only
from quern.sources.readers import load_corpus


def check_request(query: str, top_k: int = 20, most_turns: int = 0) -> None:
    """Bounds of a request; ValueError beyond them."""
    if not 3 <= len(query) <= 2000:
        raise ValueError("a query has 3 to 2000 characters")
    if not 1 <= top_k <= 100:
        raise ValueError("top_k lies in 1..100")
    if not 0 <= most_turns <= 5:
        raise ValueError("most_turns lies in 0..5")


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    @classmethod
    def open(cls, spark: SparkSession, config: Config = DEFAULT, sources: dict[str, dict[str, str]] | None = None, model: Model | None = None, embed=None, scorer=overlap_logit) -> Service:
        """G9. The service of a configuration: its corpus (built from ``sources`` if it isn't there) and its indexes (built if
        they aren't there), with the given models."""
        corpus = load_corpus(spark, f"{config.data_dir}/{config.corpus_file}", sources)
        retriever = Retriever.over(corpus, config, embed, config.index_dir)
        return cls(Engine(retriever, model, embed, scorer, config))

    def health(self) -> dict:
        r = self.engine.retriever
        return {"status": "ready", "app": DEFAULT.app_name, "corpus_docs": r.corpus.count(), "dense_index_vectors": r.vectors.count() if r.vectors is not None else None, "sparse_index_docs": r.index.lengths.count()}

    def stats(self) -> dict:
        """A1, L8, T32."""
        corpus = self.engine.retriever.corpus
        rows = statistics(corpus).collect()
        total = next(r for r in rows if r.source is None)
        laws = corpus.filter("so_ky_hieu != ''").groupBy(t.key_part(F.col("so_ky_hieu")).alias("code")).agg(F.count("*").alias("n"), F.min("idx").alias("first")).orderBy(F.desc("n"), "first").limit(15)
        return {"total_docs": total.n, "sources": {r.source: r.n for r in rows if r.source is not None}, "with_articles": total.with_article, "with_so_ky_hieu": total.with_code, "top_laws": [{"so_ky_hieu": r.code, "chunks": r.n} for r in laws.collect()]}

    def retrieve(self, query: str, top_k: int = 20) -> list[dict]:
        check_request(query, top_k)
        e = self.engine
        asked = e.spark.createDataFrame([(0, query)], "query_id long, query string")
        asked = asked.withColumn("embedding", e.embed(F.col("query"))) if e.embed else asked
        return [r.asDict() for r in api_rows(retrieve_only(e.retriever, asked, top_k, e.config, e.scorer)).orderBy("rank").collect()]

    def answer(self, query: str, mode: str = "agentic", self_correct: bool = True, most_turns: int = 0) -> dict:
        """``mode``: agentic or pipeline (the classic plan)."""
        check_request(query, most_turns=most_turns)
        result = self.engine.classic(query, self_correct) if mode == "pipeline" else self.engine.agent(query, most_turns, self_correct)
        return vars(result) | {"total_time": result.retrieval_time + result.rerank_time + result.generation_time}

    def answer_events(self, query: str, **options):
        """The answer as a stream of events: chunks of citations first, then the text line by line, then the end."""
        out = self.answer(query, **options)
        yield {"event": "meta", "citations": out["citations"], "chunks": out["chunks"]}
        for line in out["answer"].split("\n"):
            yield {"event": "delta", "text": line + "\n"}
        yield {"event": "done", "confidence": out["confidence"]}
