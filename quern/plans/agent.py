"""Question answering over the retriever (G1-G6, G9): the loops run on the driver, every step is a DataFrame plan.

Language models are injected: anything with ``generate(prompt, temperature) -> str``. :class:`RuleModel` is a
deterministic stand-in that quotes its context, so that everything around the model can be tested.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, Config
from quern.functions import fixed
from quern.functions import text as t
from quern.operators import answer as assembly
from quern.operators import fusion, lawmatch
from quern.operators.rerank import overlap_logit, reconstruct, rerank
from quern.plans import prompts
from quern.plans import retrieval as plans
from quern.storage import written


class Model(Protocol):
    def generate(self, prompt: str, temperature: float = 0.1) -> str: ...


class RuleModel:
    """Replies by rule: to a question with context, the first labelled passage; JSON and label tasks get empty defaults."""

    def generate(self, prompt: str, temperature: float = 0.1) -> str:
        task = prompt.split("\n", 1)[0]
        if task in ("ANALYSE", "ASSESS"):
            return '{"is_complete": true, "laws": [], "search_queries": []}'
        if task == "ANSWER":
            found = re.search(r"^\[1\] (.*)\n(.*)", prompt, re.MULTILINE)
            return f"{found[1]}: {found[2][:400]}" if found else "No passage was found."
        return prompts.part(prompt, "answer") if task == "EDIT" else {"CLASSIFY": "factual", "USEFUL?": "USEFUL", "CORRECT": "OK"}.get(task, "")


def parsed(reply: str) -> dict:
    """T23 on the driver: the JSON object of a reply, or an empty one."""
    for text in (*re.findall(r"```(?:json)?\s*(.*?)```", reply, re.DOTALL)[:1], reply, reply[reply.find("{") : reply.rfind("}") + 1]):
        try:
            out = json.loads(text)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    return {}


def ask(model: Model, task: str, **parts: object) -> str:
    """A model's reply to the prompt of a task, at its temperature."""
    return model.generate(prompts.prompt(task, **parts), prompts.temperature(task))


def replied(model: Model, query: str, context: str, self_correct: bool, rounds: int = 2) -> tuple[str, int]:
    """G1, G2 from a context: an answer, one retry if it is short or judged useless, corrections, the final edit."""
    out = ask(model, "ANSWER", passages=context, question=query)
    if len(out) < 30 or "NOT_USEFUL" in ask(model, "USEFUL?", question=query, answer=out[:500]).upper():
        out = ask(model, "ANSWER", passages=context, question=query, note=f"Be more specific than this answer:\n{out}")
    done = 0
    for done in range(1, rounds + 1) if self_correct else ():
        reply = ask(model, "CORRECT", passages=context, question=query, answer=out).strip()
        if reply.upper().startswith("OK"):
            break
        out = reply
    return ask(model, "EDIT", answer=out).strip(), done


@dataclass
class Result:
    query: str
    query_type: str = "unknown"
    answer: str = ""
    citations: list[str] = field(default_factory=list)
    relevant_docs: list[str] = field(default_factory=list)
    relevant_articles: list[str] = field(default_factory=list)
    expanded_queries: list[str] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)
    confidence: float = 0.0
    corrections: int = 0
    retrieval_time: float = 0.0
    rerank_time: float = 0.0
    generation_time: float = 0.0


class Engine:
    """A retriever with models. ``embed`` and ``scorer`` are column functions."""

    def __init__(self, retriever: plans.Retriever, model: Model | None = None, embed=None, scorer=overlap_logit, config: Config = DEFAULT):
        self.retriever, self.model, self.embed, self.scorer, self.config = retriever, model or RuleModel(), embed, scorer, config
        self.spark = retriever.corpus.sparkSession
        self.titles = written(lawmatch.title_index(retriever.corpus), "titles") if "title" in retriever.corpus.columns else None

    def ask(self, task: str, **parts: object) -> str:
        """The model's reply to the prompt of a task, at its temperature."""
        return ask(self.model, task, **parts)

    def choice(self, placed: DataFrame) -> DataFrame:
        """R3. For :func:`quern.operators.rerank.rerank_by_choice`: the model picks from each batch of passages of a query."""
        shown = F.concat(F.lit("["), (F.col("place") + 1).cast("string"), F.lit("] "), F.col("doc_title"), F.lit("\n"), F.substring("content", 1, 500))
        batches = placed.groupBy("query_id", "query", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", shown.alias("s")))), lambda x: x["s"]), "\n\n").alias("passages"))
        replies = [(r.query_id, r.batch, self.ask("RERANK", passages=r.passages, question=r.query)) for r in batches.toLocalIterator()]
        kinds = {c: placed.schema[c].dataType.simpleString() for c in ("query_id", "batch")}
        return self.spark.createDataFrame(replies, f"query_id {kinds['query_id']}, batch {kinds['batch']}, reply string")

    def _ordered(self, chunks: DataFrame, query: str) -> DataFrame:
        """One list in the order of (query, rank), for the reranker."""
        w = Window.partitionBy("query_id").orderBy(*(c for c in ("turn", "query_order", "rank") if c in chunks.columns))
        return chunks.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("query", F.lit(query))

    def laws(self, names: list[str]) -> list[str]:
        """Titles that the names match."""
        if not names or self.titles is None:
            return []
        rows = self.spark.createDataFrame(list(enumerate(names)), "name_id long, name string")
        return [r.title for r in lawmatch.match(rows, self.titles).orderBy("name_id").collect() if r.title]

    def generate(self, query: str, chunks: DataFrame, self_correct: bool = True, rounds: int = 2, threshold: float = 0.95) -> tuple[str, int]:
        """G1, G2. Context, answer, one retry if the answer is short or judged useless, corrections, final edit.

        A reply counts as useless if it contains NOT_USEFUL.
        """
        context = next((r.context for r in self._contexts(chunks, threshold).collect()), "")
        return self._replied(query, context, self_correct, rounds)

    def _contexts(self, chunks: DataFrame, threshold: float) -> DataFrame:
        return assembly.context(assembly.context_gate(chunks, threshold, final=self.config.final_top_k))

    def _replied(self, query: str, context: str, self_correct: bool, rounds: int = 2) -> tuple[str, int]:
        return replied(self.model, query, context, self_correct, rounds)

    def _finish(self, result: Result, chunks: DataFrame) -> Result:
        """R8, R9, A5 for one query."""
        self._finished({0: result}, chunks, "long")
        return result

    def _finished(self, results: dict[int, Result], chunks: DataFrame, kind: str) -> None:
        """R8, R9, A5 for the results of a block, by query id."""
        answers = self.spark.createDataFrame([(i, r.answer) for i, r in results.items()], f"query_id {kind}, answer string")
        used = assembly.used(chunks, answers, self.config.final_top_k)
        for r in answers.select("query_id", assembly.citations(F.col("answer")).alias("c")).collect():
            results[r.query_id].citations = r.c
        for r in assembly.relevant(used).collect():
            results[r.query_id].relevant_docs, results[r.query_id].relevant_articles = r.relevant_docs, r.relevant_articles
        for r in assembly.api_rows(used).orderBy("query_id", "rank").collect():
            results[r.query_id].chunks.append(r.asDict())
        for r in assembly.confidence(chunks).collect():
            results[r.query_id].confidence = float(r.confidence)

    def agent(self, query: str, most_turns: int = 0, self_correct: bool = True) -> Result:
        """G4 for one question."""
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return next(self.agents(asked, most_turns, self_correct))[1]

    def agents(self, queries: DataFrame, most_turns: int = 0, self_correct: bool = True, block: int = 20) -> Iterator[tuple[int, Result]]:
        """G4. ``queries``: (query_id, query), ids distinct. Retrieve (query, hypothetical answer, the model's own queries),
        then rerank and assess in turns, each of which may retrieve what is missing; then rerank, reconstruct, generate.
        Questions go through the plans in blocks; results come in the order of the rows."""
        rows = queries.select("query_id", "query").toLocalIterator()
        while asked := {r.query_id: r.query for r in islice(rows, block)}:
            yield from self._block(asked, queries.schema["query_id"].dataType.simpleString(), most_turns, self_correct)

    def _block(self, asked: dict, kind: str, most_turns: int, self_correct: bool) -> Iterator[tuple[int, Result]]:
        c, began, frame = self.config, time.time(), self.spark.createDataFrame
        own = F.broadcast(frame(list(asked.items()), f"query_id {kind}, query string"))  # at most a block
        ordered = lambda chunks: self._ordered(chunks, "").drop("query").join(own, "query_id")
        found = lambda more, top_k, titles, seen: plans.multi_query(self.retriever, frame([(i, *m) for i, m in more.items()], f"query_id {kind}, query string, expansions array<string>"), top_k, self.embed, titles, seen)
        asks = {r.query_id: r.s for r in own.select("query_id", fusion.situational_query(F.col("query")).alias("s")).collect()}
        more, laws = {}, {}
        for i, query in asked.items():
            analysis = parsed(self.ask("ANALYSE", question=query))
            hypothetical = self.ask("HYPOTHETICAL", question=query).strip() if asks[i] else ""
            laws[i] = self.laws(list(analysis.get("laws") or []))
            more[i] = [hypothetical, *(analysis.get("search_queries") or [])]
        named = [(i, x) for i in asked for x in laws[i]]
        titles = frame(named, f"query_id {kind}, title string") if named else None
        parts = []
        for with_laws in (False, True):
            if some := {i: (asked[i], more[i]) for i in asked if bool(laws[i]) == with_laws}:
                got = found(some, c.retrieval_top_k * (4 if with_laws else 1), titles if with_laws else None, None)
                parts.append(fusion.only_matched(got, titles) if with_laws else got)
        got = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        every = written(ordered(got).filter(F.col("rank") <= 2 * c.retrieval_top_k).withColumn("turn", F.lit(0)))
        going = list(asked)
        for turn in range(1, (most_turns or c.agentic_max_iterations) + 1):
            best = rerank(ordered(every.filter(F.col("query_id").isin(going))), c.rerank_top_k, self.scorer)
            summaries = {r.query_id: r.summary for r in assembly.summary(best).collect()}
            follow = {}
            for i in going:
                assessed = parsed(self.ask("ASSESS", question=asked[i], found=summaries.get(i, "")))
                next_queries = assessed.get("follow_up_queries") or []
                if not assessed.get("is_complete", True) and next_queries:
                    follow[i] = (next_queries[0], list(next_queries[1:]))
            if not follow:
                break
            new = found(follow, c.retrieval_top_k // 2, titles, every)
            new = written(ordered(new).withColumns({"turn": F.lit(turn), "source": F.lit(f"agent_iter_{turn}")}))
            going = [r.query_id for r in new.select("query_id").distinct().collect()]
            if not going:
                break
            going = [i for i in asked if i in going]
            every = every.unionByName(new, allowMissingColumns=True)
        retrieved = time.time()
        final = written(reconstruct(rerank(ordered(every), c.rerank_top_k, self.scorer)))
        ranked = time.time()
        contexts = {r.query_id: r.context for r in self._contexts(final.filter(F.col("rank") <= 2 * c.agentic_top_k), c.score_threshold).collect()}
        results = {}
        for i, query in asked.items():
            text, corrections = self._replied(query, contexts.get(i, ""), self_correct)
            results[i] = Result(query, "agentic", text, corrections=corrections, expanded_queries=[q for q in more[i] if q], retrieval_time=retrieved - began, rerank_time=ranked - retrieved, generation_time=time.time() - ranked)
        self._finished(results, final, kind)
        yield from results.items()

    def classic(self, query: str, self_correct: bool = True) -> Result:
        """G5, G6, P10. Classify, prepare, decompose, expand, retrieve, hypothetical answer, hops, rerank, reconstruct, and
        one answer or the answers of the parts put together."""
        c, began = self.config, time.time()
        reply = self.ask("CLASSIFY", question=query)
        row = self.spark.createDataFrame([(query, reply)], "q string, r string").select(t.prepare_query(F.col("q")).alias("q"), plans.query_kind(F.col("r")).alias("k")).first()
        query, kind = row.q, row.k
        wide, narrow, _, variations, hypothesise, dense_w, sparse_w = fixed.QUERY_PLANS[kind]
        parts = [query]
        if kind in ("multi_article", "comparison", "interpretation", "scenario"):
            listed = self._bullets(self.ask("DECOMPOSE", question=query))
            parts = listed if len(listed) > 1 else parts
        asked = [q for p in parts for q in (p, *self._bullets(self.ask("EXPAND", number=variations, question=p))[:variations])]
        fan = self.spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
        fan = fan.withColumn("embedding", self.embed(F.col("query"))) if self.embed else fan
        found = self.retriever.retrieve(fan, wide, (dense_w, sparse_w)).withColumnRenamed("query_id", "query_order").withColumn("query_id", F.lit(0).cast("long"))
        every = fusion.first_seen(found)
        text = self.ask("HYPOTHETICAL", question=query).strip() if hypothesise and self.embed else ""
        if text:
            probe = self.spark.createDataFrame([(0, text)], "query_id long, query string").withColumn("embedding", self.embed(F.col("query")))
            near = self.retriever.dense_search(probe, wide // 2).withColumns({"source": F.lit("hyde"), "query_order": F.lit(len(asked)).cast("long")})
            every = every.unionByName(fusion.first_seen(near, every), allowMissingColumns=True)
        every = written(self._ordered(every, query))
        if kind in ("multi_article", "scenario", "comparison"):
            hops = plans.multi_hop(self.retriever, every, wide, self.embed).withColumn("query_order", F.lit(len(asked) + 1).cast("long") + F.col("query_order"))
            every = self._ordered(every.unionByName(hops, allowMissingColumns=True), query)
        retrieved = time.time()
        final = written(reconstruct(rerank(every, narrow, self.scorer)))
        ranked = time.time()
        if len(parts) > 1:
            good = final.filter(F.col("score") > c.score_threshold * 0.9)
            answers = [f"{i + 1}. {p}\n{self.generate(p, good, False)[0]}" for i, p in enumerate(parts)]
            text, corrections = self.ask("RECOMPOSE", question=query, answers="\n\n".join(answers)), 0
        else:
            text, corrections = self.generate(query, final, self_correct, threshold=c.score_threshold)
        result = Result(query, kind, text, corrections=corrections, expanded_queries=asked[1:], retrieval_time=retrieved - began, rerank_time=ranked - retrieved, generation_time=time.time() - ranked)
        return self._finish(result, final)

    def _bullets(self, reply: str) -> list[str]:
        return self.spark.createDataFrame([(reply,)], "r string").select(t.bullets(F.col("r")).alias("b")).first().b
