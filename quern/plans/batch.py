"""The agent over tables of questions (G1, G2, G4, M6, M7): every step is a plan, and models run in the workers.

No question, context or answer passes through the driver, which only asks in each turn whether any question goes on. Model
calls run on Arrow batches: a few threads a task, each call with a timeout and retries; what fails is a row's ``error``. A
question whose call fails goes on with an empty reply, and keeps the error of its first failed call.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TookTooLong
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import answer as assembly
from quern.operators import fusion, lawmatch, metrics
from quern.operators.corpus import number_rows
from quern.operators.rerank import reconstruct, rerank
from quern.plans import prompts
from quern.plans import retrieval as plans
from quern.plans.agent import Engine, Model, replied
from quern.schema import empty_if_null
from quern.storage import written


@dataclass(frozen=True)
class Calls:
    """How models are called: threads a task, seconds a call may take, and how often a failed one is tried again."""

    workers: int = 5
    timeout: float = 600.0
    retries: int = 1


def prompt_of(task: str, **parts: Column) -> Column:
    """:func:`quern.plans.prompts.prompt` as an expression."""
    head = prompts.prompt(task)
    shown = [F.when(empty_if_null(c) != "", F.concat(F.lit(f"{name.upper()}\n"), c)) for name, c in parts.items()]
    return F.concat(F.lit(head), F.array_join(F.array_compact(F.array(*shown)), "\n\n"))


def run_calls(inputs: list, call: Callable[[object], object], how: Calls) -> list[tuple[object, str | None, float]]:
    """For each input the result, the error if there is one, and the seconds that it took; None is not called. A call that
    takes longer than ``timeout``, counted from its start, is given up: its thread ends with the worker at the latest."""
    started: dict[tuple[int, int], float] = {}

    def one(key: tuple[int, int], value: object) -> object:
        started[key] = time.time()
        return call(value)

    pool = ThreadPoolExecutor(how.workers)
    out: list[tuple[object, str | None, float]] = [(None, None, 0.0)] * len(inputs)
    try:
        left = [i for i, x in enumerate(inputs) if x is not None]
        for attempt in range(how.retries + 1):
            futures = {i: pool.submit(one, (attempt, i), inputs[i]) for i in left}
            failed = []
            for i, future in futures.items():
                key, waiting = (attempt, i), time.time()
                while key not in started and not future.done() and time.time() - waiting < how.timeout:
                    time.sleep(0.005)
                begun = started.get(key, waiting)
                try:
                    out[i] = future.result(max(0.0, begun + how.timeout - time.time())), None, time.time() - begun
                except TookTooLong:
                    out[i] = None, "timeout", how.timeout
                    failed.append(i)
                except Exception as e:  # whatever a model raises is the row's result
                    out[i] = None, (str(e) or type(e).__name__)[:200], time.time() - begun
                    failed.append(i)
            left = failed
            if not left:
                break
            if any(out[i][1] == "timeout" for i in left):  # stuck threads don't take the places of the next attempt
                pool.shutdown(wait=False, cancel_futures=True)
                pool = ThreadPoolExecutor(how.workers)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out


def _mapped(df: DataFrame, columns: list[str], call: Callable[[tuple], object], kind: str, arrow: pa.DataType, how: Calls, out: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            got = run_calls([None if r[0] is None else r for r in rows], call, how)
            yield pa.record_batch([*batch.columns, pa.array([g[0] for g in got], arrow), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.float64())], [*batch.schema.names, out, f"{out}_error", f"{out}_time"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` {kind}, `{out}_error` string, `{out}_time` double")


def call_model(df: DataFrame, task: str, prompt: Column, model: Model, how: Calls = Calls(), out: str = "reply") -> DataFrame:
    """``df`` with the model's ``reply`` to the prompts of a task, ``reply_error`` and ``reply_time``. A null prompt is not sent."""
    heat = prompts.temperature(task)
    return _mapped(df.withColumn("_prompt", prompt), ["_prompt"], lambda r: model.generate(r[0], heat), "string", pa.string(), how, out).drop("_prompt")


def generated(df: DataFrame, model: Model, self_correct: bool = True, how: Calls = Calls()) -> DataFrame:
    """G1, G2. ``df`` (query, context, ...) with ``answer``, ``corrections``, ``answer_error`` and ``answer_time``."""
    kind = pa.struct([("text", pa.string()), ("corrections", pa.int32())])

    def call(row: tuple) -> dict:
        text, done = replied(model, row[0], row[1] or "", self_correct)
        return {"text": text, "corrections": done}

    got = _mapped(df, ["query", "context"], call, "struct<text:string,corrections:int>", kind, how, "answer")
    return got.withColumns({"corrections": F.coalesce("answer.corrections", F.lit(0)), "answer": empty_if_null(F.col("answer.text"))})


def answered(engine: Engine, queries: DataFrame, most_turns: int = 0, self_correct: bool = True, how: Calls = Calls()) -> DataFrame:
    """G4 for a table of questions: (query_id, query), ids distinct. Per question: query_id, query, query_type, answer,
    citations, relevant_docs, relevant_articles, confidence, n_chunks, predicted_articles, corrections, error, time."""
    c, model, retriever = engine.config, engine.model, engine.retriever
    asked = written(queries.select("query_id", "query"), "questions")
    empty = F.array().cast("array<string>")
    ordered = lambda chunks: engine._ordered(chunks, "").drop("query").join(asked, "query_id")

    analysed = call_model(asked, "ANALYSE", prompt_of("ANALYSE", question=F.col("query")), model, how, "analysis")
    thought = call_model(analysed, "HYPOTHETICAL", F.when(fusion.situational_query(F.col("query")), prompt_of("HYPOTHETICAL", question=F.col("query"))), model, how, "passage")
    parsed = t.parse_json(F.col("analysis"), "laws array<string>, search_queries array<string>")
    more = F.concat(F.array(t.strip(empty_if_null("passage"))), F.coalesce(parsed["search_queries"], empty))
    planned = written(thought.select("query_id", "query", F.coalesce(parsed["laws"], empty).alias("laws"), more.alias("expansions"), F.coalesce("analysis_error", "passage_error").alias("error"), (F.col("analysis_time") + F.col("passage_time")).alias("time")), "planned")

    titles = None
    if engine.titles is not None:
        names = planned.select("query_id", F.posexplode("laws").alias("pos", "name")).withColumn("name_id", F.concat_ws("/", F.col("query_id").cast("string"), F.col("pos").cast("string")))
        if not names.isEmpty():
            found = lawmatch.match(names.select("name_id", "name"), engine.titles).filter("title IS NOT NULL")
            titles = written(names.join(found, "name_id").select("query_id", "title").distinct(), "titles")
    search = planned.select("query_id", "query", "expansions")
    if titles is None:
        got = plans.multi_query(retriever, search, c.retrieval_top_k, engine.embed)
    else:
        known = titles.select("query_id").distinct()
        with_laws = plans.multi_query(retriever, search.join(known, "query_id", "left_semi"), 4 * c.retrieval_top_k, engine.embed, titles)
        got = plans.multi_query(retriever, search.join(known, "query_id", "left_anti"), c.retrieval_top_k, engine.embed).unionByName(fusion.only_matched(with_laws, titles))
    every = written(ordered(got).filter(F.col("rank") <= 2 * c.retrieval_top_k).withColumn("turn", F.lit(0)), "found")

    going = asked
    for turn in range(1, (most_turns or c.agentic_max_iterations) + 1):
        best = rerank(ordered(every.join(going.select("query_id"), "query_id", "left_semi")), c.rerank_top_k, engine.scorer)
        shown = going.join(assembly.summary(best), "query_id", "left")
        assessed = call_model(shown, "ASSESS", prompt_of("ASSESS", question=F.col("query"), found=F.col("summary")), model, how, "assessment")
        says = t.parse_json(F.col("assessment"), "is_complete boolean, follow_up_queries array<string>")
        follow = written(assessed.select("query_id", F.coalesce(says["is_complete"], F.lit(True)).alias("_done"), F.coalesce(says["follow_up_queries"], empty).alias("_next")).filter(~F.col("_done") & (F.size("_next") > 0)).select("query_id", F.element_at("_next", 1).alias("query"), F.slice("_next", F.lit(2), F.size("_next")).alias("expansions")), "follow")
        if follow.isEmpty():
            break
        new = plans.multi_query(retriever, follow, c.retrieval_top_k // 2, engine.embed, titles, every)
        new = written(ordered(new).withColumns({"turn": F.lit(turn), "source": F.lit(f"agent_iter_{turn}")}), "found")
        if new.isEmpty():
            break
        going = asked.join(new.select("query_id").distinct(), "query_id", "left_semi")
        every = every.unionByName(new, allowMissingColumns=True)

    final = written(reconstruct(rerank(ordered(every), c.rerank_top_k, engine.scorer)), "final")
    contexts = engine._contexts(final.filter(F.col("rank") <= 2 * c.agentic_top_k), c.score_threshold)
    answers = written(generated(asked.join(contexts, "query_id", "left"), model, self_correct, how), "answers")
    used = written(assembly.used(final, answers.select("query_id", "answer"), c.final_top_k), "used")
    out = answers.withColumn("citations", assembly.citations(F.col("answer")))
    for part in (assembly.relevant(used), assembly.confidence(final), used.groupBy("query_id").agg(F.count("*").cast("int").alias("n_chunks")), assembly.predictions(used), planned.select("query_id", "error", F.col("time").alias("_before"))):
        out = out.join(part, "query_id", "left")
    lists = {n: F.coalesce(n, empty) for n in ("citations", "relevant_docs", "relevant_articles", "predicted_articles")}
    return out.withColumns(lists).select(
        "query_id", "query", F.lit("agentic").alias("query_type"), "answer", *lists, F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "corrections", F.coalesce("error", "answer_error").alias("error"), (F.col("_before") + F.col("answer_time")).alias("time"))


def evaluated(engine: Engine, questions: DataFrame, folder: str, size: int = 50, retry: bool = False, how: Calls = Calls()) -> DataFrame:
    """M7, L11, J10, U6, S20, S21. ``questions``: (query_id, question, reference_articles). All batches in one job: those
    without a result yet (with ``retry`` also those of :func:`quern.operators.metrics.to_run`) are answered together, results
    are kept in the folder by batch, in the order of their ids, and the summary has a row a batch."""
    spark = questions.sparkSession
    placed = number_rows(questions.withColumn("query_id", F.col("query_id").cast("string")), ["query_id"]).withColumn("batch", F.floor(F.col("idx") / size))
    rows = written(placed.select("batch", "query_id", F.col("question").alias("query"), F.coalesce("reference_articles", F.array().cast("array<string>")).alias("reference_articles")), "questions")
    path, done = f"{folder}/results", None
    kind = "query_id string, query string, reference_articles array<string>, query_type string, answer string, citations array<string>, relevant_docs array<string>, relevant_articles array<string>, predicted_articles array<string>, confidence double, n_chunks int, corrections int, error string, time double, batch long"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    todo = rows
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        done = written(spark.read.schema(kind).parquet(path), "done")
        state = done.select("query_id", F.col("predicted_articles").alias("predicted"), "error")
        todo = metrics.to_run(rows, state) if retry else rows.join(state.select("query_id"), "query_id", "left_anti")
    new = answered(engine, todo.select("query_id", "query"), how=how).join(rows.select("batch", "query_id", "reference_articles"), "query_id")
    new = written(new.select(*(x.split()[0] for x in kind.split(", "))), "new")
    merged = new if done is None else metrics.merge_results(done, new)
    merged.repartition("batch").sortWithinPartitions("batch", "query_id").write.mode("overwrite").partitionBy("batch").parquet(path)
    results = spark.read.schema(kind).parquet(path)
    traces = results.select("batch", "query_id", F.col("reference_articles").alias("truth"), F.col("predicted_articles").alias("predicted"), "error", "time")
    summary = metrics.batch_summary(traces)
    summary.coalesce(1).write.mode("overwrite").parquet(f"{folder}/summary")
    return spark.read.parquet(f"{folder}/summary").orderBy("batch")
