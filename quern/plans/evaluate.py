"""The evaluation runner (M6, M7, S20, L10, L11, J10, U6): batches of questions, kept results, metrics, and their sinks.

A batch's folder holds ``partial`` (a row a question and attempt, appended as blocks of questions end), ``detail`` (the
last row of each question, in the order of its id), ``trace`` (the same with answers and citations) and ``metrics`` (one
row, written last: a batch that has it is done). A run that is cut short goes on where it stopped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TookTooLong
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import metrics
from quern.operators.corpus import batch as rows_of_batch
from quern.plans.agent import Result
from quern.sources.readers import last_results, write
from quern.storage import complete

BATCH, WORKERS, TIMEOUT, MOST = 50, 5, 600.0, 50
TRACE = "query_id string, question string, reference_articles array<string>, predicted_articles array<string>, query_type string, confidence double, answer string, citations array<string>, relevant_articles array<string>, num_chunks int, error string, time double, attempt long"
_FIELDS = [f.split()[0] for f in TRACE.split(", ")]


def predicted(result: Result, most: int = MOST) -> list[str]:
    """T29. The first ``most`` distinct ``code#article`` of a result's chunks."""
    ids = [f"{c['so_ky_hieu']}#{c['article_id']}" for c in result.chunks if c.get("so_ky_hieu") and c.get("article_id")]
    return list(dict.fromkeys(ids))[:most]


def answered(answer: Callable[[str], Result], rows: list, workers: int = WORKERS, timeout: float = TIMEOUT) -> Iterator[dict]:
    """M6. A record for each row (query_id, question, reference_articles), in order. A question that takes longer than
    ``timeout`` seconds, counted from its start, or fails, has an ``error`` and no predictions."""
    started: dict[int, float] = {}

    def one(i: int, question: str) -> tuple[Result, float]:
        started[i] = time.time()
        return answer(question), time.time() - started[i]

    pool = ThreadPoolExecutor(workers)
    futures = [pool.submit(one, i, r.question) for i, r in enumerate(rows)]
    try:
        for i, (r, future) in enumerate(zip(rows, futures, strict=True)):
            record = dict.fromkeys(_FIELDS) | {"query_id": str(r.query_id), "question": r.question, "reference_articles": list(r.reference_articles or []), "predicted_articles": [], "time": 0.0}
            waiting = time.time()
            try:
                # a question that waits for a worker behind stuck ones has no longer than they
                while i not in started and not future.done() and time.time() - waiting < timeout:
                    time.sleep(0.01)
                result, took = future.result(max(0.0, started.get(i, waiting) + timeout - time.time()))
                record |= {"predicted_articles": predicted(result), "query_type": result.query_type, "confidence": float(result.confidence), "answer": result.answer, "citations": list(result.citations), "relevant_articles": list(result.relevant_articles), "num_chunks": len(result.chunks), "time": took}
            except TookTooLong:
                record |= {"error": "timeout", "time": float(timeout)}
            except Exception as e:  # whatever a model or a plan raises is the question's result
                record |= {"error": (str(e) or type(e).__name__)[:200], "time": time.time() - started.get(i, waiting)}
            yield record
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _results(spark: SparkSession, folder: str) -> DataFrame | None:
    path = f"{folder}/partial"
    return last_results(spark.read.schema(TRACE).json(path), "attempt") if complete(spark, path) else None


def run_batch(spark: SparkSession, answer: Callable[[str], Result], questions: DataFrame, number: int, folder: str, size: int = BATCH, workers: int = WORKERS, timeout: float = TIMEOUT, retry: bool = False) -> DataFrame:
    """M7 for one batch: answers its questions that have no result yet (with ``retry`` also those of
    :func:`quern.operators.metrics.to_run`), writes the sinks, and returns the metrics.

    ``questions``: (query_id, question, reference_articles).
    """
    own = rows_of_batch(questions.withColumn("query_id", F.col("query_id").cast("string")), number, size)
    done, todo = _results(spark, folder), own
    if done is not None:
        state = done.select("query_id", F.col("predicted_articles").alias("predicted"), "error")
        todo = metrics.to_run(own, state) if retry else own.join(state.select("query_id"), "query_id", "left_anti")
    rows = iter(todo.orderBy("query_id").collect())  # at most ``size``
    while block := list(islice(rows, max(1, workers))):
        records = [r | {"attempt": time.time_ns()} for r in answered(answer, block, workers, timeout)]
        spark.createDataFrame([tuple(r[f] for f in _FIELDS) for r in records], TRACE).coalesce(1).write.mode("append").json(f"{folder}/partial")
    results = _results(spark, folder) or spark.createDataFrame([], TRACE)
    ordered = own.select("query_id").join(results, "query_id").coalesce(1).sortWithinPartitions("query_id")
    write(ordered.select("query_id", "question", "reference_articles", "predicted_articles", "error", "time"), f"{folder}/detail", "json")
    write(ordered.drop("attempt"), f"{folder}/trace", "json")
    valid = ordered.filter("error IS NULL").select("query_id", F.col("reference_articles").alias("truth"), F.col("predicted_articles").alias("predicted"))
    counted = ordered.agg(F.count("error").alias("num_errors"), F.coalesce(F.avg("time"), F.lit(0.0)).alias("avg_time")).withColumn("batch_idx", F.lit(number))
    one = lambda df: df.withColumn("_one", F.lit(1))
    write(one(metrics.report(valid, bench=True)).join(one(counted), "_one").drop("_one"), f"{folder}/metrics")
    return spark.read.parquet(f"{folder}/metrics")


def run_all(spark: SparkSession, answer: Callable[[str], Result], questions: DataFrame, folder: str, first: int = 0, last: int | None = None, size: int = BATCH, force: bool = False, **how) -> DataFrame:
    """M7. Batches ``first`` to ``last`` (all, if None) one after the other; those that have metrics are skipped unless
    ``force`` says otherwise. Returns the metrics of these batches, by ``batch_idx``."""
    count = -(-questions.count() // size)
    out = None
    for number in range(first, min(count, count if last is None else last + 1)):
        own = f"{folder}/batch{number}"
        ready = complete(spark, f"{own}/metrics") and not force
        got = spark.read.parquet(f"{own}/metrics") if ready else run_batch(spark, answer, questions, number, own, size, **how)
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no batch in that range")
    return out.orderBy("batch_idx")
