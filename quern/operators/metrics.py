"""Retrieval evaluation (M1-M5, A7-A9, P15-P16, S21). ``results``: (query_id, truth array, predicted array).

Two conventions: ``lib`` keeps the case of labels and skips queries without truth in the reciprocal rank; ``bench``
lower-cases labels and counts such queries as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIB_K, BENCH_K = (5, 10, 20, 50), (1, 5, 10, 20, 50)


def _cased(results: DataFrame, bench: bool) -> DataFrame:
    low = lambda c: F.transform(c, F.lower) if bench else F.col(c)
    return results.select("query_id", low("truth").alias("truth"), low("predicted").alias("predicted"))


def counts(results: DataFrame, bench: bool = False) -> DataFrame:
    """Per query tp, fp, fn. Predictions that are nobody's truth don't count."""
    own = _cased(results, bench)
    true = own.select("query_id", F.explode(F.array_distinct("truth")).alias("label")).withColumn("t", F.lit(1))
    guess = own.select("query_id", F.explode(F.array_distinct("predicted")).alias("label")).withColumn("p", F.lit(1)).join(true.select("label").distinct(), "label", "left_semi")
    both = true.join(guess, ["query_id", "label"], "full_outer")
    hit = both.groupBy("query_id").agg(F.count_if(F.expr("t = 1 AND p = 1")).alias("tp"), F.count_if(F.expr("t IS NULL")).alias("fp"), F.count_if(F.expr("p IS NULL")).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.select("query_id").join(hit, "query_id", "left").select("query_id", zero("tp"), zero("fp"), zero("fn"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f2(tp: Column, fp: Column, fn: Column) -> Column:
    return _share(5 * tp, 5 * tp + 4 * fn + fp)


def f2_scores(results: DataFrame, bench: bool = False) -> DataFrame:
    """M1. One row: macro_f2, micro_f2, micro_precision, micro_recall, num_queries, num_articles."""
    per = counts(results, bench)
    s = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn")}
    total = per.agg(F.avg(f2(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f2"), f2(s["tp"], s["fp"], s["fn"]).alias("micro_f2"), _share(s["tp"], s["tp"] + s["fp"]).alias("micro_precision"), _share(s["tp"], s["tp"] + s["fn"]).alias("micro_recall"), F.count("*").alias("num_queries"), F.lit(1).alias("_one"))
    labels = _cased(results, bench).select(F.explode("truth").alias("l")).agg(F.count_distinct("l").alias("num_articles"), F.lit(1).alias("_one"))
    return total.join(labels, "_one").drop("_one")


def per_query_f2(results: DataFrame, bench: bool = False) -> DataFrame:
    return counts(results, bench).select("query_id", f2(F.col("tp"), F.col("fp"), F.col("fn")).alias("f2"))


def at_k(results: DataFrame, bench: bool = False) -> DataFrame:
    """M2. One row: recall@k and, in the library's convention, precision@k. Queries without truth are skipped; the
    denominators are the length of the truth, repetitions included, and k."""
    own = _cased(results, bench).filter(F.size("truth") > 0)
    out = []
    for k in BENCH_K if bench else LIB_K:
        hits = F.size(F.array_intersect(F.slice("predicted", 1, k), F.col("truth")))
        out.append(F.coalesce(F.avg(hits / F.size("truth")), F.lit(0.0)).alias(f"recall@{k}"))
        if not bench:
            out.append(F.coalesce(F.avg(hits / F.lit(k)), F.lit(0.0)).alias(f"precision@{k}"))
    return own.agg(*out)


def mrr(results: DataFrame, bench: bool = False) -> DataFrame:
    """M3, W8. One row: mrr."""
    own = _cased(results, bench)
    if not bench:
        own = own.filter(F.size("truth") > 0)
    at = F.array_min(F.transform(F.filter(F.transform("predicted", lambda x, i: F.struct(x.alias("l"), (i + 1).alias("r"))), lambda s: F.array_contains("truth", s["l"])), lambda s: s["r"]))
    return own.agg(F.coalesce(F.avg(F.coalesce(1 / at, F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def report(results: DataFrame, bench: bool = False) -> DataFrame:
    """M4, M5. All of these in one row."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(f2_scores(results, bench)).join(one(at_k(results, bench)), "_one").join(one(mrr(results, bench)), "_one").drop("_one")


def batch_summary(traces: DataFrame) -> DataFrame:
    """A9, S21, M7. ``traces``: (batch, query_id, truth, predicted, error, time). Per batch: queries, errors, average time
    (errors included) and the bench F2 of rows without an error."""
    ok = traces.filter("error IS NULL")
    per = counts(ok, True).select("query_id", f2(F.col("tp"), F.col("fp"), F.col("fn")).alias("f2"))
    return traces.join(per, "query_id", "left").groupBy("batch").agg(F.count("*").alias("num_queries"), F.count("error").alias("num_errors"), F.avg(F.coalesce("time", F.lit(0.0))).alias("avg_time"), F.avg("f2").alias("macro_f2"))


RETRIED = ("timeout", "ALL_FAILED")


def to_run(queries: DataFrame, done: DataFrame) -> DataFrame:
    """P15, J10. Queries that are not done, or whose result is a retried error or empty without an error.

    ``done``: (query_id, predicted, error).
    """
    state = done.select("query_id", F.lit(True).alias("_done"), (F.col("error").isin(*RETRIED) | (F.coalesce("error", F.lit("")) == "") & (F.coalesce(F.size("predicted"), F.lit(0)) <= 0)).alias("_again"))
    return queries.join(state, "query_id", "left").filter(F.col("_done").isNull() | F.coalesce("_again", F.lit(False))).drop("_done", "_again")


def merge_results(done: DataFrame, new: DataFrame) -> DataFrame:
    """U6. New results replace old ones of the same query."""
    return done.join(new.select("query_id"), "query_id", "left_anti").unionByName(new, allowMissingColumns=True)
