"""Queries over the evaluation operators: neighbours among embeddings against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import dense, metrics
from quern.queries.base import query, table
from quern.sources.readers import evaluation_set, last_results

_RESULTS = """
top AS (SELECT q.vec_id AS query_id, v.vec_id AS idx, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 12) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 50),
pr AS (SELECT query_id, list('V' || idx ORDER BY score DESC, idx) AS predicted FROM top GROUP BY query_id),
tr AS (SELECT q.vec_id AS query_id, list('v' || v.vec_id ORDER BY v.vec_id) AS truth FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id),
r AS (SELECT query_id, list_transform(coalesce(truth, []), lambda x: {0}(x)) AS truth, list_transform(predicted, lambda x: {0}(x)) AS predicted FROM pr JOIN tr USING (query_id))"""
_LIB, _BENCH = _RESULTS.format("upper"), _RESULTS.format("lower")
_COUNTS = """
u AS (SELECT DISTINCT unnest(truth) AS l FROM r),
c AS (SELECT query_id, len(list_intersect(predicted, truth)) AS tp, len(list_filter(list_distinct(predicted), lambda x: list_contains(ul, x))) - len(list_intersect(predicted, truth)) AS fp, len(list_distinct(truth)) - len(list_intersect(predicted, truth)) AS fn FROM r, (SELECT list(l) AS ul FROM u)),
f AS (SELECT *, CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5.0 * tp / (5 * tp + 4 * fn + fp) ELSE 0 END AS f2 FROM c)"""
_F2 = "SELECT round(avg(f2), 6) AS macro_f2, round(5.0 * sum(tp) / nullif(5 * sum(tp) + 4 * sum(fn) + sum(fp), 0), 6) AS micro_f2, round(1.0 * sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS micro_precision, round(1.0 * sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS micro_recall, count(*) AS num_queries, (SELECT count(*) FROM u) AS num_articles FROM f"


def _results(spark, sf_dir):
    """Truth: vectors of the query's label; predictions: the 50 nearest, named in capitals."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.filter(F.col("vec_id") % 100 == 0)
    near = dense.search(v.select(F.col("vec_id").alias("idx"), "embedding"), queries.select(F.col("vec_id").alias("query_id"), "embedding"), 50)
    predicted = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "idx"))), lambda s: F.concat(F.lit("V"), s["idx"].cast("string"))).alias("predicted"))
    own = queries.select(F.col("vec_id").alias("query_id"), "label").join(v.select("label", "vec_id"), "label")
    truth = own.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("vec_id")), lambda i: F.concat(F.lit("v"), i.cast("string"))).alias("truth"))
    return predicted.join(truth, "query_id", "left").withColumn("truth", F.coalesce("truth", F.array().cast("array<string>")))


def _upper(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.withColumn("truth", F.transform("truth", F.upper))


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else c for c, k in df.dtypes))


@query(f"WITH {_LIB}, {_COUNTS} {_F2}")
def eval_f2(spark, sf_dir):
    return _rounded(metrics.f2_scores(_upper(spark, sf_dir)))


@query(f"WITH {_BENCH}, {_COUNTS} {_F2}")
def eval_f2_bench(spark, sf_dir):
    return _rounded(metrics.f2_scores(_results(spark, sf_dir), bench=True))


@query(f"WITH {_LIB}, {_COUNTS} SELECT query_id, round(f2, 6) AS f2 FROM f")
def eval_f2_per_query(spark, sf_dir):
    return _rounded(metrics.per_query_f2(_upper(spark, sf_dir)))


def _at(k: int, kind: str) -> str:
    return f"round(avg(len(list_intersect(predicted[1:{k}], truth)) / ({'len(truth)' if kind == 'recall' else k})::DOUBLE), 6) AS \"{kind}@{k}\""


@query(f"WITH {_LIB} SELECT {', '.join(_at(k, kind) for k in metrics.LIB_K for kind in ('recall', 'precision'))} FROM r WHERE len(truth) > 0")
def eval_at_k(spark, sf_dir):
    return _rounded(metrics.at_k(_upper(spark, sf_dir)))


@query(f"WITH {_BENCH} SELECT {', '.join(_at(k, 'recall') for k in metrics.BENCH_K)} FROM r WHERE len(truth) > 0")
def eval_recall_bench(spark, sf_dir):
    return _rounded(metrics.at_k(_results(spark, sf_dir), bench=True))


_RR = "coalesce(1.0 / list_min(list_filter(list_transform(predicted, lambda x, i: CASE WHEN list_contains(truth, x) THEN i END), lambda i: i IS NOT NULL)), 0)"


@query(f"WITH {_LIB} SELECT round(avg({_RR}), 6) AS mrr FROM r WHERE len(truth) > 0")
def eval_mrr(spark, sf_dir):
    return _rounded(metrics.mrr(_upper(spark, sf_dir)))


@query(f"WITH {_BENCH} SELECT round(avg({_RR}), 6) AS mrr FROM r")
def eval_mrr_bench(spark, sf_dir):
    return _rounded(metrics.mrr(_results(spark, sf_dir), bench=True))


@query(f"WITH {_BENCH}, {_COUNTS} SELECT * FROM ({_F2}), (SELECT {', '.join(_at(k, 'recall') for k in metrics.BENCH_K)} FROM r WHERE len(truth) > 0), (SELECT round(avg({_RR}), 6) AS mrr FROM r)")
def eval_report(spark, sf_dir):
    return _rounded(metrics.report(_results(spark, sf_dir), bench=True))


_ERROR = "CASE WHEN query_id % 300 = 0 THEN 'timeout' END"


@query(f"WITH {_BENCH}, t AS (SELECT *, {_ERROR} AS error FROM r), o AS (SELECT * FROM r), {_COUNTS.replace('FROM r, (', 'FROM (SELECT * FROM t WHERE error IS NULL) r, (').replace('unnest(truth) AS l FROM r', 'unnest(truth) AS l FROM t WHERE error IS NULL')} SELECT t.query_id // 1000 AS batch, count(*) AS num_queries, count(error) AS num_errors, round(avg(t.query_id / 1000.0), 6) AS avg_time, round(avg(f2), 6) AS macro_f2 FROM t LEFT JOIN f ON f.query_id = t.query_id GROUP BY batch")
def eval_batch_summary(spark, sf_dir):
    traces = _results(spark, sf_dir).withColumns({"batch": F.floor(F.col("query_id") / 1000), "error": F.expr(_ERROR), "time": F.col("query_id") / 1000.0})
    return _rounded(metrics.batch_summary(traces))


@query("SELECT doc_id AS query_id FROM documents d LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 1 OR quality = 0")
def resume_plan(spark, sf_dir):
    """Done: labelled documents; toxic ones timed out, those of low quality predicted nothing."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.when(F.col("toxic") == 1, "timeout").alias("error"), F.when(F.col("quality") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("predicted"))
    return metrics.to_run(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")), done)


@query("SELECT item_id AS query_id, b.text AS question, coalesce(array_to_string(list_sort(list(DISTINCT c.conv_id::VARCHAR) FILTER (c.conv_id IS NOT NULL)), ','), '') AS refs FROM benchmark b LEFT JOIN conversations c ON c.turn = b.item_id GROUP BY item_id, b.text")
def evaluation_queries(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    qrels = table(spark, sf_dir, "conversations").select(F.col("turn").alias("query_id"), F.col("conv_id").cast("string").alias("corpus_id"))
    return evaluation_set(queries, qrels).select("query_id", "question", F.array_join("reference_articles", ",").alias("refs"))


@query("SELECT conv_id AS query_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def last_result(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role")
    return last_results(lines, "turn").select("query_id", "turn", "role")
