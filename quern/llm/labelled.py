"""Bounded, deterministic samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold

#: At most so many labelled documents of each class train a classifier.
SAMPLE_PER_CLASS = 2000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS, modulus: int = 5, held_out: int = 0) -> tuple[list[bytes], list[int], list[int], list[float]]:
    """Whole texts, labels, hashes and weights of the training rows: at most ``per_class`` ids of each class, those of
    the smallest hash of the id, never from the held-out fold.

    The weights restore the share that each class has among all training labels. A document labelled more than once
    counts as 1 if any of its labels is 1; null labels and ids don't count; a repeated document counts each time.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y IN (0, 1) AND _id IS NOT NULL").filter(fold(F.col("_id"), modulus) != held_out).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.withColumn("_h", F.xxhash64("_id"))
    count = {r._y: r.n for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    rows = [r for y in (0, 1) for r in known.filter(F.col("_y") == y).orderBy("_h", "_id").limit(per_class).collect()]
    if not rows:
        return [], [], [], []
    # at most 2 * per_class rows of three numbers: the bound that allows the broadcast
    chosen = docs.sparkSession.createDataFrame(rows, known.schema)
    found = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(chosen), "_id").select("_h", "_y", F.coalesce("_t", F.lit("")).alias("_t")).toArrow()
    order = sorted(range(found.num_rows), key=(h := found.column("_h").to_pylist()).__getitem__)
    ys, ts = found.column("_y").to_pylist(), found.column("_t")
    got = [ys.count(0), ys.count(1)]
    total = sum(count.values())
    weight = [count.get(y, 0) / total / max(1, got[y]) * len(ys) for y in (0, 1)]
    return [ts[i].as_py().encode() for i in order], [ys[i] for i in order], [h[i] for i in order], [weight[ys[i]] for i in order]
