"""Exact inner-product search (V1-V3): blocks of queries against all vectors, with a partial top k in each task."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.bm25 import WORDS, ranked
from quern.storage import discard, pieces, shared_dir, written

#: Queries that are sent to the workers at once.
BLOCK = 1000
#: Products of queries and vectors that a task computes at once.
PRODUCTS = 1 << 18


#: Words whose slots a task keeps.
KEPT = 1 << 18


class _Slots(dict):
    """The slots of the words that a task has met, up to ``KEPT`` of them."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = slot = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dim
        return slot


def hashed_vector(c: Column, dim: int = 64) -> Column:
    """A stand-in for an embedding model: counts of terms by the first 16 bits of their md5, modulo ``dim``, of unit
    length (without any term: zeros). A vectorised UDF: as nested lambdas it would hash each term once a dimension. Words are
    listed for :data:`quern.operators.bm25.WORDS` bytes of text at a time, however long a batch is."""

    def of(texts: list[str | None], slots: _Slots) -> np.ndarray:
        pattern = re.compile(r"\w{2,}")
        found = [pattern.findall((text or "").lower()) for text in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        slot = np.fromiter(map(slots.__getitem__, chain.from_iterable(found)), np.int64, sizes.sum())
        counts = np.bincount(np.repeat(np.arange(len(found)) * dim, sizes) + slot, minlength=len(found) * dim).reshape(len(found), dim).astype(np.float64)
        size = np.linalg.norm(counts, axis=1, keepdims=True)
        return counts / np.where(size > 0, size, 1.0)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots = _Slots(dim)
        for texts in batches:
            out = [of(part.to_pylist(), slots).ravel() for part in pieces(texts, WORDS)]
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), flat)

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(c)


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """V1. A column of unit vectors from a model that takes lists of texts; it runs once a batch in the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.names.index(text_col)).to_pylist()]
            v = np.asarray(model(texts), np.float32).reshape(len(texts), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.record_batch([*batch.columns, pa.array(list(v), pa.list_(pa.float32()))], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` array<float>")


def _top(held, k: int):
    """Rows (idx, embedding, cell) to the best ``k`` of each query of the block; ``held``: the queries as a matrix, and for
    each cell the queries that ask for it (None: all do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, asked = held.value
        best_s, best_i = np.full((len(matrix), k), -np.inf), np.zeros((len(matrix), k), np.int64)
        for batch in batches:
            cells = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            # a batch at a time of one cell, as far as rows lie by cell, and of a bounded number of products
            step = max(64, min(4096, PRODUCTS // max(1, len(matrix))))
            edges = [(a, min(a + step, b)) for c, b in zip(cuts[:-1], cuts[1:], strict=True) for a in range(c, b, step)]
            for a, b in edges:
                who = slice(None) if asked is None else asked.get(int(cells[a]))
                if who is None:
                    continue
                part = batch.slice(a, b - a)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                old_s, old_i = best_s[who], best_i[who]
                s = np.concatenate([old_s, np.round(matrix[who] @ v.T, 12)], axis=1)
                i = np.concatenate([old_i, np.broadcast_to(part.column(0).to_numpy(), (len(old_s), part.num_rows))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s[who], best_i[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        q, at = np.nonzero(best_s > -np.inf)
        yield pa.record_batch([pa.array(q), pa.array(best_i[q, at]), pa.array(best_s[q, at])], ["q", "idx", "score"])

    return run


#: Vectors that a cell has on average, cells at most, and sampled vectors a cell that the centres are fitted on.
PER_CELL, MOST_CELLS, SAMPLE = 4096, 1024, 50
#: Cells of the highest bounds that a search reads first.
FIRST_CELLS = 4


@dataclass
class Cells:
    """Stored vectors: ``vectors`` (cell, idx, embedding), a folder a cell, and ``cells`` (cell, centre, radius, n)."""

    vectors: DataFrame
    cells: DataFrame

    @staticmethod
    def save(vectors: DataFrame, path: str, per_cell: int = PER_CELL, most: int = MOST_CELLS) -> None:
        """V3, S16. Centres are fitted on a bounded sample (``SAMPLE`` vectors a cell, those of the smallest hashes of their
        idx); every vector goes to its nearest centre, and the radius of a cell covers all that it got."""
        spark = vectors.sparkSession
        own = written(_own(vectors), "vectors")
        count = own.count()
        wanted = int(min(most, max(1, count // per_cell)))
        sample = np.array([r.embedding for r in own.orderBy(F.xxhash64("idx"), "idx").limit(SAMPLE * wanted).collect()], np.float64)
        centres = _centres(sample, wanted) if len(sample) else np.zeros((1, 0))
        held = spark.sparkContext.broadcast(centres)
        placed = own.mapInArrow(_placed(held), "idx long, embedding array<double>, cell int, apart double")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        kept = written(placed, "placed")
        kept.select("idx", "embedding", "cell").repartitionByRange(parts, "cell", "idx").sortWithinPartitions("cell", "idx").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        radius = kept.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n"))
        # a row a cell
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        table.join(radius, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        discard(own, kept)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cells:
        kind = "idx long, embedding array<double>, cell int"
        return cls(spark.read.schema(kind).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))


def _centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(wanted, len(sample))).astype(int)]
    for _ in range(8 if len(centres) > 1 else 1):
        code = _nearest(sample, centres)[0]
        total, n = np.zeros_like(centres), np.bincount(code, minlength=len(centres))
        np.add.at(total, code, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)
    return code, np.linalg.norm(rows - centres[code], axis=1)


def _placed(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            code, apart = _nearest(v, held.value)
            yield pa.record_batch([*batch.columns, pa.array(code.astype(np.int32)), pa.array(apart)], ["idx", "embedding", "cell", "apart"])

    return run


def _own(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("embedding").isNotNull()).select(F.col("idx").cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("embedding"))


def _names(spark: SparkSession, queries: DataFrame, rows: list) -> DataFrame:
    """The ids of a block's queries by their place; at most ``BLOCK`` rows."""
    return F.broadcast(spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)], f"q long, query_id {queries.schema['query_id'].dataType.simpleString()}"))


def _of_cells(index: Cells, matrix: np.ndarray, asked: dict[int, np.ndarray], k: int) -> DataFrame:
    held = index.vectors.sparkSession.sparkContext.broadcast((matrix, asked))
    return index.vectors.filter(F.col("cell").isin(list(asked))).select("idx", "embedding", "cell").mapInArrow(_top(held, k), "q long, idx long, score double")


def bounded_block(index: Cells, matrix: np.ndarray, k: int, first: int = FIRST_CELLS) -> tuple[DataFrame, float]:
    """The best ``k`` (q, idx, score, rank) of a block of queries, and the share of pairs of query and cell left unread.

    No vector of a cell has a product above that of its centre plus radius times the query's length. The ``first`` cells of
    the highest bounds give each query k scores (or all cells are read); of the other cells those that can reach the k-th.
    """
    cells = sorted(index.cells.collect(), key=lambda r: r.cell)
    if not cells:
        return index.vectors.sparkSession.createDataFrame([], "q long, idx long, score double, rank long"), 0.0
    number = np.array([r.cell for r in cells])
    centre, radius = np.array([r.centre for r in cells], np.float64), np.array([r.radius for r in cells])
    bound = matrix @ centre.T + radius * np.linalg.norm(matrix, axis=1, keepdims=True)
    order = np.argsort(-bound, axis=1, kind="stable")[:, :first]
    begun = np.zeros(bound.shape, bool)
    np.put_along_axis(begun, order, True, 1)
    by_cell = lambda mask: {int(number[c]): np.flatnonzero(mask[:, c]) for c in np.flatnonzero(mask.any(0))}
    if begun.all():
        return ranked(_of_cells(index, matrix, by_cell(begun), k), k, "q"), 0.0
    found = written(ranked(_of_cells(index, matrix, by_cell(begun), k), k, "q"), "first_cells")
    least = np.full((len(matrix), 1), -np.inf)
    for r in found.filter(F.col("rank") == k).select("q", "score").collect():  # one of each query of the block
        least[r.q] = r.score
    rest = ~begun & (bound >= least - 1e-9)
    skipped = 1 - (begun.sum() + rest.sum()) / bound.size
    if not rest.any():
        return found, skipped
    return ranked(found.drop("rank").unionByName(_of_cells(index, matrix, by_cell(rest), k)), k, "q"), skipped


def search(vectors: DataFrame | Cells, queries: DataFrame, k: int) -> DataFrame:
    """V2, L1. ``vectors``: (idx long, embedding), or stored cells; ``queries``: (query_id, embedding). (query_id, idx, score,
    rank).

    Queries go out in blocks of ``BLOCK``; every task keeps k rows a query, and a window picks the best of those. With more
    than one block, each writes its rows, so that neither the plan nor the driver grows with the queries.
    """
    spark = queries.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(rows: list) -> DataFrame:
        matrix = np.array([r.embedding for r in rows], np.float64)
        if isinstance(vectors, Cells):
            top = bounded_block(vectors, matrix, k)[0]
        else:
            held = spark.sparkContext.broadcast((matrix, None))
            top = ranked(_own(vectors).withColumn("cell", F.lit(0)).mapInArrow(_top(held, k), "q long, idx long, score double"), k, "q")
        return top.join(_names(spark, queries, rows), "q").select("query_id", "idx", "score", "rank")

    rows = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding").toLocalIterator()
    block, path = list(islice(rows, BLOCK)), None
    if not block:
        return spark.createDataFrame([], f"query_id {kind}, idx long, score double, rank long")
    while more := list(islice(rows, BLOCK)):
        path = path or f"{shared_dir(spark)}/found"
        run(block).write.mode("append").parquet(path)
        block = more
    if path is None:
        return run(block)
    run(block).write.mode("append").parquet(path)
    return spark.read.parquet(path)
