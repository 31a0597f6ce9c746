"""Operator 12, vector code compression: product codes from weighted Lloyd rounds over distinct integer parts.

A component x becomes the integer floor(4096 * x); a vector is cut into equal consecutive parts. Equal parts of one position
become one row with a weight (a partial aggregation, so many copies of a vector are as cheap as one), and the rounds run over
these rows only: tasks assign them to the nearest entry of their position's codebook and return weighted sums, of which the
driver gets one row an entry. The final codes and errors of the distinct parts are joined back to the vectors. Keys that hold
a thousandth of all rows or more - a thousand at most - are joined by broadcast, so no common vector comes together in a task.

All arithmetic is in 64-bit integers. Rows whose vector is null, holds null or non-finite components, or has another length
than the vector of the smallest id are dropped; a component so large that the squared distances of a vector might not fit 64
bits raises an error. Repeated rows count, and are returned, each time; ids that repeat are told apart by their vectors where
the first codebook is taken; null ids come last; null labels are one label; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows with a key as common as one of so many are joined by broadcast: there are at most so many such keys.
HEAVY = 1000
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component (NaN is above infinity)."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def largest(dims: int) -> int:
    """Integers of at most this size have squared distances whose sum over a vector fits 64 bits."""
    return math.isqrt((2**63 - 1) // dims) // 2


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of (rows, dims)."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() > largest(values.shape[1]):
        raise ArithmeticError(f"components beyond {largest(values.shape[1]) // SCALE} don't fit the 64-bit arithmetic of squared distances")
    return scaled.astype(np.int64)


def packed(part: np.ndarray) -> list[bytes]:
    """Rows of integers, each in the narrowest of three widths, so that equal parts have equal bytes."""
    size = np.abs(part).max(1, initial=0)
    out: list[bytes] = [b""] * len(part)
    for k, width in enumerate(_WIDTHS):
        fits = size <= np.iinfo(width).max
        if k:
            fits &= size > np.iinfo(_WIDTHS[k - 1]).max
        rows = np.ascontiguousarray(part[fits].astype(width))
        for i, row in zip(np.flatnonzero(fits).tolist(), rows, strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(parts: list[bytes], size: int) -> np.ndarray:
    """The rows of :func:`packed`, each of ``size`` integers."""
    out = np.empty((len(parts), size), np.int64)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    for width in _WIDTHS:
        at = np.flatnonzero(length == size * width.itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(parts[i] for i in at), width).reshape(-1, size)
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lower index of equal ones) and its squared distance."""
    apart = ((rows[:, None, :] - book[None]) ** 2).sum(2)
    code = apart.argmin(1)
    return code, apart[np.arange(len(rows)), code]


def _cut(parts: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            values = integers(flat.reshape(batch.num_rows, -1))
            by_place = [packed(p) for p in np.split(values, parts, axis=1)]
            edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts)
            flat_parts = pa.array([p for row in zip(*by_place, strict=True) for p in row], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edges, flat_parts)], ["vec_id", "label", "parts"])

    return cut


def _places(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of rows (place, part, ...): each place that occurs, where, and the integers there."""
    place = batch.column(0).to_numpy(zero_copy_only=False)
    for p in np.unique(place):
        at = np.flatnonzero(place == p)
        yield int(p), at, unpacked(pc.take(batch.column(1), pa.array(at)).to_pylist(), books[p].shape[1])


def _sums(books: list[np.ndarray]):
    """Rows (place, part, n) to (place, code, n, weighted sums of the components), an entry once a batch."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            out: tuple[list, ...] = ([], [], [], [])
            for place, at, rows in _places(batch, books):
                code, n = nearest(rows, books[place])[0], weight[at]
                for k in np.unique(code).tolist():
                    own = code == k
                    for column, value in zip(out, (place, k, int(n[own].sum()), (rows[own] * n[own, None]).sum(0).tolist()), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["place", "code", "n", "sums"])

    return sums


def _coded(books: list[np.ndarray]):
    """Rows (place, part, n) with their code and squared distance."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for place, at, rows in _places(batch, books):
                code[at], error[at] = nearest(rows, books[place])
            yield pa.record_batch([*batch.columns, pa.array(code), pa.array(error)], ["place", "part", "n", "code", "err"])

    return coded


def fitted(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weighted Lloyd rounds over ``distinct`` (place, part, n). The driver sees a row an entry and round."""
    for _ in range(rounds):
        size = max(b.shape[1] for b in books)
        found = distinct.mapInArrow(_sums(books), "place int, code int, n long, sums array<long>").groupBy("place", "code").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)))
        books = [b.copy() for b in books]
        for r in found.collect():
            books[r.place][r.code] = [r[f"s{i}"] // r.n for i in range(size)]
    return books


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row for each of ``keys`` (null is a key) and says in ``weight`` how
    many of the rows hold it. The heavy keys are at most ``HEAVY`` and are broadcast; the others meet by a shuffle."""
    own = table.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = lambda t: reduce(lambda a, b: a & b, (rows[k].eqNullSafe(t[f"_on_{k}"]) for k in keys))
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = own.filter(F.col(weight) * HEAVY >= total).drop(weight)
    light = own.filter(F.col(weight) * HEAVY < total).drop(weight)
    names = [f"_on_{k}" for k in keys]
    hot = rows.join(F.broadcast(heavy), on(heavy), "inner").drop(*names)
    only = heavy.select(*names)
    rest = rows.join(F.broadcast(only), on(only), "left_anti")
    return hot.unionByName(rest.join(light, reduce(lambda a, b: a & b, (rest[k].eqNullSafe(light[n]) for k, n in zip(keys, names, strict=True))), "inner").drop(*names))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    ``entries`` is at most 256, and the length of the vectors a multiple of ``parts``.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kind, label = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_v")).filter(usable(F.col("_v")))
    ordered = [F.asc_nulls_last("vec_id"), F.asc("_v")]
    first = own.orderBy(*ordered).limit(1).collect()
    out = f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string"
    if not first or not first[0]["_v"]:
        return vectors.sparkSession.createDataFrame([], out)
    dims = len(first[0]["_v"])
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    own = own.filter(F.size("_v") == dims)
    start = integers(np.array([r["_v"] for r in own.orderBy(*ordered).limit(entries).collect()]))
    books = np.split(start, parts, axis=1)

    cut = written(own.mapInArrow(_cut(parts), f"vec_id {kind}, label {label}, parts array<binary>").withColumn("_row", F.monotonically_increasing_id()), "parts")
    tall = cut.select("_row", "vec_id", "label", F.posexplode("parts").alias("place", "part"))
    distinct = written(tall.groupBy("place", "part").agg(F.count("*").alias("n")), "distinct")
    books = fitted(distinct, books, rounds)
    coded = written(distinct.mapInArrow(_coded(books), "place int, part binary, n long, code int, err long"), "coded")
    met = looked_up(tall, coded, ["place", "part"], "n")
    digits = F.lower(F.lpad(F.hex("code"), 2, "0"))
    whole = met.groupBy("_row", "vec_id", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", digits.alias("d")))), lambda x: x["d"]), "").alias("code"), F.sum("err").alias("error"))
    whole = written(whole.drop("_row"), "codes")
    discard(distinct, coded, cut)
    by_label = written(whole.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    told = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return looked_up(whole, by_label, ["label"], "_n").select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB over the view ``embeddings``: the rounds, written out."""
    parts = [
        "k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        "p AS (SELECT r, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM k, range(8) t(part))",
        "f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 16)",
        "b0 AS (SELECT part, e, x AS c FROM f JOIN p USING (r))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT r, part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + e) AS m FROM p JOIN b{i} USING (part) GROUP BY r, part)")
        if i < ROUNDS:
            parts.append(f"s{i} AS (SELECT a.part, m % 16 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN p ON p.r = a.r AND p.part = a.part, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL)")
            parts.append(f"n{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{i} GROUP BY part, e)")
            parts.append(f"b{i + 1} AS (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n ON n.part = b.part AND n.e = b.e)")
    parts += [
        f"o AS (SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"


ORACLE_SQL = _sql()

