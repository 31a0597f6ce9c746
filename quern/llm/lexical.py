r"""Operator 13, ranked lexical search: three-phase uniform thresholds (TPUT) over term-partitioned postings.

Postings lie in ranges of documents (a slice of a task's rows, at most ``RANGE`` bytes of text), and within a range by term: a
list holds the documents of the range by falling impact, so its head is where it starts. Lists of a common term are spread
over all ranges, and no posting is shuffled. A list's value for a query item is the term's weight times the impact, all in
64-bit integers. The phases, for all items of a block at once, each a pass over the ranges whose tasks return at most ``k``
rows an item and range:

1. The heads - the ``k`` highest impacts of each list - give partial sums; the k-th best of an item is a lower bound.
2. The bound divided by the item's number of lists is the threshold: from every list all values from the threshold up are
   fetched, the same for each list. Their sums give a better bound.
3. A document stays a candidate if its sum, with less than the threshold (or the list's head, if that is lower) for each list
   that it was not fetched from, can reach the better bound; equal scores stay. What candidates have below the threshold is
   looked up in the lists, and exact scores are ranked.

Items with fewer than ``k`` documents have the threshold 1, which fetches all. Items go out in blocks of ``ITEMS``; the lists
are built for the terms that items ask for, if these are at most ``TERMS``, else for all terms.

Terms are the runs of letters, digits and characters beyond ASCII, lower-cased in A-Z. Rows are documents: repeated rows
count, and are ranked, each time; null texts have no terms and are not among the N documents; null ids are ranked after
others of equal score. Repeated items are answered each; an item without known terms has no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import byte_texts, shared_dir, slices, written

#: Highest-scoring documents of an item; items of a block; terms up to which an index holds those that are asked for only.
K, ITEMS, TERMS = 50, 1000, 1_000_000
#: Bytes of text whose postings are one range.
RANGE = 16 << 20
#: Each byte as part of a lower-cased term, or a blank.
_TERM_BYTES = bytes(i if i >= 0x80 else ord(chr(i).lower()) if chr(i).isalnum() else 0x20 for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text, in order."""
    return text.translate(_TERM_BYTES).split()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0):
        sizes = np.array([len(terms_of(t)) for t in byte_texts(batch.column(0))], np.int64)
        yield pa.record_batch([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], ["docs", "terms"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    r = docs.select("text").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def _range(texts: list[bytes], asked: frozenset[bytes] | None, n_docs: int, n_terms: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The lists of a range: terms, sizes, and rows and impacts, list by list, by falling impact."""
    known: dict[bytes, int] = {}
    code, row, tf, n = [], [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = terms_of(text)
        n[i] = len(words)
        counts = Counter(words if asked is None else filter(asked.__contains__, words))
        code += [known.setdefault(w, len(known)) for w in counts]
        tf += counts.values()
        row += [i] * len(counts)
    term, at, times = (np.array(x, np.int64) for x in (code, row, tf))
    m = 50 + (50 * n * n_docs) // max(1, n_terms)
    impact = (1_000_000_000 * times) // (1000 * times + 20 * m[at])
    order = np.lexsort((at, -impact, term))
    return list(known), np.bincount(term, minlength=len(known)), at[order].astype("<i4"), impact[order].astype("<i4")


def _indexed(asked: frozenset[bytes] | None, n_docs: int, n_terms: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1, RANGE):
            terms, sizes, rows, impacts = _range(byte_texts(batch.column(1)), asked, n_docs, n_terms)
            one = pa.array([0, batch.num_rows], pa.int32()), pa.array([0, len(terms)], pa.int32())
            yield pa.record_batch(
                [pa.array([number]), pa.ListArray.from_arrays(one[0], batch.column(0)), pa.ListArray.from_arrays(one[1], pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(one[1], pa.array(sizes.astype(np.int32))), pa.array([rows.tobytes()], pa.binary()), pa.array([impacts.tobytes()], pa.binary())],
                ["range", "ids", "terms", "sizes", "rows", "impacts"],
            )
            number += 1

    return indexed


@dataclass
class Postings:
    """``ranges`` (range, ids, terms, sizes, rows, impacts), a written table with a row a range; and the N documents."""

    ranges: DataFrame
    n_docs: int


def postings(docs: DataFrame, terms: frozenset[bytes] | None = None, id_col: str = "doc_id") -> Postings:
    """The lists of ``terms``, or of all."""
    n_docs, n_terms = totals(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = docs.select(F.col(id_col).alias("id"), "text").mapInArrow(_indexed(terms, n_docs, n_terms), f"range long, ids array<{kind}>, terms array<string>, sizes array<int>, rows binary, impacts binary")
    return Postings(written(ranges, "postings"), n_docs)


@dataclass
class Item:
    """An item of a block: its terms' weights."""

    weights: dict[str, int]


class Lists:
    """The lists of a range."""

    def __init__(self, row: dict):
        self.docs = len(row["ids"])
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.end = np.cumsum([0, *row["sizes"]])
        self.rows, self.impacts = np.frombuffer(row["rows"], "<i4"), np.frombuffer(row["impacts"], "<i4")

    def of(self, item: Item) -> list[tuple[int, int, int]]:
        """The item's lists here: weight, start, end."""
        at = ((w, self.place.get(t)) for t, w in item.weights.items())
        return [(w, int(self.end[i]), int(self.end[i + 1])) for w, i in at if i is not None]

    def sums(self, parts: list[tuple[int, int, int]], only: np.ndarray | None = None) -> np.ndarray:
        """By document the summed values of the parts of lists (of the documents in ``only``). Sums are below 2**53."""
        total = np.zeros(self.docs)
        for w, a, b in parts:
            rows, impacts = self.rows[a:b], self.impacts[a:b]
            if only is not None:
                met = only[rows]
                rows, impacts = rows[met], impacts[met]
            total[rows] += w * impacts.astype(np.int64)  # a list holds a document once
        return total

    def above(self, part: tuple[int, int, int], least: int) -> int:
        """Where the values of a list fall below ``least``."""
        w, a, b = part
        return a + int(np.searchsorted(-self.impacts[a:b], -(-(-least // w)), side="right"))


def _highest(total: np.ndarray, k: int, least: float) -> np.ndarray:
    """The documents of the k highest sums, and their equals, of at least ``least`` and above 0."""
    own = np.flatnonzero(total >= max(least, 1))
    if len(own) > k:
        own = own[total[own] >= np.partition(total[own], -k)[-k]]
    return own


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _bounds(items: list[Item], k: int, bounds: list[int] | None):
    """A pass for lower bounds: (item, score), the k highest sums of heads, or, with ``bounds``, of what the threshold
    fetches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _ranges(batches):
            lists, out = Lists(row), []
            for i, item in enumerate(items):
                parts = lists.of(item)
                if bounds is None:
                    fetched = [(w, a, min(b, a + k)) for w, a, b in parts]
                else:
                    least = threshold(bounds[i], item)
                    fetched = [(p[0], p[1], lists.above(p, least)) for p in parts]
                total = lists.sums(fetched)
                best = np.sort(total[_highest(total, k, 0)])[-k:]
                out.append(np.stack([np.full(len(best), i), best.astype(np.int64)]))
            both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.record_batch([pa.array(both[0].astype(np.int32)), pa.array(both[1])], ["item", "score"])

    return run


def threshold(bound: int, item: Item) -> int:
    """The value from which on every list is fetched."""
    return max(1, -(-bound // max(1, len(item.weights))))


def _exact(items: list[Item], k: int, first: list[int], better: list[int], kind: pa.DataType):
    """The last pass: (item, score, id, range, row), the k best candidates of the range by exact scores, and their equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _ranges(batches):
            lists, out, ids = Lists(row), ([], [], []), row["ids"]
            for i, item in enumerate(items):
                parts, least = lists.of(item), threshold(first[i], item)
                cut = [(w, a, lists.above((w, a, b), least)) for w, a, b in parts]
                total = lists.sums(cut)
                # what the lists may still give to documents that were not fetched from them
                rest = [min(least - 1, w * int(lists.impacts[a])) for w, a, _ in parts]
                spare = np.full(lists.docs, float(sum(rest)))
                for (_, a, b), r in zip(cut, rest, strict=True):
                    spare[lists.rows[a:b]] -= r
                open_ = total + spare >= max(1, better[i])
                exact = np.where(open_, total, 0) + lists.sums([(w, c, b) for (w, _, b), (_, _, c) in zip(parts, cut, strict=True)], open_)
                best = _highest(exact, k, better[i])
                for column, values in zip(out, (np.full(len(best), i), exact[best].astype(np.int64), best), strict=True):
                    column.append(values)
            item_no, score, place = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            yield pa.record_batch([pa.array(item_no.astype(np.int32)), pa.array(score), pa.array([ids[x] for x in place.tolist()], kind), pa.array(np.full(len(place), row["range"])), pa.array(place.astype(np.int32))], ["item", "score", "id", "range", "row"])

    return run


def _kth(sums: DataFrame, k: int, items: int) -> list[int]:
    """Of each item of the block the k-th highest score, 0 without so many."""
    w = Window.partitionBy("item").orderBy(F.desc("score"))
    found = sums.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).filter(F.col("_n") == k).select("item", "score").collect()
    out = [0] * items
    for r in found:
        out[r["item"]] = r.score
    return out


def search(index: Postings, asked: list[set[str]], k: int = K) -> DataFrame:
    """Of each of at most ``ITEMS`` sets of terms the ``k`` best documents: item (its place), rank, id, score."""
    words = index.ranges.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    wanted = index.ranges.sparkSession.createDataFrame([(t,) for t in sorted(set().union(*asked))], "term string")
    # at most the terms of a block
    df = {r.term: r.df for r in words.join(F.broadcast(wanted), "term", "left_semi").collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    items = [Item({t: weight[t] for t in sorted(own) if weight.get(t, 0) > 0}) for own in asked]
    first = _kth(index.ranges.mapInArrow(_bounds(items, k, None), "item int, score long"), k, len(items))
    better = [max(x) for x in zip(first, _kth(index.ranges.mapInArrow(_bounds(items, k, first), "item int, score long"), k, len(items)), strict=True)]
    of_ids = index.ranges.schema["ids"].dataType.elementType
    kind = of_ids.simpleString()
    exact = index.ranges.mapInArrow(_exact(items, k, first, better, to_arrow_type(of_ids)), f"item int, score long, id {kind}, range long, row int")
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "range", "row")
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def report(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Per item row its best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind, own = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    rows = lambda: items.select("item_id", "text").toLocalIterator()
    terms: set[bytes] | None = set()
    for r in rows():
        terms |= set(terms_of((r.text or "").encode()))
        if len(terms) > TERMS:
            terms = None
            break
    index = postings(docs, None if terms is None else frozenset(terms))
    left, path = rows(), None
    schema = f"item_id {kind}, rank int, doc_id {own}, score long"
    while block := list(islice(left, ITEMS)):
        found = search(index, [{t.decode() for t in terms_of((r.text or "").encode())} for r in block], k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(block)], f"item int, item_id {kind}")
        path = path or f"{shared_dir(spark)}/ranked"
        found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


#: DuckDB over the views ``documents`` and ``benchmark``: every document scored for every item.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, term, len(ws) AS n, count(*) AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
i AS (SELECT DISTINCT r, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT row_number() OVER () AS r, * FROM benchmark)),
c AS (SELECT i.r AS i, item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INT AS rank FROM c WHERE score > 0) WHERE rank <= 50
"""
