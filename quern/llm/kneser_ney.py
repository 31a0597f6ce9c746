"""Operator 1, LM scoring: an interpolated modified Kneser-Ney bigram model.

Tokens are lower-cased (A-Z) words and one end token a text; a start mark is the context of the first. Counting takes two
shuffles of compact rows: words by 64-bit hash, then bigrams as pairs of word ids, packed by shard as sorted,
delta-coded arrays with counts. The model is a folder of sorted arrays under the shared folder:

* ``words-*``: a shard of the sorted word hashes (shards are ranges of the hash) and, aligned with it, the count, the
  number of distinct predecessors, the total of the word as a context and its interpolation weight;
* ``pairs-*``: a shard of the sorted bigram keys (word id << 32 | word id) and their counts.

Workers map the arrays from there into memory (from a store that is no file system, a worker reads them and holds a
bounded number), so a worker's own memory holds only the batch that it scores.

P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v.) + g(v) * P1(w)
P1(w) = max(N1+(.w) - E(N1+(.w)), 0) / N1+(..) + h / (V + 1)
with Chen and Goodman's three discounts for each order; g and h give the discounted mass back, so each distribution sums
to one over the V known tokens and one unknown token. A context that was never seen has g = 1.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import by_shard, byte_texts, coded, ddl, fold, load, opened, per_doc, save, shared_dir, slices, written

END = b"\n"
#: Words in a shard of the vocabulary and bigrams in a shard of the pairs, on average.
SHARD_WORDS, SHARD_PAIRS = 1_000_000, 2_000_000
#: Bytes of text that are counted at once before the sorted counts go out.
COUNT_BYTES = 6 << 20
#: Ids of words take 32 bits of a bigram's key.
MOST_WORDS = 2**32 - 1
#: A word with more than this share of a pair shard's bigrams as a context is spread over all shards.
HOT_SHARE = 0.125


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens, codes of the occurrences, starts of the texts."""
    known, codes, starts = coded([[*t.lower().split(), END] for t in texts])
    return np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)), codes, starts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0, COUNT_BYTES):
        hashes, codes, _ = tokens(byte_texts(batch.column(0)))
        yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(np.bincount(codes, minlength=len(hashes)).astype(np.int64))], ["h", "n"])


class Vocabulary:
    """Word ids: the rank of the hash among the sorted hashes. Unknown words have id -1. Shards are opened when a batch asks
    for them and not kept."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.sizes = folder, sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return shard_of(hashes, len(self.sizes))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        for k, place in by_shard(self.shard(hashes[order])):
            if self.sizes[k]:
                at, table = order[place], load(self.folder, f"words-{k}", "hash")
                place = np.minimum(np.searchsorted(table, hashes[at]), len(table) - 1)
                out[at] = np.where(table[place] == hashes[at], place + self.first[k], -1)
        return out

    def hot(self, ids: np.ndarray, limit: float) -> np.ndarray:
        """Whether ids are of contexts that are spread over all shards: words counted more than ``limit`` times, and the
        start mark, the id after the last."""
        mark = ids == self.first[-1]
        out = mark.copy()
        out[~mark] = self.values(ids[~mark], "count") > limit
        return out

    def values(self, ids: np.ndarray, key: str) -> np.ndarray:
        """Of known ids."""
        out = np.zeros(len(ids))
        for k, at in by_shard(np.searchsorted(self.first, ids, side="right") - 1):
            out[at] = load(self.folder, f"words-{k}", key)[ids[at] - self.first[k]]
        return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shard(keys: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """By context, so that a context's bigrams lie together - those of ``hot`` contexts (a flag for each key) by both words."""
    with np.errstate(over="ignore"):
        salt = np.where(hot, keys, keys >> np.uint64(32))
        x = (salt ^ (salt >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, which Spark's shuffle compresses."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def expand(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def bigrams(ids: np.ndarray, starts: np.ndarray, begin: int) -> np.ndarray:
    """(context << 32 | word) of every token; the context of a text's first token is ``begin``."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[starts[:-1]] = begin
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def flags(keys: np.ndarray, ids: np.ndarray, words: Vocabulary, limit: float) -> np.ndarray:
    """For each bigram key whether its context, one of ``ids``, is hot."""
    known = np.sort(ids[ids >= 0])
    return words.hot(known, limit)[np.searchsorted(known, (keys >> np.uint64(32)).astype(np.int64))]


def _count_pairs(folder: str, sizes: list[int], limit: float, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(folder, sizes)
        begin = int(words.first[-1])
        for batch in slices(batches, 0, COUNT_BYTES):
            hashes, codes, starts = tokens(byte_texts(batch.column(0)))
            ids = words.ids(hashes)
            keys, n = np.unique(bigrams(ids[codes], starts, begin), return_counts=True)
            shard = pair_shard(keys, flags(keys, np.append(ids, begin), words, limit), shards)
            order = np.argsort(shard, kind="stable")
            keys, n, shard = keys[order], n[order], shard[order]
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            rows = [(int(shard[a]), squeeze(keys[a:b]), n[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])

    return run


def _merge_words(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        h = group["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        save(folder, f"words-{group['shard'].iloc[0]}", {"hash": h[order], "count": group["n"].to_numpy()[order]})
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "size": [len(h)], "n": [int(group["n"].sum())]})

    return run


def _plus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([a[1], b[1]])[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(n, heads) if len(keys) else n


def _merge_pairs(folder: str, first: list[int]):
    """Merges a shard's rows, writes its arrays, and returns for each word id of the shard what its arrays add to it, with the
    word's own shard."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.uint64)
                parts.append((expand(k), n))
                while len(parts) > 1 and len(parts[-2][0]) < 2 * len(parts[-1][0]):  # few, of falling sizes
                    parts[-2:] = [_plus(*parts[-2:])]
        while len(parts) > 1:
            parts[-2:] = [_plus(*parts[-2:])]
        keys, n = parts[0]
        save(folder, f"pairs-{key[0].as_py()}", {"key": keys, "count": n.astype(np.min_scalar_type(n.max()))})
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own = [np.add.reduceat(x.astype(np.int64), heads) for x in (n, n == 1, n == 2, n >= 3)]
        ids, types = np.unique(word, return_counts=True)
        # counts of counts travel with id -1
        cc = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        zero = np.zeros(len(ids), np.int64)
        rows = [np.concatenate([context[heads], ids, [-1]]), *(np.concatenate([a, zero, [c]]) for a, c in zip(own, cc, strict=True)), np.concatenate([np.zeros(len(heads), np.int64), types, [0]])]
        rows.append(np.searchsorted(np.array(first), rows[0], side="right") - 1)
        for at in range(0, len(rows[0]), 50_000):
            yield pa.record_batch([pa.array(r[at : at + 50_000]) for r in rows], ["id", "total", "n1", "n2", "n3", "types", "shard"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D of counts 0, 1, 2, 3 and more, from counts of counts; kept within [0, count] where these are odd."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def _finish(folder: str, first: list[int], d: list[float]):
    """Arrays of a vocabulary shard, aligned with its hashes."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["shard"].iloc[0])
        at = group["id"].to_numpy() - first[k]
        size = first[k + 1] - first[k]
        arrays = {c: np.zeros(size, np.int64) for c in ("total", "n1", "n2", "n3", "types")}
        for c, a in arrays.items():
            a[at] = group[c].to_numpy()
        total = arrays["total"]
        weight = np.where(total > 0, (d[1] * arrays["n1"] + d[2] * arrays["n2"] + d[3] * arrays["n3"]) / np.maximum(total, 1), 1.0)
        save(folder, f"words-{k}", {"types": arrays["types"], "total": total, "weight": weight})
        t = arrays["types"]
        return pd.DataFrame({"t1": [int((t == 1).sum())], "t2": [int((t == 2).sum())], "t3": [int((t == 3).sum())], "t4": [int((t == 4).sum())], "more": [int((t >= 3).sum())], "all": [int(t.sum())], "kinds": [int((t > 0).sum())]})

    return run


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """Counts ``docs`` and writes the model; returns what describes it (a small dict, for :func:`scored`)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    words = written(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    model = {"folder": folder, "v": total.v, "n": total.n, "sizes": [], "begin": 0}
    if not total.v:
        return model
    if total.v >= MOST_WORDS:
        raise ValueError(f"{total.v} distinct tokens: bigram keys hold ids below {MOST_WORDS}")
    shards = math.ceil(total.v / SHARD_WORDS)
    high = F.shiftrightunsigned("h", 32)
    by_shard = words.withColumn("shard", F.shiftright(high * shards, 32).cast("int")).groupBy("shard")
    sizes = [0] * shards
    for r in by_shard.applyInPandas(_merge_words(folder), "shard int, size long, n long").collect():
        sizes[r.shard] = r["size"]
    first = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    model |= {"sizes": sizes, "begin": first[-1]}
    pair_shards = max(spark.sparkContext.defaultParallelism, math.ceil(total.n / SHARD_PAIRS))
    limit = HOT_SHARE * total.n / pair_shards
    rows = texts.mapInArrow(_count_pairs(folder, sizes, limit, pair_shards), "shard int, keys binary, counts binary")
    # a shard is a task's work: the hash above has dealt the bigrams evenly
    stats = rows.repartition(pair_shards, "shard").groupBy("shard").applyInArrow(_merge_pairs(folder, first), "id long, total long, n1 long, n2 long, n3 long, types long, shard long")
    summed = written(stats.groupBy("id", "shard").agg(*(F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "types"))), "stats")
    ends = {r.id: r for r in summed.filter(F.col("id").isin(-1, first[-1])).collect()}
    counts, begin = ends[-1], ends[first[-1]]
    d = discounts(counts.total, counts.n1, counts.n2, counts.n3).tolist()
    own = summed.filter((F.col("id") >= 0) & (F.col("id") < first[-1]))
    t = own.groupBy("shard").applyInPandas(_finish(folder, first, d), '`t1` long, `t2` long, `t3` long, `t4` long, `more` long, `all` long, `kinds` long').agg(*(F.sum(c).alias(c) for c in ("t1", "t2", "t3", "t4", "more", "all", "kinds"))).first()
    e = discounts(t.t1, t.t2, t.t3, t.t4)
    mass = (e[1] * t.t1 + e[2] * t.t2 + e[3] * t.more) / t["all"]
    model |= {"d": d, "e": e.tolist(), "types": t["all"], "uniform": float(mass / (total.v + 1)), "begin_total": begin.total, "begin_weight": float((d[1] * begin.n1 + d[2] * begin.n2 + d[3] * begin.n3) / begin.total), "limit": limit, "pair_shards": pair_shards}
    system, path = opened(folder)
    if system is None:
        with open(f"{path}/model.json", "w") as f:
            json.dump(model, f)
    return model


class Scorer:
    """Looks tokens up in the mapped arrays, of which none is kept; shards without bigrams are remembered by number."""

    def __init__(self, model: dict):
        self.m = model
        self.words = Vocabulary(model["folder"], model["sizes"])
        self.none: set[int] = set()

    def _pairs(self, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        if k in self.none:
            return None
        try:
            return load(self.m["folder"], f"pairs-{k}", "key"), load(self.m["folder"], f"pairs-{k}", "count")
        except FileNotFoundError:  # no bigram fell there
            self.none.add(k)
            return None

    def pair_counts(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys, whose contexts are among ``ids``."""
        out = np.zeros(len(keys), np.int64)
        for k, at in by_shard(pair_shard(keys, flags(keys, ids, self.words, self.m["limit"]), self.m["pair_shards"])):
            table = self._pairs(k)
            if table is not None:
                place = np.minimum(np.searchsorted(table[0], keys[at]), len(table[0]) - 1)
                out[at] = np.where(table[0][place] == keys[at], table[1][place], 0)
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, base score, score."""
        m = self.m
        hashes, codes, starts = tokens(texts)
        size = np.diff(starts)
        if not m["v"]:
            return size, np.zeros(len(size), np.int64), np.zeros(len(size)), np.zeros(len(size))
        ids = self.words.ids(hashes)
        known = np.flatnonzero(ids >= 0)
        values = {k: np.zeros(len(ids)) for k in ("count", "types", "total", "weight")}
        values["weight"][:] = 1.0
        for k, a in values.items():
            a[known] = self.words.values(ids[known], k)
        base = np.log10((values["count"] + 1) / (m["n"] + m["v"] + 1))
        e = np.array(m["e"])
        types = values["types"].astype(np.int64)
        low = np.maximum(types - e[np.minimum(types, 3)], 0) / m["types"] + m["uniform"]
        begin = m["begin"]
        ids2 = np.append(ids, begin)
        weight, total = np.append(values["weight"], m["begin_weight"]), np.append(values["total"], m["begin_total"])
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[starts[:-1]] = len(ids)  # the start mark
        p = weight[before] * low[codes]
        both = np.flatnonzero((ids2[before] >= 0) & (ids[codes] >= 0))
        keys, back = np.unique(ids2[before[both]].astype(np.uint64) << np.uint64(32) | ids[codes[both]].astype(np.uint64), return_inverse=True)
        c = self.pair_counts(keys, ids2)[back]
        d = np.array(m["d"])
        p[both] += np.where(c > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[before[both]], 1), 0)
        return size, per_doc((ids[codes] >= 0).astype(float), starts).round().astype(np.int64), per_doc(base[codes], starts), per_doc(np.log10(p), starts)


def _score(model: dict, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, at):
            n, known, base, score = scorer.score(byte_texts(batch.column(at)))
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], [*batch.schema.names, "_n_tokens", "_n_known", "_base", "_score"])

    return run


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_tokens``, ``_n_known``, ``_base`` and ``_score`` (log10 probabilities of the whole text).

    A null or empty text is its end token. A model of no text scores 0. Rows are scored one by one: repeated rows, ties
    and other columns don't matter. Perplexity is ``10 ** (-_score / _n_tokens)``.
    """
    schema = ddl(docs)
    return docs.mapInArrow(_score(model, docs.columns.index(text_col)), f"{schema}, _n_tokens long, _n_known long, _base double, _score double")


def report(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    own = docs.select("doc_id", "text")
    out = F.col("held") if held_out is None else held_out
    flagged = own.withColumn("held", fold(F.col("doc_id"), 7) == 2 if held_out is None else out)
    model = train(flagged.filter(~F.col("held")))
    return scored(flagged, model).select("doc_id", F.col("held").alias("held_out"), F.col("_n_tokens").alias("n_tokens"), F.col("_n_known").alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"), F.pow(F.lit(10.0), -F.col("_score") / F.col("_n_tokens")).alias("perplexity"))
