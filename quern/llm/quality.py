"""Operator 8, quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of word bytes and runs of symbols, as written (case tells). Every token type has a sparse ternary index
vector drawn from its crc32; the vector of a type is its own index vector plus the mean of the index vectors around its
occurrences (two to each side) in the training texts. A document is the mean of its tokens' vectors. The network (tanh
layer, logistic output) is trained in numpy with Adam; its temperature is fitted on a fifth of the training documents
that the weights never saw.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import labelled
from quern.llm.common import byte_texts, ddl, fold, give_back, slices, tokenised

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")
#: Dimensions, entries of an index vector that are not 0, hidden units, tokens to each side that are context.
DIM, NONZERO, HIDDEN, WINDOW = 64, 6, 24, 2
#: Defaults of the vocabulary's parameters: types with vectors of their own, and labelled documents that hold a type at least.
VOCABULARY, LEAST_DOCS = 20_000, 3
#: Temperatures that are tried, and how finely; the best one is refined once.
COLDEST, HOTTEST, TRIALS = 0.02, 50.0, 60
CACHE = 300_000


def _shape(token: bytes) -> bytes:
    """What stands for a token outside the vocabulary: its kind, its case and its length class."""
    if token[:1].isdigit():
        return b"\0digits"
    if not (token[:1].isalpha() or token[0] >= 128):
        return b"\0symbol " + token[:1]
    kind = b"upper" if token.isupper() and len(token) > 1 else b"title" if token[:1].isupper() else b"lower"
    return b"\0" + kind + (b" long" if len(token) > 24 else b"")


class _Codes(dict):
    """Vocabulary with a bounded memory of unknown tokens."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > CACHE:
            for k in list(self)[self.fixed :]:
                del self[k]
        code = self[token] = self.get(_shape(token), 0)
        return code


def _index_vector(token: bytes) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(token))
    out = np.zeros(DIM, np.float32)
    out[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def word_vectors(token_lists: list[list[bytes]], size: int = VOCABULARY, least_docs: int = LEAST_DOCS) -> tuple[list[bytes], np.ndarray]:
    """The vocabulary (entry 0: unknown; shapes; the ``size`` most frequent types of at least ``least_docs`` texts) and its
    vectors from the contexts in these texts."""
    seen, docs_with = Counter(), Counter()
    for tokens in token_lists:
        seen.update(tokens)
        docs_with.update(set(tokens))
    common = sorted((t for t, n in docs_with.items() if n >= least_docs), key=lambda t: (-seen[t], t))[:size]
    shapes = sorted({_shape(t) for t in seen})
    vocabulary = [b"\0unknown", *shapes, *common]
    code = _Codes((t, i) for i, t in enumerate(vocabulary))
    code.fixed = len(vocabulary)
    index = np.stack([_index_vector(t) for t in vocabulary])
    total, times = np.zeros_like(index), np.zeros(len(vocabulary), np.float32)
    for at in range(0, len(token_lists), 500):
        parts = [np.fromiter(map(code.__getitem__, t), np.int64, len(t)) for t in token_lists[at : at + 500]]
        flat = np.concatenate([np.append(p, [-1] * WINDOW) for p in parts]) if parts else np.zeros(0, np.int64)
        for step in range(1, WINDOW + 1):
            a, b = flat[:-step], flat[step:]
            ok = (a >= 0) & (b >= 0)
            pair, n = np.unique(np.concatenate([a[ok] * len(vocabulary) + b[ok], b[ok] * len(vocabulary) + a[ok]]), return_counts=True)
            for k in range(0, len(pair), 200_000):
                x, y, m = pair[k : k + 200_000] // len(vocabulary), pair[k : k + 200_000] % len(vocabulary), n[k : k + 200_000].astype(np.float32)
                heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                total[x[heads]] += np.add.reduceat(index[y] * m[:, None], heads, axis=0)
                times[x[heads]] += np.add.reduceat(m, heads)
    return vocabulary, (index + total / np.maximum(times, 1)[:, None]).astype(np.float32)


@dataclass
class Model:
    vocabulary: list[bytes]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float
    constant: float | None = None

    def codes(self) -> _Codes:
        code = _Codes((t, i) for i, t in enumerate(self.vocabulary))
        code.fixed = len(self.vocabulary)
        return code

    def pooled(self, token_lists: list[list[bytes]], code: _Codes) -> np.ndarray:
        out = np.zeros((len(token_lists), DIM + 2), np.float32)
        for i, tokens in enumerate(token_lists):
            if tokens:
                codes = np.fromiter(map(code.__getitem__, tokens), np.int64, len(tokens))
                n = np.bincount(codes, minlength=1)
                some = np.flatnonzero(n)
                out[i, :DIM] = n[some].astype(np.float32) @ self.vectors[some] / len(tokens)
                out[i, DIM] = len(set(tokens)) / len(tokens) ** 0.85
                out[i, DIM + 1] = np.log1p(len(tokens))
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w + b) @ v + c

    def scores(self, token_lists: list[list[bytes]], code: _Codes) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(token_lists), self.constant)
        z = self.logits(self.pooled(token_lists, code)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, rate: float = 0.01, decay: float = 1e-3) -> tuple:
    rng = np.random.default_rng(7)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) * weight / weight.sum()
        back = np.outer(g, p[2]) * (1 - h * h)
        for i, d in enumerate((x.T @ back + decay * p[0] / len(p[0]), back.sum(0), h.T @ g + decay * p[2] / HIDDEN, g.sum(keepdims=True))):
            m[i], s[i] = 0.9 * m[i] + 0.1 * d, 0.999 * s[i] + 0.001 * d * d
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return p[0].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3][0])


def fit(texts: list[bytes], ys: list[int], hashes: list[int], weights: list[float], vocabulary: int = VOCABULARY, least_docs: int = LEAST_DOCS) -> Model:
    """Without both classes the score is the share of 1 (or 0.5 without labels)."""
    tokens = tokenised(texts, TOKEN)
    names, vectors = word_vectors(tokens, vocabulary, least_docs)
    y, weight = np.array(ys, float), np.array(weights, float)
    model = Model(names, vectors, np.zeros(1), np.ones(1), (), 1.0)
    if len(set(ys)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    x = model.pooled(tokens, model.codes())
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-4
    x = (x - model.mean) / model.scale
    aside = np.array(hashes) % 5 == 0
    if len(set(y[~aside])) < 2:
        aside[:] = False
    model.layers = _train(x[~aside], y[~aside], weight[~aside])
    z = np.tanh(x @ model.layers[0] + model.layers[1]) @ model.layers[2] + model.layers[3]
    held = aside if aside.any() else ~aside

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(z[held] / t, -40, 40))), 1e-9, 1 - 1e-9)
        return float(-(weight[held] * (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))).sum())

    grid = np.geomspace(COLDEST, HOTTEST, TRIALS)
    best = int(np.argmin([loss(t) for t in grid]))
    model.temperature = min(np.geomspace(grid[max(0, best - 1)], grid[min(TRIALS - 1, best + 1)], TRIALS), key=loss)
    return model


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", vocabulary: int = VOCABULARY, least_docs: int = LEAST_DOCS, **bounds: int) -> Model:
    """``bounds``: of :func:`quern.llm.labelled.sample`."""
    model = fit(*labelled.sample(docs, labels, label, **bounds), vocabulary, least_docs)
    give_back()  # the driver keeps no trace of the sample
    return model


def _score(held, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        code = model.codes()
        for batch in slices(batches, at):
            got = model.scores([TOKEN.findall(t) for t in byte_texts(batch.column(at))], code)
            yield pa.record_batch([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher where label 1 is likelier. Null and empty texts get the score
    of a text without tokens; rows are scored one by one, so repeated rows, ties and other columns don't matter."""
    # the model's size is bounded by VOCABULARY, not by the corpus
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(held, docs.columns.index(text_col), name), f"{ddl(docs)}, `{name}` double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. A null id is never held out; see :func:`scored` and :func:`fit` for
    null and empty texts, repeated rows, and labels that are missing."""
    out = scored(docs.select("doc_id", "text"), trained(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
