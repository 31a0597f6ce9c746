"""Operator 10, toxicity: a linear-chain conditional random field tags toxic tokens; marginals make document scores.

Labels mark documents, so tokens get theirs first: a feature of a word (itself, its first four or five characters, its
last four) marks toxic tokens if its share of toxic documents among the labelled ones is beyond chance (exact binomial
tail, corrected for the number of features). Tokens with such a feature in toxic documents are labelled 1, all other
tokens 0. The field learns from every sentence of at most ``SAMPLE`` documents a class.

The field runs over sentences (up to a newline or a token of ``.!?``, or ``LONGEST`` tokens) with two tags. Emissions are sums of feature
weights of the token and of the words beside it. Forward-backward recursions run over many sentences at once, in log
odds. A document's score is a logistic function, fitted on training documents, of the expected number of toxic tokens,
of their density and of the chance that there is any.
"""

from __future__ import annotations

import math
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
from quern.llm.common import by_shard, byte_texts, coded, ddl, fold, give_back, slices, tokenised

TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[.!?\n]+")
CACHE = 100_000
#: Labelled documents of each class that train the field, at most; steps of its training; tokens of a sentence in the sample,
#: whose longer sentences are trained on in parts. Documents are scored by whole sentences, of any length.
SAMPLE, STEPS, LONGEST = 1000, 80, 256
STOPS = b".!?\n"


def features(word: bytes) -> list[bytes]:
    """Of a lower-cased word; the first byte tells the kind."""
    text = word.decode("utf-8", "replace")
    out = [b"w" + word]
    if len(text) > 4:
        out += [b"p" + text[:4].encode(), b"s" + text[-4:].encode()]
    if len(text) > 5:
        out.append(b"q" + text[:5].encode())
    return out


def beyond_chance(hits: int, n: int, share: float) -> float:
    """P(Binomial(n, share) >= hits)."""
    if hits <= n * share:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(n - hits + 1) + hits * math.log(share) + (n - hits) * math.log1p(-share))
    total, k = term, hits
    while k < n and term > total * 1e-12:
        term *= (n - k) / (k + 1) * share / (1 - share)
        total, k = total + term, k + 1
    return min(1.0, total)


def first_of_copies(docs: list[set[bytes]]) -> list[bool]:
    """False for a document that shares six minima of hashes of its words with an earlier one: its words are no new
    evidence."""
    a = np.random.default_rng(3).integers(1, 2**63, 48, dtype=np.uint64) | np.uint64(1)
    seen: set[tuple] = set()
    out = []
    for words in docs:
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
        low = (h[:, None] * a >> np.uint64(20)).min(0).reshape(8, 6) if len(h) else np.zeros((8, 6))
        keys = {(i, *row) for i, row in enumerate(low.tolist())}
        out.append(not keys & seen)
        seen |= keys
    return out


def toxic_features(docs: list[set[bytes]], ys: list[int], risk: float = 0.01, precision: float = 0.9) -> set[bytes]:
    """Features whose documents are toxic beyond chance, and nearly always; near copies count once."""
    toxic, every = Counter(), Counter()
    new = first_of_copies(docs)
    ys = [y for y, n in zip(ys, new, strict=True) if n]
    for words, y in zip((d for d, n in zip(docs, new, strict=True) if n), ys, strict=True):
        own = {f for w in words for f in features(w)}
        every.update(own)
        if y:
            toxic.update(own)
    share = min(max(sum(ys) / max(1, len(ys)), 1e-6), 1 - 1e-6)
    return {f for f, k in toxic.items() if k >= precision * every[f] and beyond_chance(k, every[f], share) * len(every) <= risk}


@dataclass
class Laid:
    """Words of many texts laid end to end, by sentence."""

    words: list[bytes]  # distinct tokens
    code: np.ndarray  # of each word, its place among them
    start: np.ndarray  # of sentences, in the row of words
    end: np.ndarray
    doc: np.ndarray  # of each word, its text
    place: np.ndarray  # and its number among the text's tokens


def laid_out(token_lists: list[list[bytes]], longest: int | None = None) -> Laid:
    """The texts' words by sentence; with ``longest`` sentences of more tokens are cut."""
    words, codes, starts = coded(token_lists)
    stop = np.fromiter((w[0] in STOPS for w in words), bool, len(words))
    keep = np.flatnonzero(~stop[codes])
    doc = np.repeat(np.arange(len(token_lists)), np.diff(starts))[keep]
    head = np.ones(len(keep), bool)
    head[1:] = (np.diff(keep) != 1) | (np.diff(doc) != 0)
    heads = np.flatnonzero(head)
    run = np.arange(len(keep)) - np.repeat(heads, np.diff(np.append(heads, len(keep))))
    start = heads if longest is None else np.flatnonzero(run % longest == 0)
    return Laid(words, codes[keep], start, np.append(start, len(keep))[1:], doc, keep - starts[doc])


def forward_backward(emit: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tag 1, and the forward and backward log odds, of chains emit[start:end].

    ``a``: log weights of transitions [from][to]; ``first``: log odds of tag 1 at a chain's start.
    Chains are handled by length class, all of a class at once.
    """
    x, y = np.zeros(len(emit)), np.zeros(len(emit))
    w = np.exp(a)
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, end, length = start[order], end[order], length[order]
    if len(length):
        x[start] = emit[start] + first
        for t in range(1, int(length[0])):
            live = np.searchsorted(-length, -t, side="left")  # chains longer than t
            at = start[:live] + t
            r = np.exp(np.clip(x[at - 1], -40, 40))
            x[at] = emit[at] + np.log((w[0, 1] + w[1, 1] * r) / (w[0, 0] + w[1, 0] * r))
            at = end[:live] - 1 - t
            q = np.exp(np.clip(emit[at + 1] + y[at + 1], -40, 40))
            y[at] = np.log((w[1, 0] + w[1, 1] * q) / (w[0, 0] + w[0, 1] * q))
    return 1 / (1 + np.exp(-np.clip(x + y, -40, 40))), x, y


@dataclass
class Model:
    weights: dict[bytes, float]
    before: dict[bytes, float]
    after: dict[bytes, float]
    bias: float
    a: np.ndarray
    first: float
    doc: np.ndarray

    def emission(self, word: bytes) -> tuple[float, float, float]:
        """Of the word as itself, as the next token's neighbour, as the previous token's neighbour."""
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word)), self.before.get(word, 0.0), self.after.get(word, 0.0)


class _Known(dict):
    """Emissions of words, with bounded memory."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> tuple[float, float, float]:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self.model.emission(word)
        return out


def _neighbours(laid: Laid) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that have one before them in their sentence, and of those that have one behind them."""
    inner, open_ = np.ones(len(laid.code), bool), np.ones(len(laid.code), bool)
    inner[laid.start], open_[laid.end - 1] = False, False
    return np.flatnonzero(inner), np.flatnonzero(open_)


def marginals(model: Model, known: _Known, laid: Laid) -> np.ndarray:
    """Of each word its chance to be toxic."""
    table = np.array([known[w] for w in laid.words], np.float64).reshape(-1, 3)
    inner, open_ = _neighbours(laid)
    emit = table[laid.code, 0]
    emit[inner] += table[laid.code[inner - 1], 1]
    emit[open_] += table[laid.code[open_ + 1], 2]
    return forward_backward(emit, laid.start, laid.end, model.a, model.first)[0]


def document_features(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each document: log of 1 plus the expected number of toxic words, their density, log odds that there is any."""
    expected, size = np.bincount(doc, p, n), np.bincount(doc, minlength=n)
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
    any_ = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
    return np.stack([np.log1p(expected), expected / np.maximum(size, 1) * 10, np.log(any_ / (1 - any_)) / 5, np.ones(n)], 1)


def _fit_field(laid: Laid, ys: np.ndarray, marks: set[bytes]) -> Model:
    words, code, start, end = laid.words, laid.code, laid.start, laid.end
    times = np.bincount(code, minlength=len(words))
    own = [features(w) if n else [] for w, n in zip(words, times.tolist(), strict=True)]
    marked = np.fromiter((any(f in marks for f in fs) for fs in own), bool, len(words))
    label = (marked[code] & ys[laid.doc]).astype(float)
    # markers, words met at least three times, other features of at least three words
    count = Counter(f for fs in own for f in fs)
    ids: dict[bytes, int] = {}
    pairs = [(u, ids.setdefault(f, len(ids))) for u, fs in enumerate(own) for f in fs if f in marks or (times[u] if f[:1] == b"w" else count[f]) >= 3]
    pu, pf = (np.array(z, np.int64) for z in zip(*pairs, strict=True))
    del own, count, pairs
    n_words = len(words)
    inner, notlast = _neighbours(laid)
    sizes = [len(ids), n_words, n_words, 6]
    theta = np.zeros(sum(sizes))
    at = np.cumsum([0, *sizes])
    theta[at[3]] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        w, before, after, rest = (theta[at[k] : at[k + 1]] for k in range(4))
        a = np.array([[0, rest[1]], [rest[2], rest[3]]])
        emit = np.bincount(pu, w[pf], n_words)[code] + rest[0]
        emit[inner] += before[code[inner - 1]]
        emit[notlast] += after[code[notlast + 1]]
        p, x, y = forward_backward(emit, start, end, a, rest[4])
        g = p - label
        by_word = np.bincount(code, g, n_words)
        grad = np.zeros_like(theta)
        grad[: at[1]] = np.bincount(pf, by_word[pu], len(ids))
        grad[at[1] : at[2]] = np.bincount(code[inner - 1], g[inner], n_words)
        grad[at[2] : at[3]] = np.bincount(code[notlast + 1], g[notlast], n_words)
        r, q = np.exp(np.clip(x[inner - 1], -40, 40)), np.exp(np.clip(emit[inner] + y[inner], -40, 40))
        ww = np.exp(a)
        cells = np.stack([np.full(len(r), ww[0, 0]), ww[0, 1] * q, ww[1, 0] * r, ww[1, 1] * r * q])
        cells = (cells / cells.sum(0)).sum(1)
        l0, l1 = label[inner - 1], label[inner]
        grad[at[3] : at[3] + 5] = [g.sum(), cells[1] - ((1 - l0) * l1).sum(), cells[2] - (l0 * (1 - l1)).sum(), cells[3] - (l0 * l1).sum(), g[start].sum()]
        grad += 0.5 * theta * np.r_[np.ones(at[1]), np.full(at[3] - at[1], 4.0), np.zeros(6)]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w, before, after, rest = (theta[at[k] : at[k + 1]] for k in range(4))
    keep = lambda names, values: {k: float(x) for k, x in zip(names, values, strict=True) if abs(x) > 0.02}
    return Model(keep(ids, w), keep(words, before), keep(words, after), float(rest[0]), np.array([[0, rest[1]], [rest[2], rest[3]]]), float(rest[4]), np.zeros(4))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-2 * b)
        b = b - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return b


def fit(texts: list[bytes], ys: list[int], hashes: list[int], weights: list[float]) -> Model:
    """Without toxic labels, or without a feature beyond chance, the score is the share of toxic labels."""
    docs = tokenised([t.lower() for t in texts], TOKEN)
    marks = toxic_features([{w for w in d if w[0] not in b".!?\n"} for d in docs], ys) if sum(ys) else set()
    share = float(np.average(ys, weights=weights)) if ys else 0.0
    if not marks:
        share = min(max(share, 1e-4), 1 - 1e-4)
        return Model({}, {}, {}, -40.0, np.zeros((2, 2)), 0.0, np.array([0, 0, 0, math.log(share / (1 - share))]))
    laid = laid_out(docs, LONGEST)
    del docs
    model = _fit_field(laid, np.array(ys, bool), marks)
    p = marginals(model, _Known(model), laid)
    model.doc = _logistic(document_features(p, laid.doc, len(texts)), np.array(ys, float), np.array(weights, float))
    return model


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE, **bounds: int) -> Model:
    model = fit(*labelled.sample(docs, labels, label, per_class, **bounds))
    give_back()  # the driver keeps no trace of the sample
    return model


def _spans(text: bytes, tokens: np.ndarray, p: np.ndarray, least: float) -> list[dict]:
    """Runs of neighbouring toxic words as code point offsets [start, end) with their highest marginal."""
    want = dict(zip(tokens.tolist(), p.tolist(), strict=True))
    out: list[dict] = []
    last, byte, char = -2, 0, 0
    for i, hit in enumerate(TOKEN.finditer(text)):
        if want.get(i, 0.0) >= least:
            start = char + len(text[byte : hit.start()].decode("utf-8", "replace"))
            char = start + len(hit[0].decode("utf-8", "replace"))
            byte = hit.end()
            if i == last + 1:
                out[-1] |= {"end": char, "score": max(out[-1]["score"], want[i])}
            else:
                out.append({"start": start, "end": char, "score": want[i]})
            last = i
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _score(held, at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        known = _Known(model)
        for batch in slices(batches, at):
            texts = byte_texts(batch.column(at))
            laid = laid_out([TOKEN.findall(t.lower()) for t in texts])
            p = marginals(model, known, laid)
            z = document_features(p, laid.doc, len(texts)) @ model.doc
            spans: list[list[dict]] = [[] for _ in texts]
            hot = np.flatnonzero(p >= least)
            for d, own in by_shard(laid.doc[hot]):
                spans[d] = _spans(texts[d], laid.place[hot[own]], p[hot[own]], least)
            yield pa.record_batch([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), pa.array(spans, SPANS)], [*batch.schema.names, "_score", "_spans"])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``_score`` (0 to 1) and ``_spans`` (code point offsets of runs of words whose marginal is at least
    ``least``). Null and empty texts have no spans and the score of a text without toxic words; rows are scored one by
    one, so repeated rows, ties and other columns don't matter."""
    # the model's size is bounded by the sample, not by the corpus
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ddl(docs)
    return docs.mapInArrow(_score(held, docs.columns.index(text_col), least), f"{schema}, _score double, _spans array<struct<start:int,end:int,score:double>>")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans. A null id is never held out; see :func:`scored` and
    :func:`fit` for null and empty texts, repeated rows, and labels that are missing."""
    out = scored(docs.select("doc_id", "text"), trained(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_spans").alias("spans"))
