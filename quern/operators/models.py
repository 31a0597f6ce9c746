"""Injected token models on Arrow batches: embeddings with last-token pooling (V1), and scores of pairs of texts.

A model is given as functions on numpy arrays, so that any runtime can stand behind it. Texts of a batch are tokenized once,
sorted by their number of tokens, and go to the model in groups whose padded size is bounded, so a group holds texts of
similar length, little is padded, and memory does not depend on the longest text. Results return in the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as t


@dataclass(frozen=True)
class TokenModel:
    """``tokens``: texts to lists of ids. ``states``: (ids, mask), each of (texts, length), to hidden states (texts, length,
    dims). Texts are cut at ``max_length`` tokens; ``left``: padding stands before the text."""

    tokens: Callable[[list[str]], list[list[int]]]
    states: Callable[[np.ndarray, np.ndarray], np.ndarray]
    max_length: int = 512
    left: bool = False


@dataclass(frozen=True)
class PairModel:
    """``tokens``: pairs of texts to lists of ids; ``logits``: (ids, mask) to a number for each pair."""

    tokens: Callable[[list[tuple[str, str]]], list[list[int]]]
    logits: Callable[[np.ndarray, np.ndarray], np.ndarray]
    max_length: int = 1024
    left: bool = False


#: Tokens, padding included, that a model gets at once; a single longer text goes alone.
PADDED = 16_384


def groups(lengths: np.ndarray, most: int = PADDED) -> Iterator[np.ndarray]:
    """Places of texts by groups of similar length, the shortest first; the padded size of a group is at most ``most``."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and max(1, lengths[order[end]]) * (end - at + 1) <= most:
            end += 1
        yield order[at:end]
        at = end


def padded(ids: list[list[int]], left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one size; at least one column."""
    width = max(1, max(map(len, ids), default=0))
    out, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
    for row, own in enumerate(ids):
        at = slice(width - len(own), width) if left else slice(0, len(own))
        out[row, at], mask[row, at] = own, 1
    return out, mask


def last_token(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each text's last token, on whichever side padding stands; zeros for a text without tokens."""
    last = mask.shape[1] - 1 - mask[:, ::-1].argmax(1)
    return states[np.arange(len(mask)), last] * (mask.any(1)[:, None])


def embedded(texts: list[str], model: TokenModel, most: int = PADDED) -> np.ndarray:
    """Unit vectors of the texts; zeros for a text without tokens."""
    ids = [x[: model.max_length] for x in model.tokens(texts)]
    out = None
    for group in groups(np.fromiter(map(len, ids), np.int64, len(ids)), most):
        own, mask = padded([ids[i] for i in group], model.left)
        vectors = last_token(model.states(own, mask), mask)
        if out is None:
            out = np.zeros((len(texts), vectors.shape[1]), vectors.dtype)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        out[group] = vectors / np.where(size > 0, size, 1)
    return np.zeros((0, 0)) if out is None else out


def _added(df: DataFrame, out: str, kind: str, values: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, values(batch)], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` {kind}")


def embed_texts(df: DataFrame, text_col: str, model: TokenModel, out: str = "embedding", most: int = PADDED) -> DataFrame:
    """V1. ``df`` with a column of unit vectors; a null text counts as the empty one."""

    def values(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(list(embedded([x or "" for x in batch.column(text_col).to_pylist()], model, most).astype(np.float64)), pa.list_(pa.float64()))

    return _added(df, out, "array<double>", values)


def score_pairs(df: DataFrame, model: PairModel, query_col: str = "query", content_col: str = "content", out: str = "logit", most: int = PADDED) -> DataFrame:
    """R1. ``df`` with the model's logit of each pair; contents are cut at a word (T27). Null texts count as empty ones."""
    head = "_head"
    while head in df.columns:
        head += "_"

    def values(batch: pa.RecordBatch) -> pa.Array:
        pairs = list(zip(*([x or "" for x in batch.column(c).to_pylist()] for c in (query_col, head)), strict=True))
        ids = [x[: model.max_length] for x in model.tokens(pairs)]
        logits = np.zeros(len(pairs))
        for group in groups(np.fromiter(map(len, ids), np.int64, len(ids)), most):
            logits[group] = np.asarray(model.logits(*padded([ids[i] for i in group], model.left)), np.float64).reshape(-1)
        return pa.array(logits)

    return _added(df.withColumn(head, t.truncate_at_word(F.col(content_col))), out, "double", values).drop(head)
