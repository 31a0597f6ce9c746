"""Operator 5, quality rules: risk-controlled thresholds.

Each rule measures a document and rejects it beyond a cutoff. Cutoffs come from fixed grids, loosest first, and are
chosen per stratum (language) on labelled clean documents: a cutoff is certified if, were its true rate of false
rejections as high as the rule's share of ``ALPHA``, so few rejected clean documents would be seen with a chance of at
most ``DELTA`` / (strata x rules) - the exact binomial (Clopper-Pearson) bound with Bonferroni's correction. The grid is
tested in order and left at the first failure, which needs no further correction. With probability 1 - ``DELTA`` all
strata then keep at least 1 - ``ALPHA`` of their clean documents that pass the base rules. A stratum without enough
labels gets no cutoff, and nothing of it is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE, byte_texts, slices, written

ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"

#: Rule -> its grid, loosest first; a document fails at values above the cutoff.
GRIDS = {
    "symbols_per_word": [8, 4, 2, 1.5, 1, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_word_share": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "mean_word_length": [40, 30, 25, 20, 16, 14, 12, 10, 9],
}


def repeat_words(codes: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(codes)
    if n < 4:
        return 0
    most = int(codes.max()) + 1
    if most < 2_000_000:
        key = (codes[:-2] * most + codes[1:-1]) * most + codes[2:]
    else:
        pair = np.unique(codes[:-2] * most + codes[1:-1], return_inverse=True)[1]
        key = pair * most + codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


#: Bytes of a text whose words are listed at once.
BLOCK = 1 << 20
_GAP = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _codes(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal ones. The words of a block are listed at once; the distinct ones stay."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        words = text[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    codes = _codes(text)
    # code points: bytes that don't go on a character
    chars = sum(int(np.count_nonzero((np.frombuffer(text, np.uint8, min(BLOCK, len(text) - a), a) & 0xC0) != 0x80)) for a in range(0, len(text), BLOCK))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")] if b"\n" in text else ()
    return len(codes), chars - sum(text.count(c.encode()) for c in SPACE), sum(text.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(codes)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        texts = byte_texts(batch.column(2))
        values = np.array([(*measures(t), t.count(b"\n") + 1) for t in texts], np.int64).reshape(-1, 6)
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(values[:, k]) for k in range(6))], ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines"])


def measured(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Per document the base counts; a null text has none, a null stratum is ''."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), "text")
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines"))
    return cut.mapInArrow(_measure, f"doc_id {kind}, stratum string, {counts}").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _value(rule: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words, "dup_line_share": F.col("n_dup_lines") / F.col("_n_lines"), "repeat_word_share": F.col("n_repeat_words") / words, "mean_word_length": F.col("word_chars") / words}[rule]


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(k, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(n: int, failing: list[int], alpha: float, delta: float) -> int:
    """How many cutoffs of a grid, loosest first, are certified; failing: clean documents beyond each."""
    for i, k in enumerate(failing):
        if k > alpha * n or at_most(k, n, alpha) > delta:
            return i
    return len(failing)


def _cutoffs_below(value: Column, grid: list[float]) -> Column:
    """How many cutoffs of a grid the value is beyond."""
    return F.size(F.filter(F.array(*map(F.lit, map(float, grid))), lambda c: value > c))


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> certified cutoff. Labels other than 1 don't count; a document labelled twice counts once."""
    clean = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    passing = features.filter(~F.col("base_failed")).join(clean, F.col("doc_id") == F.col("_id"), "left_semi")
    beyond = [_cutoffs_below(_value(rule), grid).alias(rule) for rule, grid in GRIDS.items()]
    tall = passing.select("stratum", F.explode(F.create_map(*(x for b, rule in zip(beyond, GRIDS, strict=True) for x in (F.lit(rule), b)))).alias("rule", "first"))
    # first: how many cutoffs of the grid reject the document - the last of the grid reject most
    counts = tall.groupBy("stratum", "rule", "first").agg(F.count("*").alias("n"))
    # a stratum with too few labels can't certify anything: the others are as many as labelled rows allow
    least = math.log(len(GRIDS) / delta) / -math.log1p(-alpha / len(GRIDS))
    enough = counts.groupBy("stratum").agg((F.sum("n") / len(GRIDS)).alias("_all")).filter(F.col("_all") >= least)
    table: dict[str, dict[str, dict[int, int]]] = {}
    for r in counts.join(enough, "stratum", "left_semi").collect():
        table.setdefault(r.stratum, {}).setdefault(r.rule, {})[r["first"]] = r.n
    out = {}
    for stratum, rules in table.items():
        for rule, by in rules.items():
            grid = GRIDS[rule]
            # ascending cutoffs reject the same documents and more: a document beyond j cutoffs fails the last j
            failing = [sum(n for first, n in by.items() if first >= len(grid) - i) for i in range(len(grid))]
            i = certified(sum(by.values()), failing, alpha / len(GRIDS), delta / len(GRIDS) / len(table))
            if i:
                out[stratum, rule] = float(grid[i - 1])
    return out


def verdicts(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, and the rules that it fails.

    Rows are judged one by one (repeated rows and ties don't matter); null and empty texts fail the base; an empty table
    gives an empty table; other columns are not read.
    """
    features = written(measured(docs, stratum_col), "measured")
    cuts = cutoffs(features, labels, alpha, delta)
    failed = []
    for rule in GRIDS:
        own = {s: c for (s, r), c in cuts.items() if r == rule}
        bound = F.element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.col("stratum")) if own else F.lit(None).cast("double")
        failed.append(F.when(_value(rule) > bound, F.lit(rule)))
    out = features.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
