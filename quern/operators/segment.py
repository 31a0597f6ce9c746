"""Word segmentation (T8): a lexicon counted from a corpus, and the cheapest cut of a text into its words.

Written syllables are separated by blanks, words are not marked. A run of syllables is a word of the lexicon if it is frequent
and its parts meet more often than chance lets them. A text is cut where the summed costs (thousandths of the negative
logarithm of a word's share) are least, found by dynamic programming over a trie of the lexicon; of equally cheap cuts the one
of fewer words counts, then the one whose last word is longer. Without a lexicon the words are what blanks separate.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.storage import pieces, written

#: Entries of a lexicon at most (the most frequent): it is sent to all workers. Occurrences of an entry, and how many times
#: more often than by chance its parts meet, at least. Syllables of a word at most.
MOST, LEAST, LIFT, LONGEST = 50_000, 5, 8.0, 3


def lexicon(texts: DataFrame, text_col: str = "text", most: int = MOST, least: int = LEAST, lift: float = LIFT, longest: int = LONGEST) -> DataFrame:
    """(word, size, n, cost) of at most ``most`` words: single syllables, and runs of them that keep together. Counted over all
    texts (lower-cased) with partial aggregation; null and empty texts count nothing."""
    own = written(texts.select(t.words(F.lower(F.col(text_col))).alias("w")).filter(F.size("w") > 0), "syllables")
    counts = None
    for size in range(1, longest + 1):
        run = F.expr(f"transform(slice(w, 1, size(w) - {size - 1}), (x, i) -> concat_ws(' ', x{''.join(f', w[i + {k}]' for k in range(1, size))}))") if size > 1 else F.col("w")
        runs = own.filter(F.size("w") >= size).select(F.explode(run).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("size", F.lit(size))
        counts = runs if counts is None else counts.unionByName(runs)
    counts = written(counts, "runs")
    total = counts.filter("size = 1").agg(F.sum("n")).first()[0] or 0
    # a run without its last syllable, and that syllable, are at least as frequent as the run
    part = lambda c, name: counts.select(F.col("word").alias(c), F.col("n").alias(name))
    head, tail = F.regexp_extract("word", "^(.*) [^ ]+$", 1), F.regexp_extract("word", "([^ ]+)$", 1)
    long = counts.filter("size > 1").withColumns({"_head": head, "_tail": tail}).join(part("_head", "_nh"), "_head").join(part("_tail", "_nt"), "_tail")
    together = long.filter(F.col("n").cast("double") * total >= lift * F.col("_nh").cast("double") * F.col("_nt")).select("word", "size", "n")
    kept = counts.filter("size = 1").select("word", "size", "n").unionByName(together).orderBy(F.desc("n"), "word").limit(most)
    return kept.withColumn("cost", F.round(-1000 * F.log(F.col("n") / F.lit(float(total or 1)))).cast("long"))


class Trie:
    """Costs of words by their syllables. A syllable that is in no entry costs ``unknown``."""

    def __init__(self, costs: dict[str, int]):
        self.root: dict = {}
        self.unknown = max(costs.values(), default=0) + 1000
        for word, cost in costs.items():
            *heads, last = word.split(" ")
            node = self.root
            for syllable in heads:
                node = node.setdefault(syllable, [None, {}])[1]
            node.setdefault(last, [None, {}])[0] = cost

    def cut(self, syllables: list[str]) -> list[str]:
        """The words of the cheapest cut."""
        return self.cut_at(syllables)[0]

    def cut_at(self, syllables: list[str]) -> tuple[list[str], int]:
        """The words of the cheapest cut, and its cost."""
        n = len(syllables)
        best: list[tuple[int, int]] = [(0, 0)] + [(1 << 62, 0)] * n
        back = [0] * (n + 1)
        for i in range(n):
            cost, words = best[i]
            node, j = self.root, i
            while j < n and (entry := node.get(syllables[j])):
                j += 1
                if entry[0] is not None and (found := (cost + entry[0], words + 1)) < best[j]:
                    best[j], back[j] = found, i
                node = entry[1]
            if (found := (cost + self.unknown, words + 1)) < best[i + 1] and (syllables[i] not in self.root or self.root[syllables[i]][0] is None):
                best[i + 1], back[i + 1] = found, i
        out = []
        while n:
            out.append(" ".join(syllables[back[n] : n]))
            n = back[n]
        return out[::-1], best[len(syllables)][0]


def segmenter(entries: DataFrame | None):
    """A column function for :func:`quern.functions.text.tokenize`: texts to words. ``entries``: a :func:`lexicon`, of bounded
    size; None, or one without entries, cuts at blanks."""
    trie = _trie(entries)
    return (lambda c: _cut(c, trie)["words"]) if trie else t.words


def _trie(entries: DataFrame | None) -> Trie | None:
    costs = {r.word: r.cost for r in entries.select("word", "cost").collect()} if entries is not None else {}
    return Trie(costs) if costs else None


def _cut(c: Column, trie: Trie) -> Column:
    """struct<words, cost> of a text. Syllables are listed a text at a time."""
    kind = pa.struct([("words", pa.list_(pa.string())), ("cost", pa.int64())])

    def run(texts: pa.Array) -> pa.Array:
        found = ([None if x is None else dict(zip(("words", "cost"), trie.cut_at(x.split(" ") if x else []), strict=True)) for x in part.to_pylist()] for part in pieces(texts))
        return pa.chunked_array([pa.array(rows, kind) for rows in found], kind).combine_chunks()

    return F.arrow_udf(run, "words array<string>, cost long")(F.array_join(t.words(c), " "))


def segmented(c: Column, entries: DataFrame | None) -> Column:
    """The words of a text; null stays null."""
    return segmenter(entries)(c)


def segmented_at(c: Column, entries: DataFrame) -> Column:
    """struct<words, cost>: the words of a text, and what its cut costs (without a lexicon: 1000 a word)."""
    trie = _trie(entries) or Trie({})
    return _cut(c, trie)
