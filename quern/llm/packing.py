"""Operator 6, best-fit packing with large-item matching.

All that packing needs of a document is its length, and lengths lie in 1..capacity, so the bins are computed on the
histogram of lengths, for the whole corpus at once, on the driver: its size is the capacity, whatever the corpus.

* Full pieces fill a sequence each.
* Large items (above a third of the capacity) pair at most twice per bin: in descending order each takes the largest
  other item that fits beside it; pairs are made for as many items of both lengths as there are.
* Smaller items, in descending order, go to the fullest bin with room for them (best fit), or else to new bins.

Bins with equal gaps are handled as runs of sequence numbers, and every placement is a run too: items ``lo..hi`` of one
length go to sequences ``seq..`` at one offset. A placement splits at most one run of bins, so the runs stay few.
Documents are then numbered within their length (counts per task and length, summed up over tasks) and look their place
up in the runs.
"""

from __future__ import annotations

import bisect
import math
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import byte_texts, ddl, give_back, slices, written

CAPACITY, END_ID = 4096, 1
CACHE = 350_000


def runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, lo, hi, sequence, offset): item lo + i of the length goes to sequence + i at the offset."""
    out: list[tuple[int, int, int, int, int]] = []
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    bins: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    gaps: list[int] = []  # ascending gaps of open bins
    opened = 0

    def put(length: int, many: int, first: int, offset: int) -> None:
        out.append((length, used[length], used[length] + many, first, offset))
        used[length] += many
        left[length] -= many

    def add(gap: int, first: int, many: int) -> None:
        if gap:
            if gap not in bins:
                bins[gap] = []
                bisect.insort(gaps, gap)
            bins[gap].append((first, many))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            room = capacity - n
            mate = next((m for m in large if m <= room and m <= n and left[m] and (m != n or left[n] > 1)), None)
            if mate is None:
                many = left[n]
                put(n, many, opened, 0)
            else:
                many = left[n] // 2 if mate == n else min(left[n], left[mate])
                put(n, many, opened, 0)
                put(mate, many, opened, n)
            add(room - (mate or 0), opened, many)
            opened += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):  # no room: full new bins, and one for the rest
                each = capacity // n
                for per_bin, many in ((each, left[n] // each), (left[n] % each, 1)):
                    if per_bin and many:
                        for k in range(per_bin):
                            put(n, many, opened, k * n)
                        add(capacity - per_bin * n, opened, many)
                        opened += many
                continue
            gap = gaps[at]
            first, free = bins[gap].pop()
            many = min(free, left[n])
            put(n, many, first, capacity - gap)
            if many < free:
                bins[gap].append((first + many, free - many))
            if not bins[gap]:
                del bins[gap], gaps[at]
            add(gap - n, first, many)
    return out


#: Punctuation that may follow a part's letters: the tokenizer's pattern parts the two, whatever stands around.
TAIL, LETTERS = b".,!?;:|*$%&#", bytes([*range(97, 123), *range(128, 256)])


class _Ids:
    """Token ids, as little-endian 32-bit bytes, of white-space-free parts of texts; two generations of bounded memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, parts: list[bytes]) -> None:
        ascii_words = [w for w in parts if w.isalpha()]
        words, others = [], []
        for w in parts if len(ascii_words) < len(parts) else ():
            if not w.isalpha():
                text = w.decode("utf-8", "replace")
                (words if text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha() else others).append(w)
        for at in range(0, len(others), 20_000):
            some = others[at : at + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                self.new[w] = array("I", e.ids).tobytes()
        # a part of letters only is one match of the pattern, so one token of it, its last, ends a word
        words = ascii_words + words
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            encoded = self.tokenizer.encode_batch_fast([b" ".join(some[k : k + 500]).decode() for k in range(0, len(some), 500)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in encoded])
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            self.new.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part."""
        if len(self.new) > CACHE:
            self.new, self.old = {}, self.new
        out = list(map(self.new.get, parts))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            missing = {parts[i] for i in gaps}
            again = self.old.keys() & missing
            self.new.update((w, self.old[w]) for w in again)
            plain, split = set(), []
            for w in missing - again:
                head = w.rstrip(TAIL)
                if len(head) < len(w) and head[-1:].isalpha() and not head.translate(None, LETTERS):
                    tail = w[len(head) :]
                    split.append((w, head, tail))
                    plain.add(head)
                    plain.add(tail)
                else:
                    plain.add(w)
            self._encode(list(plain - self.new.keys()))
            new = self.new
            for w, head, tail in split:
                new[w] = new[head] + new[tail]
            for i in gaps:
                out[i] = new[parts[i]]
        return out


_LOADED: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    """One tokenizer for each worker process, which runs many tasks."""
    if path not in _LOADED:
        _LOADED[path] = _Ids(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, 1):
            docs, piece, start, length, crc, kept = [], [], [], [], [], []
            # a text with "<|" may hold a special token's string, whose case tells
            parts = [(t if b"<|" in t else t.lower()).split() for t in byte_texts(batch.column(1))]
            ids = known.of(list(chain.from_iterable(parts)))
            upto = 0
            for d, p in enumerate(parts):
                whole = b"".join(ids[upto : upto + len(p)]) + end
                upto += len(p)
                for k in range(0, math.ceil(len(whole) / 4 / capacity)):
                    own = whole[4 * capacity * k : 4 * capacity * (k + 1)]
                    docs.append(d)
                    piece.append(k)
                    start.append(k * capacity)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if keep_ids:
                        kept.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(docs)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names)
        known.new, known.old = {}, {}
        give_back()

    return run


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids). Parts between ASCII white space are tokenized one by
    one, which gives the ids of the whole text: the tokenizer lower-cases, and its pattern never matches across white
    space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path or default_tokenizer(), capacity, keep_ids), schema)


def _number(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            n = batch.column(at).to_numpy()
            if not len(n):
                continue
            if n.max() >= len(seen):
                seen = np.concatenate([seen, np.zeros(int(n.max()) + 1 - len(seen), np.int64)])
            order = np.argsort(n, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], n[order][1:] != n[order][:-1]]))
            within = np.empty(len(n), np.int64)
            sizes = np.diff(np.append(heads, len(n)))
            within[order] = np.arange(len(n)) - np.repeat(heads, sizes)
            yield pa.record_batch([*batch.columns, pa.array(within + seen[n])], [*batch.schema.names, "_row"])
            seen[n[order][heads]] += sizes

    return run


def _place(held, length_at: int, row_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = held.value
        key = table[:, 0] * base + table[:, 1]
        for batch in batches:
            n, row = (batch.column(k).to_numpy() for k in (length_at, row_at))
            at = np.searchsorted(key, n * base + row, side="right") - 1
            hit = table[at] if len(n) else np.zeros((0, 5), np.int64)
            yield pa.record_batch([*batch.columns, pa.array(hit[:, 3] + row - hit[:, 1]), pa.array(hit[:, 4])], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` get ``sequence_id`` and ``offset``; repeated rows are packed each for itself."""
    spark = cut.sparkSession
    # the numbering refers to the rows of each written part
    names = cut.columns
    numbered = written(cut.withColumn("_part", F.spark_partition_id()).mapInArrow(_number(names.index("length")), ddl(cut) + ", _part int, _row long"), "pieces")
    counts = numbered.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = written(counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_before"]).withColumnRenamed("length", "_length").withColumnRenamed("_part", "_p"), "counts")
    # at most ``capacity`` rows
    histogram = {r._length: r.n for r in before.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    table = np.array(sorted(runs(histogram, capacity)), np.int64).reshape(-1, 5)
    base = max(histogram.values(), default=0) + 1
    # the runs are bounded by the capacity, not by the corpus
    held = spark.sparkContext.broadcast((table, base))
    # as many rows as there are tasks and lengths in them: joined by sorting, whatever its size
    ranked = numbered.join(before.drop("_n").hint("merge"), (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_length"))).select(*names, (F.col("_row") + F.col("_before")).alias("_rank"))
    schema = ddl(cut) + ", _rank long, sequence_id long, offset long"
    return ranked.mapInArrow(_place(held, names.index("length"), len(names)), schema).drop("_rank")


def packed(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; only texts longer than ``capacity`` are cut; repeated rows and ids are
    pieces of their own; an empty table gives an empty table; columns other than doc_id and text are not read. With
    ``keep_ids`` the token ids follow, so that ``sequence_id`` and ``offset`` rebuild the sequences.
    """
    return pack(pieces(docs, tokenizer_path, capacity, keep_ids), capacity)
