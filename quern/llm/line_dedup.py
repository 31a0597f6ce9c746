"""Operator 7, line dedup: a sharded minimal perfect hash over all distinct line hashes, probed by the documents.

1. Every document emits the 128-bit hashes of its distinct line keys; Spark counts documents per hash (partial
   aggregation first, so a line in a third of all documents costs one row a task).
2. All distinct hashes are dealt to shards of bounded size. Each shard gets a minimal perfect hash: levels of bit arrays,
   a key that meets no other key at its level's position stays there, the rest go down a level; the rank of the bit is
   the key's slot. Beside it lie an array of 32-bit fingerprints (of the half of the hash that the slots do not use) and
   an array of counts, in the smallest type that holds them. Hashes whose slot half is that of another one (2^-64 a pair)
   lie in a short list beside the arrays. Shards are ``.npy`` arrays in the shared folder.
3. Documents probe the arrays, with no join on lines: workers map the shards that a batch's lines ask for into memory,
   look counts up, and the threshold decides then. A line of the indexed documents is always a member, so its count is
   exact; a line that no indexed document holds passes for a member with a chance of 2^-32.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_shard, byte_texts, ddl, discard, load_whole, save_whole, shared_dir, slices, written

STRIP = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser that differs by level."""
    with np.errstate(over="ignore"):
        x = x + _GOLD * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Ones in each byte.
ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: maps each to its own slot in 0..n-1.

    >>> h = PerfectHash.build(np.array([5, 9, 12], np.uint64)); sorted(h.slots(np.array([5, 9, 12], np.uint64)))
    [0, 1, 2]
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rank: np.ndarray | None = None):
        self.sizes, self.bits = sizes, bits
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        #: ones before each byte
        self.rank = np.concatenate([[0], np.cumsum(ONES[bits])]).astype(np.uint32) if rank is None else rank

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = 8 * math.ceil(max(8, gamma * len(left)) / 8)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            sizes.append(size)
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit (then it is surely no member)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64) + self.offsets[level]
            byte, bit = at >> 3, at & 7
            hit = (self.bits[byte] >> (7 - bit).astype(np.uint8)) & 1 == 1
            before = ONES[(self.bits[byte[hit]].astype(np.uint16) >> (8 - bit[hit]).astype(np.uint16)).astype(np.uint8)]
            out[todo[hit]] = self.rank[byte[hit]].astype(np.int64) + before
            todo = todo[~hit]
        return out


def line_keys(text: bytes) -> list[bytes]:
    """The key of each ``\\n``-split line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(STRIP).lower() for x in text.split(b"\n")]


def _halves(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as an array of two unsigned 64-bit columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _emit_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            keys = [k for t in byte_texts(batch.column(0)) for k in set(line_keys(t)) if _long_enough(k, least)]
            if keys:
                rows, n = np.unique(np.ascontiguousarray(_halves(keys)).view("<u8,<u8").ravel(), return_counts=True)
                yield pa.record_batch([pa.array(rows["f0"].view("<i8")), pa.array(rows["f1"].view("<i8")), pa.array(n)], ["a", "b", "n"])

    return run


def _build_shard(folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b, n = (group[c].to_numpy() for c in ("a", "b", "n"))
        keys = a.view(np.uint64)
        order = np.lexsort((b, keys))
        keys, b, n = keys[order], b[order], n[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        table = PerfectHash.build(keys[first])
        slot = table.slots(keys[first])
        prints, counts = np.empty(len(slot), np.uint32), np.empty(len(slot), np.min_scalar_type(int(n.max())))
        prints[slot], counts[slot] = b[first].view(np.uint64) >> np.uint64(32), n[first]
        rest = np.stack([keys[~first].view(np.int64), b[~first], n[~first]])
        shard = int(group["shard"].iloc[0])
        save_whole(folder, f"lines-{shard}", {"sizes": table.sizes, "bits": table.bits, "rank": table.rank, "prints": prints, "counts": counts, "rest": rest})
        return pd.DataFrame({"shard": [shard], "keys": [len(keys)]})

    return run


def line_index(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> tuple[str, int]:
    """The folder of the index of all line keys of at least ``min_chars`` code points, and its number of shards."""
    emitted = docs.select(F.col(text_col).alias("text")).mapInArrow(_emit_keys(min_chars), "a long, b long, n long")
    lines = written(emitted.groupBy("a", "b").agg(F.sum("n").alias("n")), "lines")
    shards = max(1, math.ceil(lines.count() / SHARD_KEYS))
    folder = shared_dir(docs.sparkSession)
    built = lines.withColumn("shard", F.pmod("b", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build_shard(folder), "shard int, keys long")
    built.agg(F.sum("keys")).collect()
    discard(lines)
    return folder, shards


class Probe:
    """Looks counts up in the mapped shards. A shard is opened when a batch asks for it and not kept: a store that can't be
    mapped holds as much as :func:`quern.llm.common.load` bounds. Shards without lines are remembered by number."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.none: set[int] = set()

    def _table(self, shard: int) -> dict[str, np.ndarray] | None:
        if shard in self.none:
            return None
        try:
            return load_whole(self.folder, f"lines-{shard}")
        except FileNotFoundError:  # no line fell there
            self.none.add(shard)
            return None

    def counts(self, halves: np.ndarray) -> np.ndarray:
        """For each 128-bit hash its count of documents, 0 if no document has it."""
        a, b = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        out = np.zeros(len(a), np.int64)
        for shard, at in by_shard(np.mod(b.view(np.int64), self.shards)):
            table = self._table(shard)
            if table is None:
                continue
            slot = PerfectHash(table["sizes"], table["bits"], table["rank"]).slots(a[at])
            at, slot = at[slot >= 0], slot[slot >= 0]
            same = table["prints"][slot] == b[at] >> np.uint64(32)
            out[at[same]] = table["counts"][slot[same]]
            for x, y, n in table["rest"].T.tolist():
                out[(a.view(np.int64) == x) & (b.view(np.int64) == y)] = n
        return out


def _cut(folder: str, shards: int, min_docs: int, min_chars: int, at: int, stats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(folder, shards)
        for batch in slices(batches, at):
            texts = byte_texts(batch.column(at))
            lines = [line_keys(t) for t in texts]
            size = np.cumsum([0, *map(len, lines)])
            flat = [k for x in lines for k in x]
            # equal keys of a batch are looked up once; keys that are too short are not in the index
            known = {k: i for i, k in enumerate(dict.fromkeys(flat))}
            n = probe.counts(_halves(list(known)))
            n *= np.fromiter((_long_enough(k, min_chars) for k in known), bool, len(known))
            common = n[np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))] >= min_docs
            kept, dropped = [], []
            for t, a, b in zip(texts, size[:-1], size[1:], strict=True):
                gone = common[a:b]
                dropped.append(int(gone.sum()))
                kept.append(b"\n".join(x for x, c in zip(t.split(b"\n"), gone.tolist(), strict=True) if not c) if dropped[-1] else t)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            valid = batch.column(at).is_valid().to_pylist()
            columns[batch.schema.names[at]] = pa.array([k.decode("utf-8", "replace") if ok else None for k, ok in zip(kept, valid, strict=True)], pa.string())
            arrays, names = list(columns.values()), list(columns)
            if stats:
                arrays += [pa.array(np.diff(size), pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names += ["_n_lines", "_n_dropped", "_sha"]
            yield pa.record_batch(arrays, names)

    return run


def drop_common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, stats: bool = False) -> DataFrame:
    """``docs`` without the lines whose key is found in at least ``min_docs`` documents, in every document.

    Every row is a document, also where rows repeat an id or a text. Other columns stay as they are, whatever their names.
    A null text stays null and counts as one empty line; a line whose key has fewer than ``min_chars`` code points is never
    cut; an empty table gives an empty table. With ``stats`` the columns ``_n_lines``, ``_n_dropped`` and ``_sha`` (SHA-256
    of the kept text) follow.
    """
    folder, shards = line_index(docs, text_col, min_chars)
    schema = ddl(docs) + (", _n_lines long, _n_dropped long, _sha string" if stats else "")
    return docs.mapInArrow(_cut(folder, shards, min_docs, min_chars, docs.columns.index(text_col), stats), schema)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10) -> DataFrame:
    """Per document (row): doc_id, n_lines, n_dropped, kept_sha256."""
    cut = drop_common_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_docs=min_docs, stats=True)
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("_sha").alias("kept_sha256"))


#: DuckDB over the view ``documents``.
ORACLE_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM r),
k AS (SELECT row, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS cut FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS kept_sha256
FROM m GROUP BY row
"""
