"""Operator 9, substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest, extended by bytes.

The gear hash of a byte position mixes the last ``WINDOW`` bytes only. A chunk ends at the position of the smallest hash of
every run of ``SPAN`` positions (winnowing; never inside a UTF-8 character), so where chunks end depends on content nearby,
and chunks have at most ``SPAN`` bytes. A digest covers a chunk and the ``WINDOW`` bytes before it: equal digests have equal
surroundings. A passage of at least ``2 * SPAN + WINDOW - 1`` bytes (223) that two texts share holds a chunk of equal
digest in both, whatever surrounds it. Where hashes repeat within ``SPAN`` bytes (runs of one short pattern), ends are
thinned out, and chunks may be longer, to ``MOST`` bytes.

Of equal chunks (96-bit digests) the first one stays, in the order of document ids and positions. A run of repeated
chunks whose first copies are neighbours too is extended byte by byte over what surrounds those (up to ``REACH`` bytes
on either side). What such runs cover is narrowed to whole words, and cut if it has at least ``RUN`` bytes or is the whole
text. Digests are counted with partial aggregation; the repeated ones are written and joined back by key, a join of two
shuffles, which Spark splits where a chunk is very common. Nothing is collected, and a step's tables go when the next is
written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_texts, discard, give_back, slices, written

SPAN, MOST, RUN = 96, 256, 120
WINDOW = 32
#: A passage starts and ends at most so many bytes beside the chunks that it is sure to share.
REACH = SPAN + WINDOW
#: Positions whose hashes are in memory at once, and bytes of text and rows whose repeats are.
BLOCK, ROWS = 1 << 18, 200
#: Bytes at either end of a span within which it is narrowed to whole words; text without a gap so long is cut as it is.
TRIM = 64
_GEAR = np.random.default_rng(20240901).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the table's values of the last 32 bytes, each shifted by its age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def _thinned(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``places`` without those that follow an equal hash within half of ``SPAN``."""
    near = (np.diff(places) < SPAN // 2) & (hashes[1:] == hashes[:-1])
    if not near.any():
        return places
    keep = np.ones(len(places), bool)
    last = 0
    for i, (at, again) in enumerate(zip(places[1:].tolist(), (hashes[1:] == hashes[:-1]).tolist(), strict=True), 1):
        if again and at - places[last] < SPAN // 2:
            keep[i] = False
        else:
            last = i
    return places[keep]


def _least(joined: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The positions of the smallest hash (the first of equal ones) of ``SPAN`` positions, over the starts in ``valid``."""
    found = []
    for a in range(WINDOW, len(joined), BLOCK):
        starts = np.flatnonzero(valid[a : a + BLOCK])
        if not len(starts):
            continue
        data = joined[a - WINDOW : a + BLOCK + SPAN]
        h = gear(data)
        h[:-1][data[1:] & 0xC0 == 0x80] = 2**32 - 1
        low = (h[WINDOW:].astype(np.uint64) << np.uint64(32)) | np.arange(len(h) - WINDOW, dtype=np.uint64)
        # the least of 64 positions by doubling, then of SPAN
        for k in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-k], low[k:])
        least = np.minimum(low[: 64 - SPAN], low[SPAN - 64 :])[starts]
        places = (least & np.uint64(2**32 - 1)).astype(np.int64)
        new = np.diff(places, prepend=-1) != 0
        found.append(np.stack([places[new] + a, (least[new] >> np.uint64(32)).astype(np.int64)]))
    out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return out[:, np.diff(out[0], prepend=-1) != 0]


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks, the last being its length; none for an empty text."""
    gap = b"\0" * WINDOW
    joined = np.frombuffer(gap + gap.join(texts) + gap + b"\0" * SPAN, np.uint8)
    valid, start = np.zeros(len(joined), bool), WINDOW
    for text in texts:
        if len(text) > SPAN:
            valid[start : start + len(text) - SPAN + 1] = True
        start += len(text) + WINDOW
    places, hashes = _least(joined, valid)
    out, start = [], WINDOW
    for text in texts:
        size = len(text)
        a, b = np.searchsorted(places, (start, start + size))
        own = (_thinned(places[a:b], hashes[a:b]) - start + 1).tolist()
        if size and own[-1:] != [size]:
            own.append(size)
        out.append(own)
        start += size + WINDOW
    return out


def _digest(text: bytes, a: int, b: int) -> bytes:
    """Of the chunk text[a:b] and what stands before it: twelve bytes."""
    before = text[max(0, a - WINDOW) : a]
    return xxhash.xxh3_128_digest(b"\0" * (WINDOW - len(before)) + before + text[a:b])[:12]


_DIGEST = np.dtype([("d0", "<i8"), ("d1", "<i4")])


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gap = b"\0" * WINDOW
    for batch in slices(batches, 1, BLOCK):
        texts = byte_texts(batch.column(1))
        digests, counts = [], []
        for text, ends in zip(texts, chunk_ends(texts), strict=True):
            padded = gap + text
            digests += [xxhash.xxh3_128_digest(padded[a : b + WINDOW])[:12] for a, b in zip([0, *ends[:-1]], ends, strict=False)]
            counts.append(len(ends))
        edges = pa.array(np.cumsum([0, *counts]).astype(np.int32))
        both = np.frombuffer(b"".join(digests), _DIGEST)
        flat = [pa.array(np.ascontiguousarray(both[k])) for k in ("d0", "d1")]
        yield pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(edges, f) for f in flat)], ["id", "d0", "d1"])


def chunked(docs: DataFrame) -> DataFrame:
    """``docs``: (id, text). Per document the digests of its chunks."""
    return docs.mapInArrow(_chunk, f"id {docs.schema[0].dataType.simpleString()}, d0 array<long>, d1 array<int>")


def _runs(cut: list[dict]) -> list[list[dict]]:
    """Repeated chunks of a document in order, by runs of neighbours whose first copies are neighbours too."""
    cut = list({c["at"]: c for c in sorted(cut, key=lambda c: c["at"])}.values())
    breaks = [0, *(i for i in range(1, len(cut)) if any(cut[i][k] != cut[i - 1][k] + d for k, d in (("at", 1), ("first", 0), ("first_at", 1)))), len(cut)]
    return [cut[a:b] for a, b in zip(breaks, breaks[1:], strict=False)]


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS))
    give_back()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "at", "after", "first_id", "first_at", "d0"]
    for batch in _few_rows(batches):
        rows = []
        for own, cut in zip(batch.column("id").to_pylist(), batch.column("cut").to_pylist(), strict=True):
            for run in _runs(cut):
                rows += [(own, c["at"], after, c["first"], c["first_at"], c["d0"]) for c, after in ((run[0], False), (run[-1], True))]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [batch.column("id").type, pa.int32(), pa.bool_(), batch.column("id").type, pa.int32(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _is_chunk(text: bytes, at: list[int], asked: dict) -> bool:
    """Whether the text's chunk of that number has that digest: rows that repeat an id may hold other texts."""
    k = asked["at"]
    return k + 1 < len(at) and int.from_bytes(_digest(text, at[k], at[k + 1])[:8], "little", signed=True) == asked["d0"]


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of each document, the text of those with repeats, and the bytes asked for beside chunks."""
    piece = pa.list_(pa.struct([("at", pa.int32()), ("after", pa.bool_()), ("piece", pa.binary())]))
    for batch in slices(_few_rows(batches), 1, BLOCK):
        texts = byte_texts(batch.column("text"))
        pieces = []
        asked = batch.column("asked").to_pylist()
        ends = chunk_ends(texts)
        for text, own, asks in zip(texts, ends, asked, strict=True):
            at = [0, *own]
            pieces.append([{"at": a["at"], "after": a["after"], "piece": text[at[a["at"] + 1] : at[a["at"] + 1] + REACH] if a["after"] else text[max(0, at[a["at"]] - REACH) : at[a["at"]]]} for a in asks or () if _is_chunk(text, at, a)])
        kept = pa.array([t if c else None for t, c in zip(texts, batch.column("cut").to_pylist(), strict=True)], pa.binary())
        chars = pa.array([len(t.decode()) for t in texts], pa.int64())
        yield pa.record_batch([batch.column("id"), pa.array(map(len, ends), pa.int64()), chars, kept, pa.array(pieces, piece)], ["id", "n_chunks", "n_chars", "text", "pieces"])


def _common(a: bytes, b: bytes) -> int:
    """How many bytes at the start of both are equal."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _wordy(byte: int) -> bool:
    return byte >= 0x80 or chr(byte).isalnum()


def _narrowed(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of text[a:b] that has whole words, without white space around it."""
    for at in range(a, min(b, a + TRIM)):
        if at == 0 or not (_wordy(text[at - 1]) and _wordy(text[at])):
            a = at
            break
    for at in range(b, max(a, b - TRIM), -1):
        if at == len(text) or not (_wordy(text[at - 1]) and _wordy(text[at])):
            b = at
            break
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    inner = text[a:b]
    return a + len(inner) - len(inner.lstrip()), a + len(inner.rstrip())


def _spans_of(text: bytes, cut: list[dict], pieces: list[dict]) -> list[tuple[int, int, int, set]]:
    """(start, end, chunks, first ids) of what is cut, in bytes."""
    at = [0, *chunk_ends([text])[0]]
    beside: dict[tuple, list[bytes]] = {}
    for p in pieces:
        beside.setdefault((p["at"], p["after"]), []).append(p["piece"])
    runs = []
    for run in _runs([c for c in cut if _is_chunk(text, at, c)]):
        if not run:
            continue
        a, b = at[run[0]["at"]], at[run[-1]["at"] + 1]
        a -= max((_common(text[max(0, a - REACH) : a][::-1], p[::-1]) for p in beside.get((run[0]["at"], False), ())), default=0)
        b += max((_common(text[b : b + REACH], p) for p in beside.get((run[-1]["at"], True), ())), default=0)
        runs.append((run[0]["first"], a, b, len(run)))
    # a document keeps what no earlier one does
    held, owners = np.zeros(len(text), bool), []
    for first, a, b, _ in sorted(runs):
        if not held[slice(*_narrowed(text, a, b))].all():
            owners.append((a, first))
        held[a:b] = True
    steps = np.flatnonzero(np.diff(held, prepend=False, append=False)).tolist()
    out = []
    for whole_a, whole_b in zip(steps[::2], steps[1::2], strict=True):
        whole = (whole_a, whole_b) == (0, len(text))
        a, b = (whole_a, whole_b) if whole else _narrowed(text, whole_a, whole_b)
        if b - a >= RUN or whole:
            out.append((a, b, sum(n for _, x, _, n in runs if whole_a <= x < whole_b), {f for x, f in owners if whole_a <= x < whole_b}))
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in slices(_few_rows(batches), 3, BLOCK):
        rows, owners = [], []
        for own, n_chunks, n_chars, text, cut, pieces in zip(*(batch.column(c).to_pylist() for c in ("id", "n_chunks", "n_chars", "text", "cut", "pieces")), strict=True):
            spans, n, dropped, first, done, chars = [], 0, 0, set(), 0, 0
            for a, b, k, firsts in _spans_of(text, cut, pieces or []) if cut else ():
                start = chars + len(text[done:a].decode())
                done, chars = b, start + len(text[a:b].decode())
                spans.append({"start": start, "end": chars})
                n, dropped, first = n + k, dropped + chars - start, first | firsts
            rows.append((n_chunks, n, dropped, n_chars - dropped, spans))
            owners.append(sorted(first - {own}))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        ids = batch.column("id")
        yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], kind), pa.array(owners, pa.list_(ids.type))], ["id", "n_chunks", "n_dropped", "dropped_chars", "kept_chars", "spans", "first_ids"])


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_chunks, n_dropped (repeated chunks of what is cut), dropped_chars, kept_chars, spans (code point
    ranges to cut), first_ids (the other documents that keep what is cut here).

    A null or empty text has no chunks. Rows that repeat an id with the same text are one document; where rows of one id
    hold different texts, each keeps a chunk that is the first at its place, and loses what other rows hold earlier. Rows
    with a null id are never cut and never make others cut. An empty table gives an empty table; other columns are not
    read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema[0].dataType.simpleString()
    chunks = written(chunked(own), "chunks")
    tall = chunks.filter("id IS NOT NULL").select("id", F.posexplode(F.arrays_zip("d0", "d1")).alias("at", "d")).select("id", "at", "d.d0", "d.d1")
    first = written(tall.groupBy("d0", "d1").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    repeated = tall.join(first, ["d0", "d1"]).filter((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    cut = written(repeated.groupBy("id").agg(F.collect_list(F.struct("at", "d0", F.col("first.id").alias("first"), F.col("first.at").alias("first_at"))).alias("cut")), "cut")
    discard(chunks, first)
    edges = written(cut.mapInArrow(_edges, f"id {kind}, at int, after boolean, first_id {kind}, first_at int, d0 long"), "edges")
    asked = edges.select("first_id", "first_at", "after", "d0").distinct().groupBy("first_id").agg(F.collect_list(F.struct(F.col("first_at").alias("at"), "after", "d0")).alias("asked"))
    want = cut.select("id", F.lit(True).alias("cut")).join(asked.withColumnRenamed("first_id", "id"), "id", "full")
    looked = written(own.join(want, "id", "left").mapInArrow(_looked_up, f"id {kind}, n_chunks long, n_chars long, text binary, pieces array<struct<at:int,after:boolean,piece:binary>>"), "looked")
    answers = looked.filter("size(pieces) > 0").select(F.col("id").alias("first_id"), F.explode("pieces").alias("p")).select("first_id", F.col("p.at").alias("first_at"), "p.after", "p.piece").distinct()
    pieces = written(edges.join(answers, ["first_id", "first_at", "after"]).groupBy("id").agg(F.collect_list(F.struct("at", "after", "piece")).alias("pieces")), "pieces")
    discard(edges)
    return looked.drop("pieces").join(cut, "id", "left").join(pieces, "id", "left").mapInArrow(_spans, f"id {kind}, n_chunks long, n_dropped long, dropped_chars long, kept_chars long, spans array<struct<start:int,end:int>>, first_ids array<{kind}>")


def cut_spans(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the planned spans; all columns stay."""
    spans = planned.filter("n_dropped > 0").select(F.col("id").alias("_id"), F.col("spans").alias("_spans")).distinct()
    joined = docs.join(spans, F.col(id_col) == F.col("_id"), "left")
    text = F.col(text_col)
    starts = F.concat(F.array(F.lit(0)), F.col("_spans.end"))
    ends = F.concat(F.col("_spans.start"), F.array(F.length(text)))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substring(text, s["a"] + 1, s["b"] - s["a"])), "")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(kept)).drop("_id", "_spans")
