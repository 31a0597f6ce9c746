"""Operator 11, suffix-array dedup: repeated 50-byte strings from merged Burrows-Wheeler transforms.

Which suffixes have to be compared is settled first, by content. Of the ``WIDTH`` 16-byte strings inside a 50-byte window the
one of smallest hash (the first of equal ones) is its anchor; equal windows have equal anchors at equal places. A run of
windows with one anchor is a *fragment* (at most 84 bytes). Anchors are grouped:

* an anchor of one document only says that its windows are not repeated elsewhere (the task that gets an anchor's occurrences
  sees that, and the next; those of very common anchors are joined instead);
* of equal fragments (by anchor and a 64-bit digest) all but those in the smallest document that holds them go whole;
* the distinct fragments of an anchor that has more than one come together, each with that document.

There shards of fragments, each sorted by the first bytes of its suffixes, are merged: the interleave of the shards is refined
by one symbol in an iteration - the symbols before the suffixes (the transform), read in the order of the interleave and
placed stably, order the suffixes that start there by one more byte - so suffixes are never sorted again. Where a border
first shows gives the common prefix of neighbours; suffixes that share less than the iteration's depth with all others leave
(what is before them can't be shared either), and what is left after depth 50 are the repeated intervals. The smallest
document of an interval keeps the window, the other fragments lose it.

Fragments of an anchor that has more than ``GROUP`` distinct ones (the edge of a very common passage) are cut into pieces of 18
windows, grouped by the 33 bytes that these share; groups that are still too large into pieces of 9, 4, and 2 windows, which
share 49 bytes: at most 65,536 distinct pieces can have these. Nothing else grows in a task but a
document. Rows of one id don't take bytes from each other; null ids come after all others; null and empty texts have a row
with nothing removed; rows that repeat id and text have equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import byte_texts, discard, give_back, slices, written

#: Bytes of a string that counts as repeated, of an anchor; anchors in a window.
DEPTH, ANCHOR = 50, 16
WIDTH = DEPTH - ANCHOR + 1
#: Depth at which shards are sorted before they are merged (the bytes of a key), and windows of a shard.
START, SHARD = 8, 1 << 16
#: Bytes of fragments that are merged at once (whole groups), and distinct fragments that a group has at most.
BATCH, GROUP = 4 << 20, 10_000
#: Windows of the pieces of fragments that a group has too many of, one after the other.
PIECES = (18, 9, 4, 2)
#: Bytes of a bucket's occurrences that wait for its end at most (on average a quarter of ``PER_PART`` and its double).
WAITING = 64 << 20
#: Window starts whose anchors are found at once.
BLOCK = 1 << 18
#: Bytes of text whose occurrences a task gets, in four buckets; about twice as many bytes.
PER_PART = 16 << 20
#: Stands for a null id.
LAST = 2**63 - 1
_TABLE = np.random.default_rng(20240911).integers(0, 2**63, 256, dtype=np.uint64)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def anchors(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes that start at each place."""
    h = _TABLE[data]
    for k, odd in enumerate(_ODD):
        h = h[: -(1 << k)] * np.uint64(odd) + h[1 << k :]
    h ^= h >> np.uint64(32)
    return h * np.uint64(_ODD[0])


def fragments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one anchor: how many each text has; the hash of the anchor, the first window, the number of
    windows and a digest of the bytes of each. Texts are hashed together, a block of window starts at a time."""
    data = np.frombuffer(b"".join(texts) + bytes(2 * DEPTH), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(length)
    begin = end - length
    found, starts, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], -1
    for a in range(0, len(data) - 2 * DEPTH, BLOCK):
        b = min(len(data) - 2 * DEPTH, a + BLOCK)
        inside = np.ones(b - a, bool)
        for text in range(int(np.searchsorted(end, a, side="right")), int(np.searchsorted(begin, b, side="left"))):
            inside[max(0, max(begin[text], end[text] - DEPTH + 1) - a) : max(0, end[text] - a)] = False
        valid = np.flatnonzero(inside)
        if not len(valid):
            continue
        h = anchors(data[a : b + DEPTH - 1])
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        # the least of 32 places by doubling, then of 35
        for k in (1, 2, 4, 8, 16):
            low = np.minimum(low[:-k], low[k:])
        least = np.minimum(low[: 32 - WIDTH], low[WIDTH - 32 :])
        place = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(place + a, prepend=before))
        found.append(h[place[new]].view(np.int64))
        starts.append(valid[new] + a)
        before = int(place[-1]) + a
    anchor, start = np.concatenate(found), np.concatenate(starts)
    text = np.searchsorted(end, start, side="right")
    size = np.minimum(np.append(start[1:], len(data)), end[text] - DEPTH + 1) - start
    return np.bincount(text, minlength=len(texts)), anchor, start - begin[text], size, _digests(data, start, size)


def _digests(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each fragment, from the hashes of 16-byte strings that cover it: 48 bytes from either end."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = int(np.searchsorted(start, start[at] + BLOCK))
        base = start[at]
        h = anchors(data[base : start[upto - 1] + size[upto - 1] + DEPTH])
        first, last = start[at:upto] - base, start[at:upto] - base + size[at:upto] + DEPTH - 1
        own = size[at:upto].astype(np.uint64)
        for k, odd in zip((0, 16, 32), _ODD, strict=False):
            own = (own ^ h[first + k]) * np.uint64(odd)
            own ^= own >> np.uint64(29)
            own = (own ^ h[last - 16 - k]) * np.uint64(odd)
            own ^= own >> np.uint64(31)
        out[at:upto] = own
        at = upto
    return out.view(np.int64)


#: An occurrence of a fragment: columns of a packed row, one behind the other.
_COLUMNS = (("anchor", "<i8"), ("digest", "<i8"), ("doc", "<i8"), ("check", "<i4"), ("at", "<i4"), ("size", "u1"))
_BYTES = sum(np.dtype(t).itemsize for _, t in _COLUMNS)
#: A judged occurrence, and what becomes of it.
_FATES = (("doc", "long"), ("check", "int"), ("at", "int"), ("size", "int"), ("anchor", "long"), ("digest", "long"), ("fate", "byte"))
WHOLE, FEW, MANY, OPEN = range(4)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Their number, then the columns, compressed; documents as differences. The bytes of a place in a number lie together."""
    columns = [*columns[:2], np.diff(columns[2], prepend=0), *columns[3:]]
    planes = b"".join(np.ascontiguousarray(c.astype(t)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, (_, t) in zip(columns, _COLUMNS, strict=True))
    return len(columns[0]).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(rows: list[bytes]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in _COLUMNS]
    for row in rows:
        n, at = int.from_bytes(row[:4], "little"), 0
        planes = np.frombuffer(pa.decompress(row[4:], n * _BYTES, codec="zstd"), np.uint8)
        for column, (_, t) in zip(out, _COLUMNS, strict=True):
            width = np.dtype(t).itemsize
            column.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(t).ravel())
            at += n * width
        out[2][-1] = np.cumsum(out[2][-1])
    return [np.concatenate(c) for c in out]


def _listed(buckets: int):
    """Rows (doc, check, text) to packed occurrences of their fragments, a row a bucket of anchors and slice of texts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            counts, anchor, at, size, digest = fragments(byte_texts(batch.column(2)))
            doc, check = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), counts) for k in (0, 1))
            bucket = (anchor.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            columns = [c[order] for c in (anchor, digest, doc, check, at, size)]
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            rows = [_packed([c[a:b] for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([pa.array(bucket[order][cuts[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "rows"])

    return listed


def _judged(columns: list[np.ndarray], group_size: int) -> list[np.ndarray]:
    """All occurrences of some anchors to those that can lose bytes: doc, check, at, size, anchor, digest, what becomes of them:
    ``WHOLE`` (the fragment occurs in a smaller document; its name is not needed any more), else whether the anchor has more than ``group_size`` distinct ones (``MANY``, ``FEW``)."""
    order = np.lexsort((columns[1], columns[0]))
    anchor, digest, doc, check, at, size = (c[order] for c in columns)
    new_anchor = np.diff(anchor, prepend=anchor[:1] - 1) != 0
    new = new_anchor | (np.diff(digest, prepend=digest[:1]) != 0)
    heads, groups = np.flatnonzero(new), np.flatnonzero(new_anchor)
    if not len(heads):
        return [doc, check, at, size, anchor, digest, np.zeros(0, np.int8)]
    later = np.minimum.reduceat(doc, heads)[np.cumsum(new) - 1] < doc
    distinct = np.add.reduceat(new.astype(np.int64), groups)
    meets = (np.minimum.reduceat(doc, groups) < np.maximum.reduceat(doc, groups)) & (distinct > 1)
    group = np.cumsum(new_anchor) - 1
    fate = np.where(later, WHOLE, np.where(distinct > group_size, MANY, FEW)[group]).astype(np.int8)
    kept = later | meets[group]
    return [c[kept] for c in (doc, check, at, size, np.where(later, 0, anchor), np.where(later, 0, digest), fate)]


def _shared(group: int, most: int):
    """Packed rows, sorted by bucket, to what :func:`_judged` says of each bucket. If more than ``most`` bytes of occurrences
    wait for the bucket's end, those of its commonest anchors are let through as they are (``OPEN``), the later ones too: what
    waits is then the rest of the bucket's anchors."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, held, size, bucket = np.zeros(0, np.int64), [], [], 0, -1

        def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int64, np.int64, np.int8)
            return pa.record_batch([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], [n for n, _ in _FATES])

        def as_they_are(columns: list[np.ndarray]) -> pa.RecordBatch:
            anchor, digest, doc, check, at, n = columns
            return batch_of([doc, check, at, n, anchor, digest, np.full(len(doc), OPEN)])

        def added() -> Iterator[pa.RecordBatch]:
            """Takes what is held to what waits."""
            nonlocal known, waiting, held, size
            columns = _unpacked(held)
            if len(known):
                met = np.isin(columns[0], known)
                yield as_they_are([c[met] for c in columns])
                columns = [c[~met] for c in columns]
            waiting = [np.concatenate(x) for x in zip(waiting, columns, strict=True)] if waiting else columns
            held, size = [], 0
            if len(waiting[0]) * _BYTES > most:
                found, n = np.unique(waiting[0], return_counts=True)
                order = np.argsort(-n, kind="stable")
                # the fewest anchors without which half as much waits
                common = order[: int(np.searchsorted(np.cumsum(n[order]), len(waiting[0]) - most // 2 // _BYTES)) + 1]
                known = np.union1d(known, found[common])
                met = np.isin(waiting[0], found[common])
                yield as_they_are([c[met] for c in waiting])
                waiting = [c[~met] for c in waiting]

        def ended() -> pa.RecordBatch:
            nonlocal known, waiting
            out = batch_of(_judged(waiting, group))
            known, waiting = np.zeros(0, np.int64), []
            return out

        for batch in batches:
            for number, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (number != bucket or size >= BATCH):
                    yield from added()
                if number != bucket:
                    if waiting:
                        yield ended()
                    known, bucket = np.zeros(0, np.int64), number
                held.append(row)
                size += int.from_bytes(row[:4], "little") * _BYTES
        if held:
            yield from added()
        if waiting:
            yield ended()
        give_back()

    return shared


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, check, text, doc_id): what tells rows apart, but for those that repeat id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.hash(text).alias("check"), text.alias("text"), "doc_id")


def judged(docs: DataFrame) -> DataFrame:
    """The occurrences of fragments that can lose bytes, and those of anchors that are too common for their bucket to judge.
    One shuffle of packed rows; buckets are as many as the bytes of the texts ask for."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PER_PART)
    packed = _keyed(docs).select("doc", "check", "text").mapInArrow(_listed(4 * parts), "bucket int, rows binary")
    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(GROUP, WAITING), ", ".join(map(" ".join, _FATES)))


def _of_common(met: DataFrame) -> DataFrame:
    """What :func:`_judged` says, of all occurrences of very common anchors, by partial aggregates and a join."""
    firsts = written(met.groupBy("anchor", "digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")), "firsts")
    of_anchor = firsts.groupBy("anchor").agg(F.count("*").alias("_n"), (F.min("first") < F.max("last")).alias("_two"))
    own = F.when(F.col("_two") & (F.col("_n") > 1), F.when(F.col("_n") > GROUP, MANY).otherwise(FEW))
    told = firsts.join(of_anchor, "anchor").select("anchor", "digest", "first", own.alias("_own"))
    fate = F.when(F.col("first") < F.col("doc"), WHOLE).otherwise(F.col("_own")).cast("byte")
    return met.drop("fate").join(told.hint("shuffle_hash"), ["anchor", "digest"]).withColumn("fate", fate).filter("fate IS NOT NULL").select(*(n for n, _ in _FATES))


def transform(frags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard: the bytes of its fragments; keys (the first ``START`` bytes) and places of its suffixes in the order of the
    keys; the fragment of each byte. There is a suffix for each window, ``DEPTH - START`` bytes into it, as an iteration goes
    a byte to the left."""
    size = np.fromiter(map(len, frags), np.int64, len(frags))
    text = np.frombuffer(b"".join(frags), np.uint8)
    begin = np.cumsum(size) - size
    windows = size - DEPTH + 1
    first = np.repeat(begin, windows)
    place = first + np.arange(len(first)) - np.repeat(np.cumsum(windows) - windows, windows) + DEPTH - START
    keys = np.zeros(len(place), np.uint64)
    for k in range(START):
        keys = (keys << np.uint64(8)) | text[place + k]
    order = np.argsort(keys, kind="stable")
    return text, keys[order], place[order], np.repeat(np.arange(len(frags)), size)


def merged(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of :func:`transform` merged: the starts of the repeated windows in their order (places in the shards' joined
    bytes), the number of their interval, and for every place the common prefix of its suffix: the greatest depth at which it
    was in an iteration and shared so many bytes with another suffix there (0: never; a suffix is in the iteration of a depth
    if it ends a window that starts ``DEPTH`` minus so many bytes before it)."""
    text = np.concatenate([s[0] for s in shards])
    offset = np.cumsum([0, *(len(s[0]) for s in shards)])
    keys = np.concatenate([s[1] for s in shards])
    # sorted runs are merged, not sorted anew
    order = np.argsort(keys, kind="stable")
    place = np.concatenate([s[2] + o for s, o in zip(shards, offset, strict=False)])[order]
    block = keys[order]
    common = np.zeros(len(text), np.int8)
    symbol = np.zeros(len(place), np.uint8)
    for depth in range(START, DEPTH + 1):
        border = np.ones(len(place) + 1, bool)
        np.not_equal(block[1:], block[:-1], out=border[1:-1])
        border[1:-1] |= symbol[1:] != symbol[:-1]
        shared = ~(border[:-1] & border[1:])
        place, block = place[shared], np.cumsum(border[:-1])[shared]
        common[place] = depth
        if depth == DEPTH or not len(place):
            break
        place = place - 1
        symbol = text[place]
        order = np.argsort(symbol, kind="stable")
        place, block, symbol = place[order], block[order], symbol[order]
    return place, block, common


def lost(frags: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that occur in a fragment with a smaller ``first``: fragment, first window, number."""
    shards, at, windows = [], 0, 0
    for i, f in enumerate(frags):
        windows += len(f) - DEPTH + 1
        if windows >= SHARD or i + 1 == len(frags):
            shards.append(transform(frags[at : i + 1]))
            at, windows = i + 1, 0
    place, block, _ = merged(shards)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    begin = np.cumsum([0, *map(len, frags)])
    owner = np.repeat(np.arange(len(frags)), np.diff(begin))
    frag = owner[place]
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    least = np.repeat(np.minimum.reduceat(first[frag], heads), np.diff(heads, append=len(place)))
    gone = np.sort(place[least < first[frag]])
    cuts = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(owner[gone], prepend=-1) != 0))
    own = owner[gone[cuts]]
    return own, gone[cuts] - begin[own], np.diff(cuts, append=len(gone))


_LOST = "key long, digest long, at int, n int"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, digest, first, data), sorted by key and digest, to what their fragments lose."""
    numbers: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    data: list[bytes] = []
    size = 0

    def done(upto: int) -> pa.RecordBatch:
        nonlocal numbers, data, size
        key, digest, first = rows = np.concatenate(numbers, axis=1)
        own, at, n = lost(data[:upto], first[:upto])
        numbers, data = [rows[:, upto:]], data[upto:]
        size = sum(map(len, data))
        return pa.record_batch([pa.array(key[own]), pa.array(digest[own]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "digest", "at", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        # rows of one id that hold the same fragment follow each other
        before = numbers[-1][:2, -1:] if numbers[-1].shape[1] else rows[:2, :1] - 1
        new = np.flatnonzero((np.diff(rows[:2], prepend=before, axis=1) != 0).any(0))
        if not len(new):
            continue
        numbers.append(rows[:, new])
        own = pc.take(batch.column(3), pa.array(new)).to_pylist()
        data += own
        size += sum(map(len, own))
        if size >= BATCH:
            # whole groups: up to the last key, whose rows may go on
            key = np.concatenate(numbers, axis=1)[0]
            upto = int(np.searchsorted(key, key[-1]))
            if upto:
                yield done(upto)
    if data:
        yield done(len(data))
    give_back()


def _losses(frags: DataFrame) -> DataFrame:
    """``frags``: (key, digest, first, data). What is lost, by key and digest."""
    parts = int(frags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frags.repartition(parts, "key").sortWithinPartitions("key", "digest").mapInArrow(_merge, _LOST)


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, list of fragments with anchor, digest, at, size, many) to the fragments with their bytes, each once a
    batch."""
    for batch in batches:
        lists = batch.column(2)
        edges = lists.offsets.to_numpy()
        flat = lists.flatten()
        key, digest, at, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "digest", "at", "size"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(edges))
        first = np.sort(np.unique(np.stack([key, digest], 1), axis=0, return_index=True)[1])
        texts = byte_texts(batch.column(1))
        begin, end = at[first].tolist(), (at + size + (DEPTH - 1))[first].tolist()
        own = [texts[r][a:b] for r, a, b in zip(row[first].tolist(), begin, end, strict=True)]
        doc = batch.column(0).to_numpy(zero_copy_only=False)[row[first]]
        yield pa.record_batch([pa.array(key[first]), pa.array(digest[first]), pa.array(doc), flat.field("many").take(pa.array(first)), pa.array(own, pa.binary())], ["key", "digest", "first", "many", "data"])


def _pieces(width: int):
    """Rows (anchor, whole, begin, first, data) to pieces of at most ``width`` windows: (key, digest, first, data, anchor, whole,
    begin). Windows are dealt by their distance to the anchor, and the key tells the bytes that all windows of a deal share."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for anchor, whole, since, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = int(np.flatnonzero(anchors(np.frombuffer(data, np.uint8)).view(np.int64) == anchor)[0])
                windows = len(data) - DEPTH + 1
                for deal in range(max(0, place - windows + 1) // width, place // width + 1):
                    # also at a fragment's edge, where some windows of the deal are missing
                    both = data[place - deal * width : place - deal * width + DEPTH - width + 1]
                    begin, end = max(place - deal * width - width + 1, 0), min(place - deal * width + 1, windows)
                    piece = data[begin : end + DEPTH - 1]
                    values = (np.uint64(xxhash.xxh3_64_intdigest(both, seed=(anchor ^ deal) & 0xFFFFFFFFFFFFFFFF)).view(np.int64), np.uint64(xxhash.xxh3_64_intdigest(piece)).view(np.int64), first, piece, anchor, whole, since + begin)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "digest", "first", "data", "anchor", "whole", "begin"])

    return pieces


def _of_pieces(hot: DataFrame) -> DataFrame | None:
    """What the fragments of very common anchors lose, from their pieces; None if there are no such fragments. Pieces of half a
    fragment tell most of them apart; only groups that are too large still are cut further."""
    hot = written(hot.select(F.col("key").alias("anchor"), F.col("digest").alias("whole"), F.lit(0).alias("begin"), "first", "data"), "hot")
    out = None
    for width in PIECES:
        if hot.isEmpty():
            break
        pieces = written(hot.mapInArrow(_pieces(width), "key long, digest long, first long, data binary, anchor long, whole long, begin int"), "pieces")
        discard(hot)
        once = written(pieces.groupBy("key", "digest").agg(F.min("first").alias("least"), F.min("data").alias("data")), "once")
        sizes = once.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
        many = F.col("_n") > (GROUP if width > PIECES[-1] else LAST)
        judged_ = written(once.join(sizes, "key", "left").withColumn("many", many), "judged")
        runs = _losses(judged_.filter("NOT many").select("key", "digest", F.col("least").alias("first"), "data"))
        met = written(pieces.join(judged_.select("key", "digest", "least", "many"), ["key", "digest"]).filter("first > least OR many IS NOT NULL"), "met")
        discard(pieces, once)
        # a piece whose first document is another's is lost whole
        whole = met.filter(F.col("first") > F.col("least")).select("anchor", "whole", F.col("begin").alias("at"), (F.length("data") - (DEPTH - 1)).alias("n"))
        own = met.filter(F.col("first") <= F.col("least"))
        part = own.filter("NOT many").select("key", "digest", "anchor", "whole", "begin").join(runs.withColumnRenamed("at", "_from"), ["key", "digest"]).select("anchor", "whole", (F.col("begin") + F.col("_from")).alias("at"), "n")
        lost_ = written(whole.unionByName(part).distinct().select(F.col("anchor").alias("key"), F.col("whole").alias("digest"), "at", "n"), "lost")
        out = lost_ if out is None else out.unionByName(lost_)
        hot = written(own.filter("many").select("anchor", "whole", "begin", "first", "data"), "hot")
        discard(met, judged_)
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(doc, check, at, n): runs of windows that a row loses. ``docs``: a scan or a written table (it is read three times)."""
    held = written(judged(docs), "held")
    common = written(_of_common(held.filter(F.col("fate") == OPEN)), "common")
    held = held.filter(F.col("fate") != OPEN).unionByName(common)
    whole = held.filter(F.col("fate") == WHOLE).select("doc", "check", "at", F.col("size").alias("n"))
    wanted = held.filter(F.col("fate") != WHOLE).withColumn("many", F.col("fate") == MANY)
    holders = wanted.groupBy("doc", "check").agg(F.collect_set(F.struct("anchor", "digest", "at", "size", "many")).alias("frags"))
    texts = _keyed(docs).select("doc", "check", "text").join(holders, ["doc", "check"])
    frags = written(texts.select("doc", "text", "frags").mapInArrow(_take, "key long, digest long, first long, many boolean, data binary"), "fragments")
    losses, of_pieces = _losses(frags.filter("NOT many").drop("many")), _of_pieces(frags.filter("many").drop("many"))
    losses = losses if of_pieces is None else losses.unionByName(of_pieces)
    runs = written(losses.withColumnsRenamed({"key": "anchor", "at": "_from"}), "runs")
    part = wanted.select("anchor", "digest", "doc", "check", "at").join(runs, ["anchor", "digest"]).select("doc", "check", (F.col("at") + F.col("_from")).alias("at"), "n")
    return whole.unionByName(part)


def without(text: bytes, at: np.ndarray, n: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, removed runs, and what stays, where the windows of each run (first window, number) go."""
    if not len(at):
        return 0, 0, text
    order = np.argsort(at, kind="stable")
    begin, end = at[order], np.maximum.accumulate((at + n + DEPTH - 1)[order])
    heads = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    begin, end = begin[heads], np.append(end[heads[1:] - 1], end[-1])
    stays = [text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)]
    return int((end - begin).sum()), len(heads), b"".join(stays)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, runs) to the results."""
    for batch in slices(batches, 1):
        out: tuple[list, ...] = ([], [], [], [])
        for text, runs in zip(byte_texts(batch.column(1)), batch.column(2), strict=True):
            pairs = runs.values if runs.is_valid else None
            at, n = (pairs.field(k).to_numpy().astype(np.int64) for k in (0, 1)) if pairs is not None else (np.zeros(0, np.int64),) * 2
            removed, spans, kept = without(text, at, n)
            for column, value in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = removals(docs).groupBy("doc", "check").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    met = _keyed(docs).join(runs, ["doc", "check"], "left").select("doc_id", "text", "runs")
    return met.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: DuckDB over the view ``documents``: every window of every document (its hexadecimal digits, by a 128-bit digest).
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, k, substr(h, 400 * k + 1, 400 + {2 * DEPTH - 2}) AS p FROM (SELECT r, doc_id, h, unnest(range(length(h) // 400 + 1)) AS k FROM d)),
w AS (SELECT r, doc_id, 200 * k + i AS i, md5_number(substr(p, 2 * i - 1, {2 * DEPTH})) AS s FROM (SELECT r, doc_id, k, p, unnest(range(1, least(200, length(p) // 2 - {DEPTH - 1}) + 1)) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS first, max(doc_id) AS last FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
l AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w JOIN f USING (s) WHERE doc_id > first),
g AS (SELECT r, i, sum(CASE WHEN gap <= {DEPTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM l),
s AS (SELECT r, span, min(i) AS a, max(i) + {DEPTH} AS b FROM g GROUP BY r, span),
p AS (SELECT r, h, span, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS since FROM s JOIN d USING (r)),
k AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) - 1) AS kept FROM p GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
