"""Operator 2, media columns: chroma audio fingerprints and their alignment.

Audio becomes frames of the energy of the twelve pitch classes, in whole numbers. Sixteen filters - differences of
rectangle sums over a window of ``WINDOW`` frames and some pitch classes, read from an integral image - are quantised to
two bits each (Gray code) and packed into one 32-bit integer a frame position. Many recordings are laid end to end and
handled at once; sums of whole numbers are exact, so a recording's integers don't depend on its neighbours. Equal
sequences form a class.

Recordings align where they share integers: for a pair, the differences of the positions of equal integers make a
histogram; at its highest offset the share of differing bits over the overlap decides. A stated set of queries meets all
recordings in blocks: a block of query classes of bounded size goes to the workers, which scan all classes and return
sums and minima, never pairs.
"""

from __future__ import annotations

import io
import math
import struct
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_shard, written

RATE, FRAME, HOP, WINDOW = 8000, 512, 256, 16
#: Alignment: at least so many equal integers at the offset, at most so many differing bits, at least so much overlap.
VOTES, BIT_ERROR, OVERLAP = 2, 0.2, 8
#: Integers of queries in a block: a bound on what is sent to the workers at once.
BLOCK = 2_000_000


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters, spread by rule over the window."""
    return [(k % 6, (5 * k) % (12 - h + 1), h, w) for k in range(16) for h, w in [(2 + (3 * k) % 9, WINDOW - (5 * k) % 9)]]


FILTERS = _filters()
#: Limits of a filter's ratio between its four values.
LIMITS = tuple(math.exp(x) for x in (-0.35, 0.0, 0.35))
#: Whole numbers in one unit of a pitch class; frames that are transformed at once; samples of recordings laid end to end.
SCALE, FRAMES, TOGETHER = 1 << 16, 4096, 1 << 21
#: Pairs of equal integers that are listed at once.
PAIRS = 1 << 20
GRAY = np.array([0, 1, 3, 2], np.uint32)


def wav_samples(data: bytes) -> np.ndarray:
    """Mono samples of a PCM WAV file of 8, 16, 24 or 32 bits (channels are averaged), resampled to ``RATE`` by linear
    interpolation. ValueError says what is wrong with other data."""
    if not data:
        raise ValueError("no data")
    try:
        with wave.open(io.BytesIO(data)) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError, struct.error) as e:
        raise ValueError(f"no WAV file: {e}" if str(e) else "a WAV file that ends too soon") from e
    if width not in (1, 2, 3, 4) or not channels or not rate:
        raise ValueError(f"{8 * width} bits, {channels} channels, rate {rate}")
    whole = np.frombuffer(raw, np.uint8)[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:  # unsigned
        x = (whole[:, 0].astype(np.float64) - 128) / 128
    else:
        wide = np.zeros((len(whole), 4), np.uint8)
        wide[:, 4 - width :] = whole
        x = wide.view("<i4")[:, 0] / 2.0**31
    x = x.reshape(-1, channels).mean(1) if len(x) else x
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x.astype(np.float32)


_TONES = np.sin(2 * np.pi * (440 * 2 ** (np.arange(36) / 12))[:, None] * np.arange(HOP) / RATE).astype(np.float32)


def rendered_samples(text: str) -> np.ndarray:
    """A stand-in recording of a text, where a table has no audio: each word sounds as one of 36 tones."""
    words = text.encode().lower().split()
    return _TONES[np.fromiter((zlib.crc32(w) % 36 for w in words), np.int64, len(words))].ravel()


def _pitch_map() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if 400 <= f <= 3700:
            out[i, round(12 * np.log2(f / 440)) % 12] = 1
    return out


_PITCH, _HANN = _pitch_map(), np.hanning(FRAME).astype(np.float32)


def _frames(samples: np.ndarray) -> int:
    return max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1) if len(samples) else 0


def chroma(recordings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of twelve pitch classes in whole numbers, smoothed over five frames; for each recording its first row and its
    number of rows: its frames (each of unit length before smoothing, or zero), and zero rows up to ``WINDOW``."""
    n = np.array([_frames(x) for x in recordings], np.int64)
    rows = np.where(n > 0, np.maximum(n, WINDOW), 0)
    first = 2 + np.concatenate([[0], np.cumsum(rows + 2)[:-1]]).astype(np.int64)  # two zero rows between recordings
    signal = np.zeros(int((np.maximum(n - 1, 0) * HOP + FRAME).sum()) + FRAME, np.float32)
    at, starts = 0, []
    for x, k in zip(recordings, n.tolist(), strict=True):
        signal[at : at + len(x)] = x
        starts.append(at + HOP * np.arange(k))
        at += max(k - 1, 0) * HOP + FRAME
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(start))
    out = np.zeros((int((rows + 2).sum()) + 4, 12))
    windows = np.lib.stride_tricks.sliding_window_view(signal, FRAME)
    for k in range(0, len(start), FRAMES):
        spectrum = np.fft.rfft(windows[start[k : k + FRAMES]] * _HANN)
        energy = (spectrum.real**2 + spectrum.imag**2).astype(np.float64) @ _PITCH
        size = np.linalg.norm(energy, axis=1, keepdims=True)
        out[place[k : k + FRAMES]] = np.where(size > 1e-6, energy / np.maximum(size, 1e-6), 0)
    smooth = np.zeros_like(out)
    for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)):
        smooth[2:-2] += w * out[k : len(out) - 4 + k]
    own = np.zeros(len(out), bool)
    own[place] = True
    smooth[~own] = 0
    return np.rint(smooth * SCALE).astype(np.int64), first, rows


def fingerprints(recordings: list[np.ndarray]) -> list[np.ndarray]:
    """For each recording a 32-bit integer for each window; a recording shorter than one window is padded to one, one of no
    length has none."""
    c, first, rows = chroma(recordings)
    image = np.zeros((len(c) + 1, 13), np.int64)
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    n = max(0, len(c) - WINDOW + 1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        column = image[:, p1] - image[:, p0]
        return column[t1 : t1 + n] - column[t0 : t0 + n]

    out = np.zeros(n, np.uint32)
    for k, (kind, p, h, w) in enumerate(FILTERS):
        whole, t2, p2, t3, p3 = area(0, w, p, p + h), w // 2, h // 2, w // 3, max(1, h // 3)
        part = {
            0: lambda: whole / 2 + area(0, w, 0, 12) / 24 * h,
            1: lambda: area(0, w, p + p2, p + h),
            2: lambda: area(t2, w, p, p + h),
            3: lambda: area(0, t2, p, p + p2) + area(t2, w, p + p2, p + h),
            4: lambda: area(0, w, p + p3, p + max(2 * p3, p3 + 1)),
            5: lambda: area(t3, 2 * t3, p, p + h),
        }[kind]()
        # kinds 4 and 5 weigh one third against two
        a, b = (2 * part, whole - part) if kind > 3 else (part, whole / 2 if kind == 0 else whole - part)
        a, b = SCALE + np.maximum(a, 0), SCALE + np.maximum(b, 0)
        out |= GRAY[sum((a > limit * b).astype(np.int64) for limit in LIMITS)] << np.uint32(2 * k)
    return [out[f : f + r - WINDOW + 1] if r else out[:0] for f, r in zip(first.tolist(), rows.tolist(), strict=True)]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    return fingerprints([samples])[0]


def _together(recordings: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Parts of the list, of about ``TOGETHER`` samples; a longer recording is alone."""
    part, size = [], 0
    for x in recordings:
        if part and size + len(x) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x) + FRAME
    if part:
        yield part


def _fingerprint(decode: Callable):
    nothing = np.zeros(0, np.float32)

    def decoded(x) -> tuple[np.ndarray, str | None]:
        if x is None:
            return nothing, "null"
        try:
            samples = decode(x)
        except ValueError as e:
            return nothing, str(e)
        return samples, None if len(samples) else "no samples"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [decoded(x) for x in part.column(part.num_columns - 1).to_pylist()]
                prints = [p.astype("<u4").tobytes() for some in _together([x for x, _ in found]) for p in fingerprints(some)]
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, prints)), "<i8").reshape(-1, 2)
                yield pa.record_batch([*part.columns[:-1], pa.array(prints, pa.binary()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([r for _, r in found], pa.string())], [*part.schema.names[:-1], "print", "d0", "d1", "reason"])

    return run


def fingerprinted(table: DataFrame, ids: list[str], media_col: str, decode: Callable = wav_samples) -> DataFrame:
    """The ids, ``print`` (little-endian 32-bit integers), its digest d0, d1, and ``reason``: why the print is empty (null or
    empty media, or data that ``decode`` refuses with a ValueError), else null. No row is lost."""
    own = table.select(*ids, F.col(media_col).alias("_media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(_fingerprint(decode), f"{schema}, print binary, d0 long, d1 long, reason string")


def aligned(query: np.ndarray, other: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits and length of the overlap, if ``other`` starts ``offset`` windows before ``query``."""
    a, b = (query, other[offset:]) if offset >= 0 else (query[-offset:], other)
    n = min(len(a), len(b))
    return (float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n), n) if n else (1.0, 0)


class Block:
    """Query classes that meet every other class."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.prints = [np.frombuffer(p, "<u4") for _, p in rows]
        self.names = [r[0] for r in rows]
        values = np.concatenate(self.prints)
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in self.prints])
        place = np.concatenate([np.arange(len(p)) for p in self.prints])
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.place = values[order], owner[order], place[order]

    def _votes(self, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, offsets, votes) in parts. Pairs of equal integers are listed ``PAIRS`` at a time; where a recording and a
        query hold one integer very often, the histogram of its offsets is a product of transforms instead."""
        value, first, back, times = np.unique(other, return_index=True, return_inverse=True, return_counts=True)
        low, high = np.searchsorted(self.values, value, "left"), np.searchsorted(self.values, value, "right")
        often = (high - low) * times > 8 * (high - low + times) + PAIRS // 16
        for v in np.flatnonzero(often).tolist():
            here = np.zeros(len(other))
            here[back == v] = 1
            owner, place = self.owner[low[v] : high[v]], self.place[low[v] : high[v]]
            for q, own in by_shard(owner):
                there = np.zeros(len(self.prints[q]))
                there[place[own]] = 1
                size = 1 << (len(here) + len(there) - 1).bit_length()
                both = np.rint(np.fft.irfft(np.fft.rfft(here, size) * np.fft.rfft(there[::-1], size), size)[: len(here) + len(there) - 1]).astype(np.int64)
                some = np.flatnonzero(both)
                yield np.full(len(some), q), some - (len(there) - 1), both[some]
        at = np.flatnonzero(~often[back])
        many = (high - low)[back[at]]
        upto = np.cumsum(many)
        while len(at):
            k = max(1, int(np.searchsorted(upto, PAIRS + (upto[0] - many[0]), "right")))
            m, starts = many[:k], low[back[at[:k]]]
            total = int(m.sum())
            if total:
                hit = np.repeat(starts - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(total)
                pair, votes = np.unique(np.stack([self.owner[hit], np.repeat(at[:k], m) - self.place[hit]]), axis=1, return_counts=True)
                yield pair[0], pair[1], votes
            at, many, upto = at[k:], many[k:], upto[k:]

    def matches(self, other: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(query, offset, bit error) of the queries that align with ``other``, each at its best offset."""
        parts = list(self._votes(other))
        if not parts:
            return
        owner, offset, votes = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((offset, owner))
        owner, offset, votes = owner[order], offset[order], votes[order]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(offset) != 0)]))
        owner, offset, votes = owner[heads], offset[heads], np.add.reduceat(votes, heads)
        order = np.lexsort((np.abs(offset), -votes, owner))
        for k in order[np.concatenate([[True], np.diff(owner[order]) != 0])]:
            q = self.prints[owner[k]]
            shorter = min(len(q), len(other))
            if votes[k] >= min(VOTES, shorter):
                error, n = aligned(q, other, int(offset[k]))
                if error <= BIT_ERROR and n >= min(OVERLAP, shorter):
                    yield int(owner[k]), int(offset[k]), error


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(held.value)
        links: dict[int, list] = {}
        for batch in batches:
            for name, print_, size in zip(*(batch.column(c).to_pylist() for c in ("name", "print", "size")), strict=True):
                for q, offset, error in block.matches(np.frombuffer(print_, "<u4")):
                    if block.names[q] != name:
                        best = links.setdefault(q, [0, (2.0, 0, 0)])
                        best[0] += size
                        best[1] = min(best[1], (error, name, offset))
        rows = sorted(links.items())
        yield pa.record_batch([pa.array([block.names[q] for q, _ in rows], pa.int64()), pa.array([b[0] for _, b in rows], pa.int64()), pa.array([b[1][0] for _, b in rows], pa.float64()), pa.array([b[1][1] for _, b in rows], pa.int64()), pa.array([b[1][2] for _, b in rows], pa.int64())], ["query", "links", "error", "other", "offset"])

    return run


def search(prints: DataFrame, ids: list[str], is_query) -> DataFrame:
    """Per query row: its ids, n_prints, class_size (recordings of equal fingerprints, itself included), n_links
    (recordings of other classes that align), and of the best of them the ids, the offset and the bit error.

    Recordings without any integer (null or empty media) align with nothing and have class size 1. Ties go to the lower
    class, whose ids are the smallest of its recordings. Repeated rows count as recordings of their own. An empty table
    gives an empty table.
    """
    spark = prints.sparkSession
    known = written(prints, "prints")
    some = known.filter(F.length("print") > 0)
    named = some.groupBy("d0", "d1").agg(F.min(F.struct(*ids)).alias("first"), F.first("print").alias("print"), F.count("*").alias("size"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked"))
    # a class is named by a hash of its digest, so that names hold over recomputation
    classes = written(named.withColumn("name", F.xxhash64("d0", "d1")), "classes")
    asked = classes.filter("asked").select("name", F.length("print").alias("n")).orderBy("name")
    blocks: list[list[int]] = []  # ranges of names
    room = 0
    for r in asked.toLocalIterator():
        if r.n // 4 > room or not blocks:
            blocks.append([r.name, r.name])
            room = BLOCK
        blocks[-1][1] = r.name
        room -= r.n // 4
    found = None
    for low, high in blocks:
        rows = classes.filter(F.col("asked") & F.col("name").between(low, high)).select("name", "print").collect()
        held = spark.sparkContext.broadcast([(r.name, bytes(r.print)) for r in rows])
        part = classes.select("name", "print", "size").mapInArrow(_search(held), "query long, links long, error double, other long, offset long")
        got = written(part.groupBy("query").agg(F.sum("links").alias("n_links"), F.min(F.struct("error", "other", "offset")).alias("best")), "found")
        found = got if found is None else found.unionByName(got)
    own = known.filter(is_query).join(classes.select("d0", "d1", "name", "size"), ["d0", "d1"], "left")
    if found is None:
        found = spark.createDataFrame([], "query long, n_links long, best struct<error:double,other:long,offset:long>")
    other = classes.select(F.col("name").alias("_other"), F.col("first").alias("_first"))
    out = own.join(found, F.col("name") == F.col("query"), "left").join(other, F.col("best.other") == F.col("_other"), "left")
    best = [F.col(f"_first.{c}").alias(f"best_{c}") for c in ids]
    return out.select(*ids, (F.length("print") / 4).cast("int").alias("n_prints"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *best, F.col("best.offset").alias("best_offset"), F.col("best.error").alias("best_bit_error"))


def report(conversations: DataFrame) -> DataFrame:
    """Turns as recordings (rendered, as the tables have no audio): every turn of the conversations whose id is divisible
    by 100 against all turns."""
    prints = fingerprinted(conversations, ["conv_id", "turn"], "text", rendered_samples)
    return search(prints, ["conv_id", "turn"], F.col("conv_id") % 100 == 0)
