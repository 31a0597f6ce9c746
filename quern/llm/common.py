"""What the training-data operators share: places for cut lineage, folds, batches of whole texts, words.

Definitions used throughout:
* a *word* is a run of bytes other than ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` splits on exactly those;
* lower-casing touches A-Z only, which is what ``bytes.lower()`` does;
* a null text counts as the empty text, a null id as the empty id text.
"""

from __future__ import annotations

import ctypes
import io
import json
import os
import tempfile
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import discard, shared_dir, written

__all__ = ["byte_texts", "by_shard", "coded", "ddl", "discard", "fold", "fresh", "load", "load_whole", "per_doc", "save", "save_whole", "shared_dir", "slices", "tokenised", "written"]

#: ASCII white space, the only separators of words.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python worker handles at once; a longer text is handled alone, and whole.
SLICE_BYTES = 2 << 20


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores as long as it clashes with one of ``taken``."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def ddl(df: DataFrame) -> str:
    """The schema as text, for functions that add columns to it."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % modulus


def give_back() -> None:
    """Returns freed memory to the system: a worker process stays for later stages, beside other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of column ``text``, or one row."""
    yield from _cut(batches, text, most)
    give_back()


def _cut(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows + 1, np.int64)
        lengths = pc.binary_length(batch.column(text)).fill_null(0)
        np.cumsum(lengths.to_numpy(zero_copy_only=False), out=size[1:])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def byte_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def tokenised(texts: list[bytes], pattern) -> list[list[bytes]]:
    """The pattern's tokens of each text; equal tokens are one object, so that a sample's lists stay small."""
    pool: dict[bytes, bytes] = {}
    return [[pool.setdefault(w, w) for w in pattern.findall(t)] for t in texts]


def coded(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, a code for each occurrence, and where each document's occurrences start (and the end)."""
    words = [w for d in docs for w in d]
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    return list(known), codes, starts


def per_doc(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's occurrences; 0 for a document without any."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def opened(uri: str):
    """The file system of a folder (None: files of this machine's tree) and the path in it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return (None if isinstance(system, fs.LocalFileSystem) else system), path


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One ``.npy`` file an array, whole or not at all: a retried task writes the same bytes again."""
    system, path = opened(folder)
    for key, a in arrays.items():
        out = io.BytesIO()
        np.save(out, a)
        if system is None:
            os.makedirs(path, exist_ok=True)
            handle, part = tempfile.mkstemp(dir=path)
            with os.fdopen(handle, "wb") as f:
                f.write(out.getbuffer())
            os.replace(part, f"{path}/{name}.{key}.npy")
        else:
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{name}.{key}.npy") as f:
                f.write(out.getbuffer())


#: Bytes of arrays that a worker holds of a store which can't be mapped into memory.
HELD = 256 << 20
_held: OrderedDict[str, np.ndarray] = OrderedDict()


def load(folder: str, name: str, key: str) -> np.ndarray:
    """An array of :func:`save`, mapped into memory; from a store that is no file system it is read, and the arrays that
    were asked for longest ago go."""
    system, path = opened(folder)
    file = f"{path}/{name}.{key}.npy"
    if system is None:
        return np.load(file, mmap_mode="r")
    where = f"{folder}/{name}.{key}"
    if where not in _held:
        with system.open_input_stream(file) as f:
            _held[where] = np.load(io.BytesIO(f.read()))
        while len(_held) > 1 and sum(a.nbytes for a in _held.values()) > HELD:
            _held.popitem(last=False)
    _held.move_to_end(where)
    return _held[where]


def save_whole(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """The arrays in one file, each at an offset that a header tells: a shard is one file to list, to open and to map."""
    head, at, parts = {}, 0, []
    for key, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[key] = (a.dtype.str, a.shape, at)
        parts.append(a.tobytes() + bytes(-a.nbytes % 16))
        at += len(parts[-1])
    told = json.dumps(head).encode()
    told += b" " * (-len(told) % 16)
    save(folder, name, {"whole": np.frombuffer(len(told).to_bytes(16, "little") + told + b"".join(parts), np.uint8)})


def load_whole(folder: str, name: str) -> dict[str, np.ndarray]:
    """Views of the arrays of :func:`save_whole`; what is not asked for again is not kept."""
    data = load(folder, name, "whole")
    size = int.from_bytes(data[:16].tobytes(), "little")
    head, body = json.loads(data[16 : 16 + size].tobytes()), data[16 + size :]
    return {key: body[at : at + int(np.prod(shape)) * np.dtype(kind).itemsize].view(kind).reshape(shape) for key, (kind, shape, at) in head.items()}


def held_bytes() -> int:
    """Bytes of arrays that this worker holds of a store which can't be mapped."""
    return sum(a.nbytes for a in _held.values())


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with the places where it does, in order; the work doesn't grow with the number of shards."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0, [True]])) if len(shard) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(shard[order[a]]), order[a:b]
