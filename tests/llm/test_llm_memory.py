"""What workers hold of a store that can't be mapped into memory, files of a shard, blocks of copies, long texts."""

import pathlib
import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import common, kneser_ney, line_dedup, mixing, rules


class Store:
    """A file system that is none of this machine's: pyarrow's calls, passed on."""

    def __init__(self):
        from pyarrow import fs

        self.inner = fs.LocalFileSystem()

    def __getattr__(self, name):
        return getattr(self.inner, name)


def remote(monkeypatch, bound):
    monkeypatch.setattr(common, "opened", lambda uri: (Store(), uri.removeprefix("file://")))
    monkeypatch.setattr(common, "HELD", bound)
    common._held.clear()


def test_line_index_on_a_store(spark, monkeypatch, tmp_path):
    """However many shards are asked for, a worker holds no more than the bound, or one shard."""
    rng = np.random.default_rng(3)
    keys = [f"line {i}".encode() for i in range(6000)]
    halves = line_dedup._halves(keys)
    import pandas as pd

    remote(monkeypatch, 20_000)
    shards = np.mod(halves[:, 1].view(np.int64), 12)
    counts = rng.integers(1, 50, len(keys))
    sizes = []
    for k in range(12):
        at = shards == k
        group = pd.DataFrame({"a": halves[at, 0].view(np.int64), "b": halves[at, 1].view(np.int64), "n": counts[at], "shard": k})
        line_dedup._build_shard(str(tmp_path))(group)
        sizes.append((tmp_path / f"lines-{k}.whole.npy").stat().st_size)
    assert len(list(tmp_path.iterdir())) == 12  # a file a shard
    probe = line_dedup.Probe(str(tmp_path), 13)  # the last shard holds no line
    probe.shards = 12
    for a in range(0, len(keys), 500):
        assert np.array_equal(probe.counts(halves[a : a + 500]), counts[a : a + 500])
        assert common.held_bytes() <= max(20_000, max(sizes))
    assert not any(isinstance(v, np.ndarray) for v in vars(probe).values())


def test_language_model_on_a_store(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(kneser_ney, "SHARD_WORDS", 100)
    monkeypatch.setattr(kneser_ney, "SHARD_PAIRS", 300)
    model = kneser_ney.train(docs)
    want = kneser_ney.Scorer(model).score([t.encode() for t in texts])
    remote(monkeypatch, 4000)
    scorer, most = kneser_ney.Scorer(model), 0
    for i, t in enumerate(texts):
        got = scorer.score([t.encode()])
        assert all(np.allclose(g[0], w[i]) for g, w in zip(got, want, strict=True))
        most = max(most, common.held_bytes())
    sizes = [f.stat().st_size for f in pathlib.Path(model["folder"].removeprefix("file://")).glob("*.npy")]
    assert len(model["sizes"]) >= 5 and most <= max(4000, max(sizes)) and sum(sizes) > 8 * most
    assert not hasattr(scorer.words, "hashes")


def test_whole_files(tmp_path):
    arrays = {"a": np.arange(7, dtype=np.uint8), "b": np.zeros((3, 0), np.int64), "c": np.array([[1.5, 2.0]]), "d": np.arange(5, dtype=np.uint32)}
    common.save_whole(str(tmp_path), "x", arrays)
    got = common.load_whole(str(tmp_path), "x")
    assert list(got) == list(arrays) and all(np.array_equal(got[k], a) and got[k].dtype == a.dtype for k, a in arrays.items())


def test_copies_in_blocks(spark, monkeypatch):
    """A row that comes very often is expanded by many tasks; the rows are the same."""
    monkeypatch.setattr(mixing, "COPIES", 100)
    rows = spark.createDataFrame([(1, 1), (2, 100), (3, 101), (4, 2550), (5, 0)], "doc_id long, times int").filter("times > 0")
    got = mixing.expanded(rows, "times", 2550)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 100, 3: 101, 4: 2550}
    parts = got.filter("doc_id = 4").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 1000
    assert mixing.expanded(rows, "times", 50).columns == ["doc_id"]


def test_measures_of_long_texts(monkeypatch):
    """Words listed a block at a time, in texts of many blocks."""
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "bé", "ccc ", "\n", " # ", "\t", "漢字 ", "$$"]) for _ in range(5000)) + " last"
    want = rules.measures(text.encode())
    words = text.encode().split()
    chars = sum(len(w.decode()) for w in words)
    assert want[:3] == (len(words), chars, sum(text.count(c) for c in rules.SYMBOLS))
    for block in (1, 7, 1000):
        monkeypatch.setattr(rules, "BLOCK", block)
        assert rules.measures(text.encode()) == want
    assert rules.measures(b"") == (0, 0, 0, 0, 0) and rules.measures(b" \n ") == (0, 0, 0, 0, 0) and rules.measures(b"x" * 50) == (1, 50, 0, 0, 0)
