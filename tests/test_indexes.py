"""Stored indexes, readers by place, the positional store and token models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.operators import bm25, dense, models
from quern.operators.corpus import Store
from quern.operators.rerank import rerank
from quern.plans.retrieval import Retriever
from quern.sources import readers


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    """Common words everywhere; rare ones, and repeats of them, in some ranges of positions."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = [f"common{rng.randrange(12)}" for _ in range(rng.randint(5, 40))]
        if i // 50 in (3, 7):
            words += [f"rare{rng.randrange(4)}"] * rng.randint(1, 6)
        rows.append((i, " ".join(words)))
    return spark.createDataFrame([*rows, (600, ""), (601, None)], "idx long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "rare0 common1"), (1, "rare1 rare2 common3 common4"), (2, "common0"), (3, "nowhere"), (4, None)], "query_id long, query string")


def _best(df):
    return sorted((r.query_id, r["rank"], r.idx, round(r.score, 9)) for r in df.collect())


def test_block_max(spark, texts, asked, tmp_path):
    index = bm25.build(texts)
    index.save(f"file://{tmp_path}/sparse", buckets=16, width=50)
    stored = bm25.Index.load(spark, f"file://{tmp_path}/sparse")
    top, counts = bm25.block_max(stored, asked, 5, seeds=2)
    assert _best(top) == _best(bm25.ranked(bm25.scores(index, asked), 5)) == _best(bm25.search(stored, asked, 5))
    decoded = {r.query_id: (r.asked, r.decoded) for r in counts.collect()}
    assert decoded[0][1] < decoded[0][0] / 2 and decoded[1][1] < decoded[1][0] / 2
    assert set(decoded) == {0, 1, 2}
    # all blocks are seeds: one pass, everything decoded
    _, counts = bm25.block_max(stored, asked, 5, seeds=100)
    assert all(r.asked == r.decoded for r in counts.collect())
    assert bm25.search(stored, asked, 700, keep_zero=texts).filter("query_id = 3").count() == 602
    empty = texts.limit(0)
    bm25.build(empty).save(f"file://{tmp_path}/none")
    assert bm25.search(bm25.Index.load(spark, f"file://{tmp_path}/none"), asked, 5).count() == 0


def test_postings_are_pruned_by_bucket(spark, texts, tmp_path):
    bm25.build(texts).save(f"file://{tmp_path}/sparse", buckets=16, width=50)
    stored = bm25.Index.load(spark, f"file://{tmp_path}/sparse")
    one = spark.createDataFrame([(0, "rare0")], "query_id long, query string")
    need, bounds, blocks = bm25._bounds(stored, one)
    filters = _plan(blocks).split("PartitionFilters: ")[1].split("], ")[0]
    assert "bucket" in filters
    read = {r.f for r in blocks.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read) < len(stored.blocks.inputFiles()) / 2


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 6
    points = np.concatenate([c + rng.normal(size=(60, 16)) * 0.2 for c in centres])
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(900, points[0].tolist()), (901, None)], "idx long, embedding array<double>")
    dense.Cells.save(v, f"file://{tmp_path}/cells", per_cell=60)
    cells = dense.Cells.load(spark, f"file://{tmp_path}/cells")
    q = v.filter("idx % 40 = 0").withColumnRenamed("idx", "query_id")
    assert _best(dense.search(cells, q, 7)) == _best(dense.search(v, q, 7))
    matrix = np.array([r.embedding for r in q.filter("embedding IS NOT NULL").collect()])
    _, skipped = dense.bounded_block(cells, matrix, 7, first=1)
    assert skipped > 0.5
    dense.Cells.save(v.limit(0), f"file://{tmp_path}/none")
    assert dense.search(dense.Cells.load(spark, f"file://{tmp_path}/none"), q, 3).count() == 0


def _vector(c):
    return F.array(F.length(c).cast("double"), F.lit(1.0))


def test_manifest(spark, tmp_path):
    data = f"file://{tmp_path}/docs"
    write = lambda rows: spark.createDataFrame(rows, "idx long, text string").coalesce(1).write.mode("overwrite").parquet(data)
    best = lambda r: [x.idx for x in bm25.search(r.index, ask, 1).collect()]
    ask = spark.createDataFrame([(0, "needle")], "query_id long, query string")
    write([(0, "hay hay"), (1, "needle in hay")])
    over = lambda **how: Retriever.over(spark.read.parquet(data), embed=_vector, path=f"file://{tmp_path}/indexes", **how)
    assert best(over()) == [1]
    built = spark.read.parquet(f"file://{tmp_path}/indexes/sparse/manifest").inputFiles()
    assert best(over()) == [1] and spark.read.parquet(f"file://{tmp_path}/indexes/sparse/manifest").inputFiles() == built
    assert over(config=Config(bm25_b=0.5)).index.stats.first().b == 0.5
    write([(7, "a needle"), (8, "hay")])
    again = over()
    assert best(again) == [7] and again.vectors.vectors.count() == 2


def test_places_of_rows(spark, tmp_path):
    """Spark packs larger files first: the last row by file and place counts all the same."""
    long = " ".join(["nội dung"] * 40)
    at = f"{tmp_path}/meta.parquet"
    big = [(i, f"old {i}", "Công văn", "x" * 2000) for i in range(300)]
    for name, rows in (("0", [(2, "first", "Luật", "")]), ("1", big), ("2", [(5, "new 5", "Luật", ""), (5, "newest 5", "Luật", "")])):
        spark.createDataFrame(rows, "id int, title string, legal_type string, pad string").coalesce(1).write.parquet(f"{at}/{name}")
    body = f"{tmp_path}/body.parquet"
    spark.createDataFrame([(str(i), f"Điều 1. {long}") for i in (2, 5)], "id string, content string").coalesce(1).write.parquet(f"{body}/0")
    rows = readers.load_source(spark, "vohuutridung", {"content": f"{body}/*", "metadata": f"{at}/*"}).collect()
    # of document 2 the last row has a type that is not kept
    assert [(r.doc_id, r.title.split(" - ")[0]) for r in rows] == [("tvpl_5", "newest 5")]
    numbers = readers.numbered(readers.read(spark, f"{at}/*")).orderBy(readers.NUMBER).select("id", readers.NUMBER).collect()
    assert [r[1] for r in numbers] == list(range(1, 304)) and [r.id for r in numbers[:2]] == [2, 0] and numbers[-1].id == 5
    lines = f"{tmp_path}/lines.json"
    spark.range(20).select(F.col("id").cast("string").alias("item_id"), F.lit(long).alias("answer")).coalesce(1).write.json(lines)
    assert [r.doc_id for r in readers.load_source(spark, "pbgdpl", {"items": lines}, 3).orderBy("seq").collect()] == ["pbgdpl_0", "pbgdpl_1", "pbgdpl_2"]


def test_source_plan(spark, tmp_path):
    """HTML documents without articles stay, codes of pretraining documents are not completed, and they are not cut."""
    long = " ".join(["nội dung"] * 300)
    at = lambda name: f"{tmp_path}/{name}.parquet"
    spark.createDataFrame([("1", f"<p>{long}</p>")], "id string, content_html string").write.parquet(at("html"))
    spark.createDataFrame([(1, "Luật 5/2020/QH14", "")], "id int, title string, so_ky_hieu string").write.parquet(at("meta"))
    text = f"Điều 1. {long} Điều 2. {long}"
    spark.createDataFrame([(text, ("Luật 6/2020/QH14", "9", ""))], "doc_content string, metadata struct<DocName:string,Id:string,OrganName:string>").write.parquet(at("kc"))
    spark.createDataFrame([("1", "Luật 7/2020/QH14", text)], "id string, title string, content string").write.parquet(at("uts"))
    paths = {"th1nhng0": {"content": at("html"), "metadata": at("meta")}, "kiencute": {"documents": at("kc")}, "utslvc": {"documents": at("uts")}}
    path = f"file://{tmp_path}/corpus"
    rows = readers.load_corpus(spark, path, paths).orderBy("idx").collect()
    assert [(r.source, r.so_ky_hieu, r.article_id) for r in rows] == [("th1nhng0", "5/2020/QH14", ""), ("utslvc", "7/2020/QH14", "1"), ("utslvc", "7/2020/QH14", "2"), ("kiencute", "", "")]
    spark.createDataFrame([("1", "Luật 8/2020/QH14", text)], "id string, title string, content string").write.mode("overwrite").parquet(at("uts"))
    assert {r.so_ky_hieu for r in readers.load_corpus(spark, path, paths).filter("source = 'utslvc'").collect()} == {"8/2020/QH14"}  # other files
    assert readers.load_corpus(spark, path).count() == 4


def test_store(spark, tmp_path):
    store = Store.save(spark.range(250).select(F.col("id").alias("idx"), F.col("id").cast("string").alias("text")), f"file://{tmp_path}/store", width=60)
    ids = lambda df: [r.idx for r in df.orderBy("idx").collect()]
    assert len(store) == 250 and ids(store[-1]) == [249] and ids(store[[3, 3, -250]]) == [0, 3]
    assert ids(store[100:130:7]) == list(range(100, 130, 7)) and ids(store[-3:]) == [247, 248, 249] and ids(store[9:2:-3]) == [3, 6, 9] and ids(store[400:]) == []
    assert [r.idx for r in store] == list(range(250))
    with pytest.raises(IndexError):
        store[250]
    plan = _plan(store[61])
    assert "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [_range" in plan
    assert len({r.f for r in store[61].select(F.input_file_name().alias("f")).collect()}) == 1


def test_token_models(spark):
    calls = []

    def tokens(texts):
        return [[len(w) for w in x.split()] for x in texts]

    def states(ids, mask):
        calls.append(ids.shape)
        sums = np.cumsum(ids * mask, axis=1).astype(float)
        return np.where(mask[:, :, None] == 1, np.stack([sums, np.ones_like(sums)], axis=2), np.nan if False else -99.0)

    texts = ["a bb", "", "ccc " * 30, "dddd", "a " * 600]
    want = []
    for x in texts:
        ids = [len(w) for w in x.split()][:512]
        v = np.array([sum(ids), 1.0]) if ids else np.zeros(2)
        want.append(v / (np.linalg.norm(v) or 1))
    for left in (False, True):
        got = models.embedded(texts, models.TokenModel(tokens, states, 512, left), most=64)
        assert np.allclose(got, want)
    assert all(a * b <= 64 or a == 1 for a, b in calls) and any(a > 1 for a, b in calls)
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "embedding_ long, text string")
    rows = models.embed_texts(df, "text", models.TokenModel(tokens, states)).orderBy("embedding_").collect()
    assert np.allclose([r.embedding for r in rows], [*want, [0, 0]])
    assert models.embed_texts(df.limit(0), "text", models.TokenModel(tokens, states)).count() == 0


def test_pair_scores(spark):
    pair = models.PairModel(lambda pairs: [[len(q), *map(len, c.split())] for q, c in pairs], lambda ids, mask: (ids * mask).sum(1) / 10.0 - 1)
    rows = [(1, "q", "a bb", 1), (1, "q", "dddddd eeeee", 2), (1, "q", None, 3), (2, "only", "x", 1)]
    df = spark.createDataFrame([(q, r, "", "t", c, 0.5, a) for q, a, c, r in rows], "query_id int, rank long, article_id string, doc_title string, content string, score double, query string")
    assert [r.logit for r in models.score_pairs(df, pair).orderBy("query_id", "rank").collect()] == pytest.approx([-0.6, 0.2, -0.9, -0.5])
    best = rerank(df, 2, pair).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.content) for r in best] == [(1, 1, "dddddd eeeee"), (1, 2, "a bb"), (2, 1, "x")] and best[0].score == 1.0


def test_exact_sum_has_no_order(spark):
    parts = [0.1, 7.3, 1e-9, 2.7, 0.30000000000000004, 11.1, 0.0]
    rows = [(g, float(x)) for g, order in enumerate((parts, parts[::-1], sorted(parts))) for x in order]
    got = {r.s for r in spark.createDataFrame(rows, "g int, x double").coalesce(1).groupBy("g").agg(bm25.exact_sum(F.col("x")).alias("s")).collect()}
    assert len(got) == 1 and abs(got.pop() - math.fsum(parts)) < 1e-14
