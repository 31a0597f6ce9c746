import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import mixing, near_dedup, packing, quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls in every column, empty and long texts, repeated rows and ids, equal texts, extra columns
    whose names clash with those that stages use; and its documents."""
    rng = random.Random(17)
    prose = lambda n: " ".join(rng.choice(["the", "house", "of", "green", "river", "and", "old", "stone"]) + str(rng.randrange(40)) for _ in range(n))
    common = "A common LINE of all"
    texts = [f"{prose(60)}\n{common}\n{prose(30)}" for _ in range(14)] + [prose(80) for _ in range(10)]
    texts += [texts[20], texts[20] + " more", None, "", " \n ", "word", prose(6000), "#### $$$$ %%%% " * 40]
    rows = [(i, x, ("en", "de", "fr", "es")[i % 4], "s", len(x or "")) for i, x in enumerate(texts)]
    rows += [rows[3], rows[3], (5, prose(50), "en", None, None), (None, prose(50), None, None, None), (90, None, None, None, None)]
    at = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(7).alias(c) for c in ("_key", "_hash", "_score", "_times", "_id", "_cut", "rate", "id", "length")))
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(24)] + [(None, 1, None), (3, None, 1), (31, 0, 0), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_on_odd_input(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    # quality: every row is judged by its own text
    model = quality.trained(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    scores = model.scores([quality.TOKEN.findall((x or "").encode()) for _, x in texts], model.codes())
    after = corpus_pipeline.good_quality(spark, docs, odd)
    assert after.columns == docs.columns and key(after) == Counter(x for x, s in zip(texts, scores, strict=True) if s >= 0.3)
    # line dedup: counts of rows by plain Python
    seen = Counter(k for _, x in texts for k in {y.strip(" \t\n\x0b\x0c\r").lower() for y in (x or "").split("\n")})
    keep = lambda y: not (k := y.strip(" \t\n\x0b\x0c\r").lower()) or seen[k] < 10
    after = corpus_pipeline.common_lines(spark, docs, odd)
    assert after.columns == docs.columns
    assert key(after) == Counter((i, x and "\n".join(filter(keep, x.split("\n"))) if x else x) for i, x in texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())
    # near dedup: all pairs by plain Python
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((x or "").lower().split() for _, x in texts)]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for a, sa in enumerate(sets):
            for b, sb in enumerate(sets):
                if sa and sb and 10 * len(sa & sb) >= 8 * len(sa | sb):
                    root[a] = root[b] = min(root[a], root[b])
    first = {r: min((texts[i][0] for i in range(len(texts)) if root[i] == r and texts[i][0] is not None), default=None) for r in set(root)}
    want = Counter(x for k, x in enumerate(texts) if x[0] is None or x[0] == first[root[k]] or not sets[k])
    after = corpus_pipeline.near_copies(spark, docs, odd)
    assert after.columns == docs.columns and key(after) == want
    # mixing: every row as often as its document's rate says
    covered = docs.filter("doc_id < 24 OR doc_id = 31").select(F.col("doc_id").alias("_id"), F.col("lang").alias("domain"))
    times = {r._id: r.n for r in mixing.rates(docs, covered, queries.TARGETS, least=1.0).select("_id", mixing.copies(F.col("rate"), F.col("_id")).alias("n")).collect()}
    after = corpus_pipeline.target_weights(spark, docs, odd)
    assert after.columns == docs.columns
    assert key(after) == Counter({x: n * (1 if x[0] is None else times[x[0]]) for x, n in Counter(texts).items()})
    # packing: gapless sequences of all pieces
    packed = corpus_pipeline.sequences(spark, docs, odd).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == Counter(tuple(r) for r in packing.pieces(docs).select("doc_id", "piece", "length", "ids_crc32").collect())
    ends: dict[int, int] = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY


def test_stages_on_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).persist()
        kept[name] = after.count()
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        if name == "near_dedup":
            assert near_dedup.report(after).filter("NOT kept").count() == 0
        if name == "mixing":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after if name != "packing" else before
    assert kept["line_dedup"] == kept["quality"] and kept["near_dedup"] < kept["line_dedup"]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == kept["packing"] == packing.pieces(before).count()


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
