import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.operators import answer, bm25, corpus, dense, extract, fusion, lawmatch, metrics, rerank
from quern.schema import conform
from quern.sources import readers


def cell(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_sections(spark):
    got = cell(spark, "Điều 1. Phạm vi áp dụng. Luật này quy định. Điều 2. Đối tượng.", extract.sections)
    assert [tuple(r) for r in got] == [("Điều 1.", "1", "Phạm vi áp dụng. Luật này quy định."), ("Điều 2.", "2", "Đối tượng.")]
    got = cell(spark, "Theo Điều 5 của Luật này. Hết.", extract.sections)
    assert [tuple(r) for r in got] == [("", "", "Theo"), ("Điều 5 của Luật này.", "5", "Hết.")]
    assert [tuple(r) for r in cell(spark, "", extract.sections)] == [("", "", "")]


def test_articles(spark):
    rows = lambda c: extract.articles(c, F.lit("T"), F.lit("9/QĐ-X"))
    got = cell(spark, "MỞ ĐẦU\nĐiều 1. Phạm vi áp dụng luật\nĐiều 2: Đối tượng áp dụng", rows)
    assert [(r.text, r.title, r.article_title, r.article_id, r.hierarchy) for r in got] == [("Điều 1. Phạm vi áp dụng luật", "T - Điều 1", "Phạm vi áp dụng luật", "Điều 1", "9/QĐ-X/1"), ("Điều 2: Đối tượng áp dụng", "T - Điều 2", "Đối tượng áp dụng", "Điều 2", "9/QĐ-X/2")]
    got = cell(spark, "Không có điều nào trong văn bản này", rows)
    assert [(r.article_id, r.hierarchy) for r in got] == [("", "9/QĐ-X")]


def test_windows(spark):
    text = " ".join(f"w{i}" for i in range(1, 11))
    assert [x.split()[0] + ".." + x.split()[-1] for x in cell(spark, text, lambda c: extract.windows(c, 4, 1))] == ["w1..w4", "w4..w7", "w7..w10"]
    assert cell(spark, "a  b", lambda c: extract.windows(c, 4, 1)) == ["a  b"]


def test_first_wins(spark):
    long = " ".join(["từ"] * 40)
    rows = [(1, "A", "Điều 1", "", " ".join(["từ"] * 10)), (2, "A", "1", "", long), (3, "A", "Điều 1", "", long), (4, "", "", "d_art0", long), (5, "", "2", "d_art0", long), (6, "", "", "", long), (7, "", "", "", long)]
    df = conform(spark.createDataFrame(rows, "seq long, so_ky_hieu string, article_id string, chunk_id string, text string"), "seq")
    got = {r.seq: (r.status, r.key) for r in corpus.with_status(df).collect()}
    assert got == {1: ("short", "A||1"), 2: ("kept", "A||1"), 3: ("duplicate", "A||1"), 4: ("kept", "d_art0"), 5: ("duplicate", "d_art0"), 6: ("kept", None), 7: ("kept", None)}


def test_number_rows_and_access(spark):
    df = spark.createDataFrame([(f"{i:05d}",) for i in np.random.default_rng(0).permutation(500)], "k string")
    got = corpus.number_rows(df, ["k"]).orderBy("idx").collect()
    assert [(r.idx, int(r.k)) for r in got] == [(i, i) for i in range(500)]
    numbered = spark.createDataFrame(got)
    assert {r.idx for r in corpus.rows_at(numbered, [0, -1, 7]).collect()} == {0, 499, 7}
    assert [r.k for r in corpus.batch(df, 2, 200, "k").orderBy("k").collect()] == [f"{i:05d}" for i in range(400, 500)]


def test_rank_fusion_and_cut(spark):
    ranked = lambda rows: spark.createDataFrame([(0, i, float(s), r) for r, (i, s) in enumerate(rows, 1)], "query_id long, idx long, score double, rank long")
    got = fusion.fuse([(ranked([(10, 2), (20, 1)]), 0.8), (ranked([(20, 2), (30, 1)]), 0.2)]).orderBy("rank").collect()
    assert [r.idx for r in got] == [20, 10, 30]
    assert got[0].score == pytest.approx(0.8 / 62 + 0.2 / 61)
    assert [r.idx for r in fusion.fuse([(ranked([(1, 1)]), 0.5), (ranked([(2, 1)]), 0.5)]).orderBy("rank").collect()] == [1, 2]
    scores = [1.0, 0.95, 0.9, 0.4, 0.39, 0.38, 0.37, 0.36, 0.35, 0.34, 0.33, 0.32]
    assert fusion.adaptive_cut(ranked(list(enumerate(scores)))).count() == 8
    assert fusion.adaptive_cut(ranked(list(enumerate(scores[:3])))).count() == 3


def test_bm25_keeps_zero(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "beta gamma"), (2, "")], "idx long, text string")
    queries = spark.createDataFrame([(7, "alpha x"), (8, "")], "query_id long, query string")
    index = bm25.build(docs)
    assert [(r.query_id, r.idx) for r in bm25.search(index, queries, 3).collect()] == [(7, 0)]
    got = bm25.search(index, queries, 3, docs).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.idx) for r in got] == [(7, 0), (7, 1), (7, 2), (8, 0), (8, 1), (8, 2)]


def test_dense_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "idx long, embedding array<float>")
    q = df.filter("idx < 5").withColumnRenamed("idx", "query_id")
    got = {}
    for r in dense.search(df, q, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.idx
    s = v.astype(float) @ v[:5].astype(float).T
    for k in range(5):
        assert [got[k][r] for r in (1, 2, 3, 4)] == np.lexsort((np.arange(300), -s[:, k]))[:4].tolist()


def test_rerank_scores(spark):
    rows = [(0, 1, "a", 0.0), (0, 2, "b", 2.0), (0, 3, "c", -2.0), (1, 1, "d", 0.0)]
    df = spark.createDataFrame(rows, "query_id long, rank long, content string, logit double").withColumn("query", F.lit("q")).withColumn("score", F.lit(0.0))
    got = rerank.rerank(df, scorer=lambda q, c: F.col("logit")).collect()
    assert {r.content: round(r.score, 6) for r in got} == {"a": 0.5, "b": 1.0, "c": 0.0, "d": 0.5}
    chosen = lambda placed: placed.select("query_id", "batch").distinct().withColumn("reply", F.lit("3, 1"))
    assert [r.content for r in rerank.rerank_by_choice(df, chosen, 2).filter("query_id = 0").orderBy("rank").collect()] == ["a", "c"]


def test_reconstruct(spark):
    rows = [(0, 1, "T", "1", "a" * 30, 0.9), (0, 2, "T", "2", "b" * 60, 0.8), (0, 3, "T", "1", "c" * 30, 0.7), (0, 4, "U", "", "d", 0.85)]
    df = spark.createDataFrame(rows, "query_id long, rank long, doc_title string, article_id string, content string, score double").withColumns({"chunk_id": F.col("rank").cast("string"), "source": F.lit("hybrid")})
    got = rerank.reconstruct(df).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.content) for r in got] == [("merged_T_1", 0.9, "a" * 30 + "\n" + "c" * 30), ("4", 0.85, "d"), ("merged_T_2", 0.8, "b" * 60)]
    short = rerank.reconstruct(df.filter("rank = 1")).first()
    assert short.content == "a" * 30


def test_answer_parts(spark):
    rows = [(0, 1, "T", "1", "x", 1.0, "C"), (0, 2, "T", "12", "y", 0.5, "C"), (0, 3, "U", "", "z", 0.2, "")]
    df = spark.createDataFrame(rows, "query_id long, rank long, doc_title string, article_id string, content string, score double, so_ky_hieu string")
    said = spark.createDataFrame([(0, "theo điều 12")], "query_id long, answer string")
    assert [r.rank for r in answer.used(df, said).orderBy("rank").collect()] == [1, 2]
    assert [r.rank for r in answer.used(df.filter("rank > 1"), said, strict=True).orderBy("rank").collect()] == [2]
    assert answer.context(df).first().context.startswith("[1] T - Điều 1\nx\n\n[2] T - Điều 12\ny")
    keys = answer.relevant(df).first()
    assert keys.relevant_docs == ["C|T", "|U"] and keys.relevant_articles == ["C|T|Điều 1", "C|T|Điều 12"]
    assert answer.predictions(df).first().predicted_articles == ["C#1", "C#12"]
    assert answer.context_gate(df, 0.9).count() == 3


def test_law_match(spark):
    titles = ["Luật Doanh nghiệp năm 2014", "Luật Doanh nghiệp năm 2020", "Nghị định về doanh nghiệp nhỏ"]
    index = lawmatch.title_index(spark.createDataFrame([(i, x, "") for i, x in enumerate(titles)], "idx long, title string, so_ky_hieu string"))
    names = spark.createDataFrame([(1, "Luật Doanh nghiệp 2020"), (2, "Luật Doanh nghiệp"), (3, "Thông tư Doanh nghiệp")], "name_id int, name string")
    assert {r.name_id: r.title for r in lawmatch.match(names, index).collect()} == {1: titles[1], 2: titles[0], 3: None}


def test_metrics(spark):
    r = lambda rows: spark.createDataFrame(rows, "query_id int, truth array<string>, predicted array<string>")
    two = r([(1, ["a", "b"], ["a", "c"]), (2, ["c"], [])])
    assert {x.query_id: x.f2 for x in metrics.per_query_f2(two).collect()} == {1: 0.5, 2: 0.0}
    assert metrics.per_query_f2(r([(1, ["a", "b"], ["a", "c"])])).first().f2 == pytest.approx(5 / 9)
    k = metrics.at_k(r([(1, ["a", "b"], ["a", "c"])])).first()
    assert (k["recall@5"], k["precision@5"]) == (0.5, 0.2)
    odd = r([(1, ["b"], ["a", "b"]), (2, [], ["a"])])
    assert metrics.mrr(odd).first().mrr == 0.5 and metrics.mrr(odd, bench=True).first().mrr == 0.25


def test_resume(spark):
    queries = spark.createDataFrame([(i,) for i in range(5)], "query_id int")
    done = spark.createDataFrame([(0, [], "timeout"), (1, [], ""), (2, [], "KeyError"), (3, ["x"], None)], "query_id int, predicted array<string>, error string")
    assert sorted(r.query_id for r in metrics.to_run(queries, done).collect()) == [0, 1, 4]


def test_sources(spark):
    df = spark.createDataFrame([("Điều 1.2.LQ.5", "Điều 5. Tên. Rõ", "nội dung dài hơn hai mươi ký tự", "r", "Luật số 45/2019/QH14", "s"), ("Điều 3", "", "ngắn", "r2", "", "s2")], "article_id string, article_title string, content_text string, record_id string, source_note_text string, subject_id string")
    got = readers.phapdien(df).collect()
    assert [(r.article_id, r.so_ky_hieu, r.title, r.doc_id) for r in got] == [("5", "45/2019/QH14", "Luật 45/2019/QH14", "phapdien_s")]
    meta = spark.createDataFrame([(1, "T", "Luật", "9/QĐ-X"), (2, "U", "Công văn", "")], "id int, title string, legal_type string, document_number string")
    body = spark.createDataFrame([("1", "MỞ ĐẦU\nĐiều 1. Phạm vi áp dụng luật\nĐiều 2: Đối tượng áp dụng"), ("2", "Điều 1. Công văn này không được giữ lại đâu")], "id string, content string")
    assert [r.article_id for r in readers.vohuutridung(body, meta).orderBy("seq").collect()] == ["Điều 1", "Điều 2"]
    assert readers.vohuutridung(body, meta, filtered=False).count() == 3
    kc = spark.createDataFrame([("văn bản " * 10, ("Tên", "5", "CQ"))], "doc_content string, metadata struct<DocName:string,Id:string,OrganName:string>")
    assert [(r.doc_id, r.title) for r in readers.kiencute(kc).collect()] == [("kiencute_5", "Tên")]
    qa = spark.createDataFrame([("1", "Hỏi?", "trả lời đủ dài để được giữ lại")], "item_id string, question string, answer string")
    assert readers.pbgdpl(qa).first().title == "Hỏi?"
    built = corpus.build_corpus([readers.vohuutridung(body, meta), readers.pbgdpl(qa)], least_words=3).orderBy("idx").collect()
    assert [(r.idx, r.source) for r in built] == [(0, "vohuutridung"), (1, "vohuutridung"), (2, "pbgdpl")]


def test_fixed_lists():
    assert len(fixed.STOP_WORDS) == 44 and len(fixed.KEPT_TYPES) == 18 and len(fixed.QUERY_PLANS) == 8
