import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quern.config import Config
from quern.functions import text as t
from quern.operators import corpus, extract, lawmatch
from quern.operators.dense import hashed_vector
from quern.plans import evaluate, prompts, server
from quern.plans.agent import Engine, Result, RuleModel
from quern.plans.retrieval import Retriever
from quern.plans.service import Service
from quern.schema import conform, order_key
from quern.sources import readers
from quern.storage import complete, discard, shared_dir, written


def test_structured_references(spark):
    rows = ["Điều 5 Khoản 2 và Điều 7", "Khoản 3 Điều 9", "Điều 9, Khoản 3", "Điều 5 Khoản 2 nói; Điều 5 Khoản 2 lại nói về một việc khác nữa, theo Khoản 3", "không có", None, "Điều 4 rồi Điều 6"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    got = {r.i: [(x.article_id, x.clause_id) for x in r.y or []] for r in df.select("i", t.structured_references(F.col("x")).alias("y")).collect()}
    assert got == {0: [("5", "2"), ("7", "")], 1: [("9", "3")], 2: [("9", "")], 3: [("5", "2"), ("5", "3")], 4: [], 5: [], 6: [("4", ""), ("6", "")]}


def test_nfkc_and_html(spark):
    df = spark.createDataFrame([("ﬁne ①",), ("plain",), (None,)], "x string")
    assert [r.y for r in df.select(t.nfkc(F.col("x")).alias("y")).collect()] == ["fine 1", "plain", None]
    html = ["<p>a</p><!-- x > y --><p>b &amp; c</p>", '<a title="1 > 0">link</a> &eacute; <b>x</b>', "<script>var t='</p>';</script>Điều 5<br/>: Phạm vi", "<p>3 < 4</p>", None, "<style>p{}</style> &nbsp;x<br><br><br><br>y"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(html)], "i int, x string")
    got = {r.i: r.y for r in rows.select("i", t.html_text(F.col("x")).alias("y")).collect()}
    assert got == {0: "a\nb & c", 1: "link\n é \nx", 2: "Điều 5: Phạm vi", 3: "3 < 4", 4: None, 5: "x\ny"}


def test_sentence_windows(spark):
    text = " ".join(f"w{i}" + ("." if i % 7 == 0 else "") for i in range(1, 60))
    df = spark.createDataFrame([(text,), ("a b",), (None,)], "x string")
    got = [r.y for r in df.select(extract.sentence_windows(F.col("x"), 10, 2).alias("y")).collect()]
    assert got[1:] == [["a b"], [None]] and got[0][0] == " ".join(f"w{i}" for i in range(1, 7)) + " w7."
    assert {w for p in got[0] for w in p.split()} >= {f"w{i}" for i in range(1, 60) if i % 7} and got[0][-1].endswith("w59")


def _plain(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_wins_joins_on_row_numbers(spark):
    """Neither rows of one key nor rows without a key come together: the join is on a number of their own."""
    long = " ".join(["w"] * 40)
    rows = [(i, "A" if i % 3 else "", "1", "", long) for i in range(300)]
    df = conform(spark.createDataFrame(rows, "seq long, so_ky_hieu string, article_id string, chunk_id string, text string"), "seq")
    found = corpus.with_status(df)
    assert {(r.status, r.n) for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()} == {("kept", 101), ("duplicate", 199)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joins = [x for x in _plain(corpus.with_status(df)).split("\n") if "SortMergeJoin" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins and all("_row" in x and "key" not in x for x in joins)


def test_order_of_the_corpus(spark):
    """Ids of more than twenty characters and articles that come again in a document; rows that are equal in everything."""
    long = " ".join(["từ"] * 40)
    body = spark.createDataFrame([(f"{'x' * 30}{i}", f"Điều 1. {long} {i}\nĐiều 1. khác {long} {i}\nĐiều 2. {long} {i}") for i in range(3)], "id string, content string")
    meta = spark.createDataFrame([(f"{'x' * 30}{i}", "T", "Luật", f"{i}/QĐ-X") for i in range(3)] + [(f"{'x' * 30}0", "last", "Luật", "0/QĐ-X")], "id string, title string, legal_type string, document_number string").coalesce(1)
    rows = readers.vohuutridung(body, meta)
    assert rows.count() == 9 and rows.select("seq").distinct().count() == 9
    twice = rows.unionByName(rows)
    built = corpus.build_corpus([twice, rows], least_words=3).orderBy("idx").collect()
    assert [r.idx for r in built] == list(range(6))
    assert [(r.doc_id[-1], r.article_id) for r in built] == [(str(i), a) for i in range(3) for a in ("1", "2")]
    assert all("khác" not in r.text for r in built)
    keys = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "i string").orderBy(order_key(F.col("i"))).collect()
    assert [r.i for r in keys] == ["9", "10", "a", "b"]


def test_last_metadata(spark):
    content = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    meta = spark.createDataFrame([("01", "old", 1), ("1", "new", 2), ("2", "x", 1), (None, "y", 1)], "id string, title string, at int")
    got = corpus.join_metadata(content, meta, False, "at").collect()
    assert sorted((r.id, r.title) for r in got) == [(1, "new"), (2, "x"), (3, "")]


def test_law_names_by_containment(spark):
    titles = ["Luật Bảo hiểm", "Luật Bảo hiểm xã hội", "Nghị định chi tiết về đất"]
    index = lawmatch.title_index(spark.createDataFrame([(i, x, "") for i, x in enumerate(titles)], "idx long, title string, so_ky_hieu string"))
    names = spark.createDataFrame([(1, "bảo hiểm xã"), (2, "hiểm x"), (3, "luật abc"), (4, "nghị định nói về đất"), (5, "luật bảo hiểm xã hội tự nguyện")], "name_id int, name string")
    assert {r.name_id: r.title for r in lawmatch.match(names, index).collect()} == {1: titles[0], 2: titles[1], 3: None, 4: None, 5: titles[1]}


def test_stored_index(spark, tmp_path):
    rows = [(i, f"alpha{i} beta gamma word{i}", "T", "1", "C") for i in range(40)]
    docs = spark.createDataFrame(rows, "idx long, text string, title string, article_id string, so_ky_hieu string")
    path = f"file://{tmp_path}/index"
    stored = Retriever.over(docs, embed=hashed_vector, path=path)
    built = spark.read.parquet(f"{path}/sparse/manifest").inputFiles()
    again = Retriever.stored(docs.limit(0), path)
    asked = spark.createDataFrame([(0, "word7 beta"), (1, "gamma alpha3")], "query_id long, query string").withColumn("embedding", hashed_vector(F.col("query")))
    best = lambda r: [tuple(x) for x in r.ranked(asked, 5).orderBy("query_id", "rank").collect()]
    assert best(stored) == best(Retriever.over(docs, embed=hashed_vector)) == best(again) == best(Retriever.over(docs, embed=hashed_vector, path=path))
    assert spark.read.parquet(f"{path}/sparse/manifest").inputFiles() == built  # the same corpus builds nothing anew
    plan = _plain(again.ranked(asked, 5))
    assert plan.count("regexp_extract_all") == 0


def test_many_blocks_of_queries(spark, monkeypatch):
    from quern.operators import dense

    monkeypatch.setattr(dense, "BLOCK", 3)
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 7), 1.0]) for i in range(30)], "idx long, embedding array<float>")
    q = v.filter("idx < 8").withColumnRenamed("idx", "query_id")
    got = dense.search(v, q, 4)
    monkeypatch.setattr(dense, "BLOCK", 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dense.search(v, q, 4).collect()))


def test_loaders(spark, tmp_path):
    long = " ".join(["nội dung"] * 40)
    at = lambda name: f"{tmp_path}/{name}.parquet"
    spark.createDataFrame([(f"q{i}", "Hỏi?", f"{long} {i}") for i in range(6)], "item_id string, question string, answer string").coalesce(1).write.parquet(at("qa"))
    spark.createDataFrame([(1, "T", f"{long} luật"), (2, "", f"{long} khác")], "id int, title string, content string").write.parquet(at("uts"))
    spark.createDataFrame([(long, (None, None, "CQ"))], "doc_content string, metadata struct<DocName:string,Id:string,OrganName:string>").write.parquet(at("kc"))
    paths = {"pbgdpl": {"items": at("qa")}, "utslvc": {"documents": at("uts")}, "kiencute": {"documents": at("kc")}, "phapdien": {"articles": at("missing")}}
    with pytest.warns(UserWarning, match="phapdien"):
        built = readers.load_corpus(spark, f"file://{tmp_path}/corpus", paths)
    rows = built.orderBy("idx").collect()
    assert [r.source for r in rows] == ["utslvc"] * 2 + ["kiencute"] + ["pbgdpl"] * 6 and rows[2].doc_id == "kiencute_1"
    assert readers.load_corpus(spark, f"file://{tmp_path}/corpus", max_chunks=4).count() == 4
    assert readers.load_source(spark, "pbgdpl", paths["pbgdpl"], max_docs=2).count() == 2
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        readers.load_corpus(spark, f"file://{tmp_path}/none", {"phapdien": paths["phapdien"]})


def test_storage(spark):
    df = written(spark.range(5), "five")
    assert df.count() == 5 and complete(spark, df.written_to)
    discard(df)
    assert not complete(spark, df.written_to) and shared_dir(spark) != shared_dir(spark)


def test_config(monkeypatch):
    monkeypatch.setenv("LLM_KEYS", "a, b")
    monkeypatch.setenv("DEVICE", "gpu")
    c = Config.from_env()
    assert c.keys() == ["a", "b"] and c.device_of("reranker") == "gpu" and Config(embedding_device="x").device_of("embedding") == "x"
    with pytest.raises(ValueError, match="rrf_k"):
        Config(rrf_k=0)


def test_prompts():
    text = prompts.prompt("ASSESS", question="q?", found="")
    assert text.split("\n", 1)[0] == "ASSESS" and "is_complete" in text and text.endswith("QUESTION\nq?")
    assert prompts.part(prompts.prompt("EDIT", answer="so\nit is"), "answer") == "so\nit is"
    assert set(prompts.TASKS) >= {"ANALYSE", "HYPOTHETICAL", "CLASSIFY", "EXPAND", "DECOMPOSE", "RECOMPOSE", "RERANK", "ANSWER", "USEFUL?", "CORRECT", "EDIT"}
    assert prompts.temperature("HYPOTHETICAL") == 0.7


def test_evaluation_runner(spark, tmp_path):
    calls = []

    def answer(question):
        calls.append(question)
        if question == "slow":
            time.sleep(3)
        if question == "bad":
            raise RuntimeError("broken")
        return Result(question, "factual", "text", chunks=[{"so_ky_hieu": "C", "article_id": question}] * 2 + [{"so_ky_hieu": "", "article_id": "9"}], confidence=0.5)

    rows = [(f"q{i}", x, [f"C#{x}"]) for i, x in enumerate(["1", "bad", "slow", "2", "3"])]
    questions = spark.createDataFrame(rows, "query_id string, question string, reference_articles array<string>")
    folder = f"file://{tmp_path}/runs"
    got = evaluate.run_all(spark, answer, questions, folder, size=3, workers=2, timeout=0.5).collect()
    assert [(r.batch_idx, r.num_queries, r.num_errors, r.mrr) for r in got] == [(0, 1, 2, 1.0), (1, 2, 0, 1.0)]
    detail = spark.read.json(f"{folder}/batch0/detail").collect()
    assert [r.query_id for r in detail] == ["q0", "q1", "q2"] and [r.error for r in detail] == [None, "broken", "timeout"]
    n = len(calls)
    evaluate.run_all(spark, answer, questions, folder, size=3)
    evaluate.run_batch(spark, answer, questions, 0, f"{folder}/batch0", 3)
    assert len(calls) == n  # what is there is kept
    evaluate.run_batch(spark, lambda q: answer("1"), questions, 0, f"{folder}/batch0", 3, retry=True)
    assert len(calls) == n + 1  # the question that took too long


def test_server(spark):
    rows = [(i, f"nội dung về vốn điều lệ số {i}", "Luật Doanh nghiệp", str(i), "59/2020/QH14", "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "idx long, text string, title string, article_id string, so_ky_hieu string, source string")
    app = server.serve(Service(Engine(Retriever.over(docs, embed=hashed_vector), RuleModel(), hashed_vector)), port=0)
    threading.Thread(target=app.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{app.server_port}/api"

    def ask(route, body=None):
        request = urllib.request.Request(f"{base}/{route}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        status, body = ask("health")
        assert status == 200 and json.loads(body)["corpus_docs"] == 5
        status, body = ask("retrieve", {"query": "vốn điều lệ", "top_k": 2})
        assert status == 200 and len(json.loads(body)["chunks"]) == 2
        assert ask("retrieve", {"query": "ab"})[0] == 422 and ask("nothing")[0] == 404 and ask("chat", [1])[0] == 422
        status, body = ask("chat/stream", {"query": "vốn điều lệ là gì"})
        assert status == 200 and body.startswith("event: stage") and "event: done" in body
        assert "event: error" in ask("chat/stream", {"query": "ab"})[1]
    finally:
        app.shutdown()
