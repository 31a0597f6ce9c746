"""The agent over tables of questions: against the loop of single questions, and with models that fail."""

import time

import pytest
from pyspark.sql import functions as F

from quern.operators.dense import hashed_vector
from quern.plans import batch, prompts
from quern.plans.agent import Engine, RuleModel
from quern.plans.retrieval import Retriever


def scripted():
    """A model defined here, so that workers get it by value: names a law, asks on once, answers from its context."""

    class Scripted(RuleModel):
        def generate(self, prompt, temperature=0.1):
            task = prompt.split("\n", 1)[0]
            if task == "ANALYSE" and "doanh" in prompt:
                return '{"laws": ["Luật Doanh nghiệp", "Không có"], "search_queries": ["vốn điều lệ"]}'
            if task == "ANALYSE":
                return "no object"
            if task == "HYPOTHETICAL":
                return "đoạn văn giả định về thuế"
            if task == "ASSESS":
                return '{"is_complete": false, "follow_up_queries": ["đất đai", "thuế đất"]}' if "iter" not in prompt and "đất" in prompt else '{"is_complete": true}'
            if "crash" in prompt and task == "ANSWER":
                raise RuntimeError("no answer to this")
            return super().generate(prompt, temperature)

    return Scripted()


@pytest.fixture(scope="module")
def retriever(spark):
    subjects = [("doanh nghiệp vốn điều lệ", "Luật Doanh nghiệp", "59/2020/QH14"), ("đất đai quyền sử dụng", "Luật Đất đai", "45/2013/QH13"), ("thuế thu nhập cá nhân", "Luật Thuế", "04/2007/QH12")]
    rows = [(i, f"{subjects[i % 3][0]} điều khoản số {i} quy định chi tiết về {subjects[i % 3][0]} theo mục {i % 7}", subjects[i % 3][1], str(i), subjects[i % 3][2]) for i in range(36)]
    return Retriever.over(spark.createDataFrame(rows, "idx long, text string, title string, article_id string, so_ky_hieu string"), embed=hashed_vector)


def test_same_as_single_questions(spark, retriever):
    engine = Engine(retriever, scripted(), hashed_vector)
    rows = [(7, "vốn doanh nghiệp là gì"), (8, "tôi mua đất của hàng xóm thì làm sao"), (9, "thuế thu nhập tính thế nào")]
    asked = spark.createDataFrame(rows, "query_id long, query string")
    got = {r.query_id: r for r in batch.answered(engine, asked).collect()}
    want = dict(engine.agents(asked))
    assert set(got) == set(want) == {7, 8, 9}
    for i, w in want.items():
        g = got[i]
        assert (g.answer, g.citations, g.relevant_docs, g.relevant_articles, g.n_chunks, g.corrections, g.error) == (w.answer, w.citations, w.relevant_docs, w.relevant_articles, len(w.chunks), w.corrections, None)
        assert g.confidence == pytest.approx(w.confidence)
    assert got[7].relevant_docs == ["59/2020/QH14|Luật Doanh nghiệp"]  # only chunks of the law that it names


def test_prompts_are_the_same(spark):
    df = spark.createDataFrame([("q?", "a\nb", ""), ("x", None, "n")], "q string, f string, e string")
    got = [r[0] for r in df.select(batch.prompt_of("ASSESS", question=F.col("q"), found=F.col("f"), note=F.col("e"))).collect()]
    assert got == [prompts.prompt("ASSESS", question="q?", found="a\nb", note=""), prompts.prompt("ASSESS", question="x", found=None, note="n")]


def test_calls():
    tries = {}

    def call(x):
        tries[x] = tries.get(x, 0) + 1
        if x == "slow":
            time.sleep(1.5)
        if x == "bad" or (x == "flaky" and tries[x] == 1):
            raise RuntimeError("broken")
        return x.upper()

    began = time.time()
    got = batch.run_calls(["a", "slow", "bad", None, "flaky", "b"], call, batch.Calls(workers=3, timeout=0.4, retries=1))
    assert [(r, e) for r, e, _ in got] == [("A", None), (None, "timeout"), (None, "broken"), (None, None), ("FLAKY", None), ("B", None)]
    assert tries == {"a": 1, "slow": 2, "bad": 2, "flaky": 2, "b": 1} and time.time() - began < 3
    assert batch.run_calls([], call, batch.Calls()) == []


def test_evaluated(spark, retriever, tmp_path):
    engine = Engine(retriever, scripted(), hashed_vector)
    rows = [(f"q{i}", x, [f"59/2020/QH14#{a}"]) for i, (x, a) in enumerate([("vốn doanh nghiệp", "0"), ("crash doanh nghiệp", "3"), ("quyền sử dụng đất", "1"), ("doanh nghiệp vốn điều lệ", "3")])]
    questions = spark.createDataFrame([*rows, ("q9", "thuế", None)], "query_id string, question string, reference_articles array<string>")
    folder = f"file://{tmp_path}/runs"
    got = batch.evaluated(engine, questions, folder, size=2, how=batch.Calls(retries=0)).collect()
    assert [(r.batch, r.num_queries, r.num_errors) for r in got] == [(0, 2, 1), (1, 2, 0), (2, 1, 0)]
    results = {r.query_id: r for r in spark.read.parquet(f"{folder}/results").collect()}
    assert results["q1"].error == "no answer to this" and results["q1"].answer == "" and results["q0"].predicted_articles and results["q9"].batch == 2
    before = {k: r.time for k, r in results.items()}
    again = batch.evaluated(engine, questions, folder, size=2, how=batch.Calls(retries=0)).collect()
    assert again == got and {r.query_id: r.time for r in spark.read.parquet(f"{folder}/results").collect()} == before  # nothing is asked twice
    # with retry a question whose answer failed keeps its result unless the error is one of a time
    batch.evaluated(engine, questions, folder, size=2, retry=True, how=batch.Calls(retries=0))
    assert spark.read.parquet(f"{folder}/results").count() == 5
