import pytest
from pyspark.sql import functions as F

from quern.operators.dense import hashed_vector
from quern.plans.agent import Engine, RuleModel, parsed
from quern.plans.retrieval import Retriever
from quern.plans.service import Service
from quern.sources.readers import last_results
from quern.streaming.streams import dedup_stream, upsert_results


class Scripted(RuleModel):
    """Finds the coverage incomplete once, and splits questions."""

    def __init__(self):
        self.turns = 0

    def generate(self, prompt, temperature=0.1):
        task = prompt.split("\n", 1)[0]
        if task == "ANALYSE":
            return '```json\n{"laws": ["Luật Doanh nghiệp 2020"], "search_queries": ["vốn điều lệ"]}\n```'
        if task == "ASSESS":
            self.turns += 1
            return '{"is_complete": false, "follow_up_queries": ["bảo hiểm"]}' if self.turns == 1 else '{"is_complete": true}'
        if task == "CLASSIFY":
            return "multi_article"
        if task == "DECOMPOSE":
            return "- phần thứ nhất\n- phần thứ hai"
        if task == "RECOMPOSE":
            return "theo Điều 1 và Điều 2"
        return super().generate(prompt, temperature)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, f"nội dung về vốn điều lệ số {i}, theo Điều 7 của Luật này", "Luật Doanh nghiệp năm 2020", str(i), "59/2020/QH14") for i in range(12)] + [(12, "bảo hiểm xã hội bắt buộc", "Luật Bảo hiểm", "1", "58/2014/QH13")]
    docs = spark.createDataFrame(rows, "idx long, text string, title string, article_id string, so_ky_hieu string").withColumn("source", F.lit("x"))
    return Engine(Retriever.over(docs, embed=hashed_vector), Scripted(), hashed_vector)


def test_agent_and_classic(engine):
    out = engine.agent("vốn điều lệ của doanh nghiệp?")
    assert out.answer and out.chunks and 0 < out.confidence <= 1 and engine.model.turns == 2
    out = engine.classic("vốn điều lệ của doanh nghiệp?")
    assert out.query_type == "multi_article" and out.citations == ["Điều 1", "Điều 2"]


def test_agent_answers_every_question(spark, engine, tmp_path):
    from quern.queries import search

    rows = [(i, f"alpha{i} beta gamma word{i} of this text", "en", "s", 30) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    questions = [(i, f"word{i} beta") for i in range(3, 26)]
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.query_id: r.query for r in search.agent_answer(spark, str(tmp_path)).collect()}
    assert got == dict(questions)
    asked = [(4, "vốn điều lệ"), (9, "bảo hiểm xã hội")]
    rules = Engine(engine.retriever, RuleModel(), hashed_vector)
    both = dict(rules.agents(spark.createDataFrame(asked, "query_id long, query string")))
    for i, query in asked:
        alone = rules.agent(query)
        assert (both[i].answer, both[i].relevant_docs, both[i].confidence) == (alone.answer, alone.relevant_docs, alone.confidence)


def test_service(engine):
    service = Service(engine)
    assert service.health()["corpus_docs"] == 13
    stats = service.stats()
    assert stats["total_docs"] == 13 and stats["top_laws"][0] == {"so_ky_hieu": "59/2020/QH14", "chunks": 12}
    assert service.retrieve("bảo hiểm", 3)[0]["title"] == "Luật Bảo hiểm"
    with pytest.raises(ValueError):
        service.retrieve("ab")


def test_parsed():
    assert parsed('x {"a": 1} y') == {"a": 1} and parsed("none") == {}


def test_streams(spark, tmp_path):
    long = " ".join(["w"] * 40)
    rows = [(1, "A", "1", "", long, "d1"), (2, "A", "1", "", long, "d2"), (3, "", "", "", long, "d3"), (4, "A", "2", "", "short", "d4")]
    schema = "seq long, so_ky_hieu string, article_id string, chunk_id string, text string, doc_id string"
    spark.createDataFrame(rows, schema).withColumn("doc_number", F.lit("")).withColumn("title", F.lit("")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    dedup_stream(stream, all_keys=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len({r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect()} & {1, 2}) == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 2
    upsert_results(stream.select(F.col("seq").alias("query_id"), "text"), f"{tmp_path}/results", f"{tmp_path}/state2").trigger(availableNow=True).start().awaitTermination()
    assert last_results(spark.read.parquet(f"{tmp_path}/results"), "seen").count() == 4
