"""First-wins over a stream with bounded state: repeated, late and expired keys; rows without a key."""

import json
import os

from pyspark.sql import functions as F

from quern.schema import conform
from quern.streaming.streams import dedup_with_ttl, late_rows, started

LONG = " ".join(["nội dung"] * 20)


def _rows(spark, rows):
    own = spark.createDataFrame(rows, "doc_id string, so_ky_hieu string, article_id string, at int")
    return own.withColumns({"text": F.concat(F.lit(LONG), F.lit(" "), "doc_id"), "ts": F.timestamp_seconds(F.col("at") + 10**9)})


def test_dedup_with_ttl(spark, tmp_path):
    batches = [
        [("a0", "C", "1", 0), ("a5", "C", "1", 5), ("b3", "C", "2", 3), ("n1", "", "", 1), ("n2", "", "", 1), *((f"a{i}", "C", "1", 6) for i in range(100, 130))],
        [("a20", "C", "1", 20), ("c200", "C", "3", 200)],  # the watermark goes to 190 when this batch ends
        [("d195", "C", "4", 195)],  # keys are forgotten by this watermark, rows are late by it in the next batch
        [("late", "C", "9", 10), ("a210", "C", "1", 210), ("b211", "C", "2", 211), ("a212", "C", "1", 212), ("c213", "C", "3", 213)],
    ]
    for i, rows in enumerate(batches):
        _rows(spark, rows).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("part-*"):
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)  # files are read in the order of their times
    stream = spark.readStream.schema("doc_id string, so_ky_hieu string, article_id string, text string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    rows = conform(stream, "ts")
    out = dedup_with_ttl(rows, "ts", "10 seconds", 60, least_words=3)
    query = started(out.select("doc_id", "ts").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True))
    query.awaitTermination()
    got = sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # a and b are forgotten at 60 and 63, c (until 260) is not
    assert got == sorted(["a0", "b3", "n1", "n2", "c200", "d195", "a210", "b211"])
    assert late_rows(query) == 1
    rows_kept = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert rows_kept[-1] <= 2 * 5  # a value and a timer each for a, b, c, d and what has not expired
