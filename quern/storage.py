"""Where lineage is cut: tables written to the folder that the cluster shares."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: While it holds, Spark removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of text of which a Python worker makes lists at once; a longer text is handled alone.
PIECE = 1 << 20


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """The texts of a batch in slices of at most ``most`` bytes, or of one text."""
    size = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), out=size[1:])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset and one machine does all (tests), a temporary
    folder is set. A cluster has to name its shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not re.match(r"local($|\[)", master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quern-{uuid.uuid4().hex}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that end herein go with them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs, and lost executors, start from there. The shuffle
    files of the query go as soon as the table is there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    with cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there, to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def fingerprint(df: DataFrame, **settings) -> str:
    """What tells a table's state apart: its plan, the names, sizes and times of the files that it reads, and ``settings``.
    Rows that lie in no file (a frame made in a session) are told apart within the session."""
    spark = df.sparkSession
    found = []
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    memory = df.semanticHash() if not found or re.search("LogicalRDD|LocalRelation|ExternalRDD", plan) else 0
    told = repr((plan, memory, sorted(found), sorted((k, str(v)) for k, v in settings.items())))
    return hashlib.sha256(told.encode()).hexdigest()


def current(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether what lies at the path was built from what ``mark`` (a :func:`fingerprint`) says."""
    return complete(spark, f"{path}/manifest") and spark.read.parquet(f"{path}/manifest").first()["mark"] == mark


def note(spark: SparkSession, path: str, mark: str) -> None:
    """Writes the manifest that :func:`current` reads; it comes last."""
    save(spark.createDataFrame([(mark,)], "mark string").coalesce(1), f"{path}/manifest")


def forget(spark: SparkSession, path: str) -> None:
    """Removes the manifest, before what it speaks of changes."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def save(df: DataFrame, path: str) -> None:
    """``df`` as Parquet at the path, in place of what is there."""
    df.write.mode("overwrite").parquet(path)
