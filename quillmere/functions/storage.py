"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths that materialize has written below a materialize_last, which deletes them.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)

#: Bytes of an Arrow batch between an executor and its Python workers, and Spark's own limit.
BATCH_BYTES, BATCH_CONF, SPARK_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends whole texts to Python in batches of about BATCH_BYTES, unless it has a limit of its own.

    By Spark's limit a batch is all that a task reads; the executor holds it beside its heap while the worker holds it
    and what it makes of it.
    """
    if spark.conf.get(BATCH_CONF) == SPARK_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset and the master is local, a temporary
    folder stands in; elsewhere executors could not see that, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillmere-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillmere/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_last(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Like materialize(make(), name); then the tables that make() has materialised on its way are deleted, as nothing but
    its result may read them."""
    token = _passing.set(paths := [])
    try:
        df = make()
    finally:
        _passing.reset(token)
    out = materialize(df, name)
    spark = df.sparkSession
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    return out
