"""Tables on the folder that driver and executors share, used to cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed on them."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on a local master (tests) a local folder, which is then set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_weft_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext._weft_dir = found
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: while a table is written: what goes to Python workers at a time, which buffers on either side must hold; and that its shuffle files, which
#: nothing reads again once the table is there, go at its end instead of when the driver next collects garbage
WRITING = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextlib.contextmanager
def while_writing(spark: SparkSession) -> Iterator[None]:
    """WRITING for what is run inside; the session's own settings hold again afterwards."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read again after the loss of any executor; by: a column to have folders for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with while_writing(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    schema = df.schema if by is None else df.select(*[c for c in df.columns if c != by], by).schema
    out = spark.read.schema(schema).parquet(path)
    out._weft_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._weft_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
