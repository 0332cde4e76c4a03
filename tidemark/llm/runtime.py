"""Session settings and shared storage that the operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch.  Texts are whole, so a batch is kept to few rows, and to fewer where they are long.
BATCH_ROWS, BATCH_BYTES = 400, 32 << 20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: the memory of a Python worker follows the batch, and texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Where the setting is absent the session's own checkpoint folder is used; on one machine it is set to a temporary one if
    it has none, on a cluster that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and the shuffle files that it took are given up."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into a new folder of the shared one and read back."""
    return write(df, f"{shared_dir(df.sparkSession)}/{name}")


class Workspace:
    """A folder of its own in the shared folder for what an operator writes on its way; ``drop`` removes it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_dir(spark)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return write(df, f"{self.path}/{name}")

    def drop(self, name: str | None = None) -> None:
        """Removes all of it, or the table of that name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Names by which Spark knows stores that pyarrow knows by others.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def opened_store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder by the URI that Spark uses for it."""
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
