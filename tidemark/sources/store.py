"""Where tables live: Parquet folders below a root, written so that a repeated batch changes nothing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """Rows would be stored twice under one key."""


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see; it goes when the driver ends.

    Where that is not set, on one machine, it is below the warehouse; on a cluster that is refused, since the warehouse's
    default is a folder of the driver's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
    return path


def _file_system(spark: SparkSession, path: str):
    """(file system, path) as Spark's own storage layer has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def held(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: what several branches of a query use is computed once."""
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The same rows over as many tasks as a shuffle has, by hashes of columns: a small file is read by one task, whatever its
    rows then cost."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def append_batch(df: DataFrame, root: str, name: str, batch: int, keys: list[str]) -> None:
    """Writes a micro-batch to a folder of its own (``batch_id=``): the same batch again replaces itself.

    Repeated keys within the batch are refused.
    """
    if duplicates(df, keys).limit(1).count():
        raise IntegrityError(f"{name}: repeated keys in batch {batch}")
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch}")


def insert_new(df: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys are not stored yet, each key once."""
    new = df.dropDuplicates(keys)
    return new if stored is None else new.join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both together; of rows with equal keys the one with the greatest version."""
    rows = stored.unionByName(new)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__last")).select(*keys, "__last.*")


def retained(df: DataFrame, column: str, since: int) -> DataFrame:
    return df.where(F.col(column) >= since)


def identity(spark: SparkSession, root: str) -> str:
    """The store's own name, made once."""
    path = f"{root}/_identity"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(fs_path):
        return json.loads(spark.read.text(path).first()[0])["store_id"]
    made = uuid.uuid4().hex
    spark.createDataFrame([(json.dumps({"store_id": made}),)], "value string").coalesce(1).write.text(path)
    return made


def bounded_lines(spark: SparkSession, path: str, most: int = 32_768) -> DataFrame:
    """(line, value) of a JSON-lines export with lines of at most so many bytes; a longer one fails the job."""
    raw = spark.read.text(path).select("*", F.col("_metadata.file_name").alias("__file"))
    checked = F.when(F.octet_length("value") > most, F.raise_error(F.lit("a line is longer than the bound")).cast("string")).otherwise(F.col("value"))
    return raw.select(F.monotonically_increasing_id().alias("line"), checked.alias("value"))


def read_document(path: str) -> tuple[dict | None, str | None]:
    """A small JSON document, or why it cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except OSError as e:
        return None, f"unreadable: {e.strerror}"
    except ValueError:
        return None, "not JSON"
    return (found, None) if isinstance(found, dict) else (None, "not an object")


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """Writes a small JSON document wherever Spark can write, in the place of the one before: readers see one or the other."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = at.getFileSystem(conf)
    out = files.create(new, True)
    try:
        out.write(bytearray(json.dumps(document, sort_keys=True).encode()))
    finally:
        out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(option, 1)
    how[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(new), files.makeQualified(at), how)


def stored_document(spark: SparkSession, path: str) -> tuple[dict | None, str | None]:
    """A small JSON document from wherever Spark can read, or why there is none."""
    files, at = _file_system(spark, path)
    if not files.exists(at):
        return None, "not there"
    try:
        found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    except ValueError:
        return None, "not JSON"
    return (found, None) if isinstance(found, dict) else (None, "not an object")


def merge_on_read(batches: DataFrame) -> DataFrame:
    """The batches of a table without their batch numbers."""
    return batches.drop("batch_id")


def sealed_or_none(spark: SparkSession, root: str, name: str) -> tuple[DataFrame | None, str | None]:
    """A sealed table, or why it cannot be read: readers go on without it (their state is then offline)."""
    from pyspark.errors import AnalysisException

    try:
        return read(spark, root, name), None
    except AnalysisException as e:
        return None, e.getCondition() or "unreadable"
