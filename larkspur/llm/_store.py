"""Tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.session import send_package

#: Arrow batches of long texts stay small; Spark's own limit is by rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_MOST = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors and bound the session's Arrow batches."""
    send_package(spark)
    with contextlib.suppress(Exception):
        spark.conf.set(BATCH_BYTES, BATCH_MOST)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. A temporary one where that is unset and the master is local,
    as in tests; on a cluster, where executors would not see it, an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        with contextlib.suppress(Exception):
            base = spark.conf.get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_larkspur_dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext._larkspur_dir = tempfile.mkdtemp(prefix="larkspur-shared-")
    return f"{base.rstrip('/')}/larkspur/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all tables and archives that this application has put into the shared folder, those of attempts that failed
    included. Results that still read them must be written elsewhere first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor
    costs no recomputation. The shuffle files of the write are dropped as soon as it ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with fresh_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def fresh_shuffles(spark: SparkSession):
    """Within, a query's shuffle files go when the query ends instead of when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    with contextlib.suppress(Exception):
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(CLEANUP, before)


def drop(df: DataFrame) -> None:
    """Delete a table that ``save`` made."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
