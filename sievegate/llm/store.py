"""Tables cut out of the lineage: Parquet in the folder that driver and executors share.

The folder is the one named by ``spark.checkpoint.dir``. Only where that is
unset and the master is local does a folder of this machine take its place.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sievegate-")
    return _LOCAL[app]


#: Rows that go to Python at once: texts are long, and Spark's own number of rows takes no account of that.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches where the session has Spark's default, so that a task's buffers hold a few megabytes of text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


class Store:
    """Named tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded_batches(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _FOLDERS.append(self.path)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; a lost executor costs no recomputation from here on."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no pending frame reads, and let Spark clear the shuffles behind them."""
        for name in names:
            _remove(self.spark, f"{self.path}/{name}")
        gc.collect()
        self.spark._jvm.System.gc()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables of this session's operators. Frames that operators have returned read some of them, so their results must have been saved."""
    while _FOLDERS:
        _remove(spark, _FOLDERS.pop())


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which deployments size with their data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
