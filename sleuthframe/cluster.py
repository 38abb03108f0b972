"""Makes this package importable in Python workers, wherever the driver runs."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows handed to a Python worker at once while a scratch table is written: both sides hold a batch whole, and texts are long.
BATCH_ROWS = 512
#: Rows of a task, least and most, where a table is spread.
TASK_ROWS = 100, 4000


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table, each of which makes much work, over all cores: a file of a few MB is one task otherwise. The number of tasks follows that of the rows."""
    rows = df.count()
    n = max(min(rows // TASK_ROWS[0], 4 * df.sparkSession.sparkContext.defaultParallelism), rows // TASK_ROWS[1])
    return df.repartition(n) if n > 1 else df


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".toml"):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
    # The driver serves this file to the executors; they never look for the folder.
    at = Path(tempfile.mkdtemp(prefix="sleuthframe-")) / f"{root.name}.zip"
    at.write_bytes(data.getvalue())
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one is made only in local mode, where none is set."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="sleuthframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most BATCH_ROWS for what runs within; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder for the length of a ``with`` block.

    They cut the lineage: after the loss of an executor they are read, not
    computed again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        with small_batches(self.spark):
            df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """A checkpoint, which outlives the block; with spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes it once no plan refers to it."""
        with small_batches(self.spark):
            return df.checkpoint()

    def __exit__(self, *exc: object) -> None:
        remove(self.spark, self.at)


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
