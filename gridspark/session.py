"""Session settings and the two run-time guards the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows up to which a lookup table may be broadcast. At 64 bytes a row this is 64 MB,
# which every executor can hold; larger tables take the shuffled plan instead.
BROADCAST_ROWS = 1_000_000


def build_session(app: str = "gridspark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators assume; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Methods above this size are never compiled by the JIT; Spark then generates smaller ones.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` is proven to hold at most `max_rows` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the one that spark.checkpoint.dir names, which all executors share.

    Only a session inside one local process gets a folder of its own when that setting is missing.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            # Executors of a local-cluster are processes of their own, like those of any cluster.
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` once to the shared checkpoint folder and read it back.

    Unlike an RDD checkpoint this computes the rows only once and keeps the table's size known to
    the optimizer.
    """
    return _written(df, shared_folder(df.sparkSession))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job: written as by materialise() and deleted when the job leaves the `with` block.

    What the job hands on must not read them any more, so its own result is written outside the block, or before
    the block ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def folder(self) -> str:
        """A new shared folder that goes with the block."""
        self.paths.append(shared_folder(self.spark))
        return self.paths[-1]

    def __call__(self, df: DataFrame) -> DataFrame:
        return _written(df, self.folder())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        jvm, settings = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(settings).delete(folder, True)
        self.paths.clear()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside the block, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
