"""Session construction and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "spectrafold", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "12g", **conf) -> SparkSession:
    """A local session with the settings the tests and the bench share.

    On a cluster the session comes from the launcher; nothing in the library depends on
    these values.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. A temporary folder is used only by a local master that
    names none; a cluster without the setting is an error, because a folder on one machine
    would not survive the loss of that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spectrafold-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from what was written.

    Used where later steps must all see one evaluation of ``df`` (row numbering, sampling,
    iteration state) even after executors are lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Spool:
    """A result table in the checkpoint folder that a driver loop appends to batch by batch."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"

    def add(self, rows: list) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
