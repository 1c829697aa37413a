"""Sessions, input tables, and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session as tests use it; on a cluster pass the cluster's own."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, as it is. Only where it is unset, and all runs on one machine, a temporary folder is made."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veristrata-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: survives lost executors and ends the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table beside the checkpoints: as safe as ``cut``, but packed, and a reader takes only the columns that it uses. For wide rows that are read several times."""
    at = f"{checkpoint_dir(df.sparkSession)}/veristrata-stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
