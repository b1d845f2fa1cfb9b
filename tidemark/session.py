"""Session helpers: the shared folder for cut lineage, and a local session for tests and benches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_shared_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to: what the session names in spark.checkpoint.dir.

    Only a single-machine session without that setting gets a temporary folder of its own; elsewhere a
    machine-local folder would be invisible to the other machines, so that is an error."""
    sc = spark.sparkContext
    if (current := sc.getCheckpointDir()) is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, store it in the shared folder, and go on from the stored rows.

    The stored rows outlive executors, and later plans do not repeat what led to them."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """The same for large sets of numbers, in Parquet's packed columns, which take a fifth of the room or less. What was shuffled for them
    is given free now, not when the driver happens to collect its garbage. The files stay in the shared folder."""
    spark = df.sparkSession
    folder = f"{ensure_shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(folder)


def bare(df: DataFrame) -> DataFrame:
    """Stored rows without the estimate of their size, which joins multiply: over a loop its digits would double each time."""
    spark, own = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(own.queryExecution().toRdd(), own.schema(), False), spark)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
