"""Session helpers: importable workers and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and bounds the rows of one Arrow batch."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where it is unset and all runs on one machine, as in tests, one is made and set."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(f"file://{named}")
        named = context.getCheckpointDir()
    return named.rstrip("/")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, which `clean` deletes."""
    uri = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(uri)
    return uri


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read from there.

    Loops cut their lineage with it: what follows survives lost executors and computes nothing twice.
    """
    uri = fresh(df.sparkSession, tag)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> int:
    """Deletes all that this process put into the shared folder, when no result that reads it is needed any more; returns the number of places."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
