"""What long jobs need of the session."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the folder that all executors share, named in spark.checkpoint.dir, and read from there: later
    jobs neither repeat the work nor depend on an executor that may be lost. Only where the setting is missing and no
    folder was set, as in local tests, a temporary one is used."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folioflow-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, *keys: str) -> DataFrame:
    """df with its columns as results. Else a filter above would be pushed down through all steps, and every step's
    expressions repeated in it wherever the next ones use them more than once. keys: plain columns that pass as they are,
    so that rows partitioned by them stay so."""
    return df.select(*keys, F.inline_outer(F.array(F.struct(*[c for c in df.columns if c not in keys]))))
