"""Results that several branches of a plan read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def ensure_shared_dir(spark) -> str:
    """Checkpoints go to the session's spark.checkpoint.dir. A local session without one gets a folder; a cluster without one
    is an error, as its machines would not see each other's files."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="attesta-"))
    return named or context.getCheckpointDir()


def computed_once(df: DataFrame) -> DataFrame:
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()


def written_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, whose columns and row groups can be read apart, unlike a checkpoint's."""
    path = f"{ensure_shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables of written_once() that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
