"""Session helpers shared by every job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import barlens


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (not the cluster sizing)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Ship the few task-side helpers inside the job: executors need no install.
    cloudpickle.register_pickle_by_value(barlens)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which driver and executors share.

    Only a session that runs inside one process may do without it: there the driver's
    disk is every executor's disk.  Elsewhere a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="barlens-cp-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def use_checkpoints(spark: SparkSession) -> None:
    """Point the context at the shared folder."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends here."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/barlens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder: lineage ends here and a lost
    executor costs a re-read, not a replay of every earlier round."""
    use_checkpoints(df.sparkSession)
    # New column identities, so that rounds of one loop can be unioned and joined.
    return df.checkpoint(eager=True).toDF(*df.columns)
