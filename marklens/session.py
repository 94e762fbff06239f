"""Session settings the engine is tuned for, and how it cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only what the engine relies on; sizes stay with the cluster's own configuration.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _shared_folder(spark: SparkSession) -> str | None:
    """The folder that all executors reach, as the cluster names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def scratch_folder(spark: SparkSession) -> str:
    """Name of a new folder for written intermediates, under the shared one.

    Where none is named, a local run takes this machine's temporary folder; on a cluster that is an error, since other
    machines would not see what is written there.
    """
    shared = _shared_folder(spark)
    if shared is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "marklens")
    return f"{shared.rstrip('/')}/marklens-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates once what was made of it is written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to reliable storage and read on from there, so a lost executor costs one stage, not the loop."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_lineage_dealt(df: DataFrame) -> DataFrame:
    """`cut_lineage` of a table that stays dealt out by the keys of its last shuffle: joins on them do not move it again.

    Adaptive planning forgets how rows are dealt, so it is off while the table is written.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set(name, before)
