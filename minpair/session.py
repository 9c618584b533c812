"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings that matter at any scale: AQE re-plans shuffles at run time (coalesces small
# partitions, splits skewed join partitions), ANSI keeps arithmetic errors loud.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "minpair",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own conf instead."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``. Only a session that runs in one process (tests, the bench) gets
    a scratch folder when it has none; on a cluster a machine-local folder would be lost to the
    executors, so that is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="minpair-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A location under the cluster's shared checkpoint folder for materialised tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def materialise(df):
    """Reliable ``checkpoint`` into the session's ``spark.checkpoint.dir`` (lineage cut, survives
    executor loss); the folder comes from the session conf and is only invented when unset."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """``df`` written once as Parquet to the shared folder and read again: far smaller than a checkpoint for
    long tables of repeated keys and words."""
    path = shared_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of text that one task takes in where rows are dealt by a key, so that a task's memory does not
#: grow with the input.
PART_BYTES = 16_000_000


def parts_of(df, *cols: str) -> int:
    """How many parts the texts of ``cols`` fill; one number comes to the driver."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in cols), F.lit(0).cast("long"))
    return max(1, -(-(df.agg(F.sum(size).alias("n")).first()["n"] or 0) // PART_BYTES))


def dealt_by(df, parts: int, *keys):
    """``df`` dealt by ``keys`` to ``parts`` tasks; up to the session's own number Spark chooses."""
    few = parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*keys) if few else df.repartition(parts, *keys)
