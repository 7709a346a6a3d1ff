"""Session set-up and the checkpoint helper used by the iterative graph jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "inquest", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the detectors rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command names the master, and AQE coalesces the cluster's own default.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a private one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inquest-ckpt-", dir=os.environ.get("TMPDIR")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: the plan restarts from files.

    A table is used rather than ``checkpoint()``, whose result keeps the size guess
    of the plan behind it. In a loop of joins those guesses multiply without bound;
    files have their true size, so joins are planned by what is really there.
    """
    path = shared_scratch(df.sparkSession, "step")
    df.write.parquet(path)
    step = df.sparkSession.read.schema(df.schema).parquet(path)
    step._step_folder = path
    return step


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder that nothing reads any more, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_step(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, written as by ``cut_lineage``; then ``old``, a step of its own that ``new`` was made from and nothing else reads, goes."""
    done = cut_lineage(new)
    remove_folder(old.sparkSession, old._step_folder)
    return done
