"""Session helpers shared by tests, benches and iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "pulsegrid") -> SparkSession:
    """A local session with the settings the tests and the bench rely on."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    Only a local master, as in tests, gets a fresh temporary folder when the
    setting is missing: on a cluster a machine-local path would not survive an
    executor loss, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_files(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet files under the checkpoint folder.

    For loops over many rounds: a checkpoint inherits the constraints of the plan behind it, which can multiply from
    round to round; files carry none, and long texts take less room in them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_to_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Materialise ``df`` as a table in the warehouse, bucketed by ``key``: joins and groups by it read it without a shuffle.

    Deal ``df`` by ``repartition(buckets, key)`` before, so that each task writes one bucket. The table stays until the
    warehouse is cleared.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def settle(df: DataFrame) -> DataFrame:
    """For a table that many small jobs read: written once, cached, and with a short plan.

    A lost executor costs a re-read of the written copy, not the work behind it.
    """
    return cut_lineage(df).persist()
