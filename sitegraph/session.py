"""Session helpers: a tuned builder, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sitegraph", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the one you are given."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such
    a folder is gone with the machine, and no other executor can read it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sitegraph-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared root."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written table outlives lost executors, keeps the plan of an iterative
    job short, and gives the next join real sizes to choose a strategy from.
    """
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
