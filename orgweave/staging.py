"""Intermediate results written to the folder all executors share.

A stage is computed once, its lineage ends there, and losing an executor loses none of it. The folder is
``spark.checkpoint.dir``; where that is unset, a local session (tests) makes and sets one, and a cluster is refused:
its executors would each write to a disk of their own. Every application has a folder of its own below it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    got = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orgweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        got = f"file://{folder}"
        spark.conf.set(_KEY, got)
    return got.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one."""
    return f"{shared_dir(spark)}/orgweave/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete this application's stages; for its end, as results may still read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "stage", dictionary: bool = True) -> DataFrame:
    """df, written once and read again. Column order, names and types are kept; row order is not."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_plain(df: DataFrame, name: str = "stage") -> DataFrame:
    """As ``stage``, for rows whose values seldom repeat (names, hashes, ids): no dictionaries are built, as they would be
    given up or be as long as the values."""
    return stage(df, name, dictionary=False)
