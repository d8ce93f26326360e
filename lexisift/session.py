"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; columns and filters are pruned by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for stages that Spark can't size itself (Python stages, hash layouts).

    It follows ``spark.sql.shuffle.partitions``, which the operator of a cluster sets by the
    size of the data, and never leaves cores idle.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Hash layout by ``keys``; an explicit number, as AQE would merge small inputs into one task."""
    return df.repartition(width(df.sparkSession), *keys)


def balanced(df: DataFrame) -> DataFrame:
    """``df`` for a costly per-row stage.

    Many input files or splits already spread the work of a scan, so nothing is shuffled; only where
    a scan has fewer partitions than there are cores are its rows dealt out. Rows that come from a
    shuffle are dealt out too, as AQE may have merged them into few tasks (asking for their number
    of partitions would run that shuffle).
    """
    spark = df.sparkSession
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df.repartition(width(spark))
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(width(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the folder of ``spark.checkpoint.dir``.

    The shared folder that a cluster names is used; only where none is set (local mode) a
    temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexisift-"))
    return df.checkpoint()
