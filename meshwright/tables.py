"""Access to the input tables and to the folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixed(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table that is small by definition, to be broadcast; refused beyond so many rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows in a table that should be fixed")
    return F.broadcast(df)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    The folder is the session's spark.checkpoint.dir; only a local session without one gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="meshwright-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def name_key(name):
    """Names compare without surrounding blanks and ignoring case; a blank name has no key."""
    key = F.lower(F.trim(name))
    return F.when(key != "", key)
