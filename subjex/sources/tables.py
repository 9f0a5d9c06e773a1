"""Access to the Parquet tables of a scale-factor folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from subjex.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; column pruning and filters reach the Parquet scan.

    A file with fewer splits than the cluster has cores is spread right after the
    scan (see ``spread``); the test tables are single row groups.
    """
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))
