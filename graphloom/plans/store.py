"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on a single machine, and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: cuts the lineage of iterations and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, with named aggregates of the rows from the same job."""
    seen = Observation()
    out = stored(df.observe(seen, *metrics))
    return out, seen.get
