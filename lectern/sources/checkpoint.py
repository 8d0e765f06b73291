"""Checkpoints of stages: tables kept as Parquet, each whole or not there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.operators.report import STAGES


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(df: DataFrame, path: str, stage: str) -> DataFrame:
    """Writes the stage's table beside the one that is there and then takes its place, so that a reader meets either; returns it as read again."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}")
    spark, fresh = df.sparkSession, f"{path}/_{stage}-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, at = _fs(spark, path)
    fs.delete(at(f"{path}/{stage}"), True)
    if not fs.rename(at(fresh), at(f"{path}/{stage}")):
        raise OSError(f"cannot replace {path}/{stage}")
    return spark.read.schema(df.schema).parquet(f"{path}/{stage}")


def load(spark: SparkSession, path: str, stage: str) -> DataFrame | None:
    """The stage's table, None where it has not been kept."""
    fs, at = _fs(spark, path)
    return spark.read.parquet(f"{path}/{stage}") if fs.exists(at(f"{path}/{stage}")) else None


def last(spark: SparkSession, path: str) -> str | None:
    """The latest stage that has been kept, from which work can go on."""
    fs, at = _fs(spark, path)
    return next((s for s in reversed(STAGES) if fs.exists(at(f"{path}/{s}"))), None)
