"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a folder of our own, which serves a single machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quadloom-work-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """df as Parquet in the workspace, read again: its lineage is cut and its blanks and random values are fixed."""
    path = f"{workspace(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_predicate(quads: DataFrame) -> DataFrame:
    """Quads as Parquet in a folder for each predicate, so that a pattern with a constant one reads its own files only."""
    path = f"{workspace(quads.sparkSession)}/quads-{uuid.uuid4().hex}"
    quads.write.partitionBy("p").parquet(path)
    return quads.sparkSession.read.schema("s string, o string, g string, p string").parquet(path).select("s", "p", "o", "g")
