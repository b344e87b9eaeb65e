"""Incremental runs: each input file is taken once, whatever is interrupted."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (found or f"file://{os.path.join(tempfile.gettempdir(), 'gleaner-checkpoints')}").rstrip("/")


def available(spark: SparkSession, source: DataFrame, out: str, state: str) -> None:
    """Appends what a streaming source has now to a Parquet table, once and for all."""
    source.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def new_files(spark: SparkSession, folder: str, schema, out: str, state: str, fmt: str = "json") -> DataFrame:
    """A table of everything in a folder of exports, extended by the files that came since the last call."""
    available(spark, spark.readStream.schema(schema).format(fmt).load(folder), out, state)
    return spark.read.schema(schema).parquet(out)


def available_counts(spark: SparkSession, path: str) -> DataFrame:
    """Events counted by type, read incrementally into a table first."""
    at = f"{scratch(spark)}/events-{uuid.uuid4().hex}"
    cols = spark.read.parquet(path).select("event_type", "user_id").schema
    glob = re.sub(r"(\w)(\.\w+)$", r"[\1]\2", path)  # a pattern, so that a single file will do
    rows = new_files(spark, glob, cols, f"{at}/table", f"{at}/state", "parquet")
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("user_id").alias("users"))
