"""JSONL exports, checkpoints and journals."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.journal import entry_error
from ..schema import JOURNAL, RESULT

MAX_LINE = 1 << 20


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    long = F.octet_length("value") > MAX_LINE
    return lines.withColumn("value", F.when(long, F.raise_error(F.lit("line over 1 MiB")).cast("string")).otherwise(F.col("value")))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export; blank and malformed lines and rows without a path are passed over, over-long lines are an error."""
    rows = _lines(spark, path).where(F.trim("value") != "").select(F.from_json("value", RESULT, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.select("r.*").where("path <> ''")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """As read_results() with ord: rows in file order (file, then offset in the read, so ties never occur)."""
    rows = _lines(spark, path).select(F.monotonically_increasing_id().alias("ord"), F.from_json("value", RESULT).alias("r"))
    return rows.select("ord", "r.*").where("path <> ''")


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths of an export; none if there is no such file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "path string")
    return read_results(spark, path).select("path").distinct()


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal rows; the first bad one is an error that tells what is wrong."""
    rows = _lines(spark, path).where(F.trim("value") != "").select("value", F.from_json("value", JOURNAL, {"mode": "PERMISSIVE"}).alias("r"))
    rows = rows.select("value", "r.*")
    bad = rows.select(F.substring("value", 1, 200).alias("line"), entry_error().alias("problem")).where("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(f"journal: {bad[0]['problem']}: {bad[0]['line']}")
    return rows.drop("value")


def bare(rows: DataFrame) -> DataFrame:
    """Empty strings, zeros of optional parts and empty maps as nulls, which the writer leaves out."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if f.name in ("path", "size", "type"):
            out.append(c)
        elif f.dataType.simpleString() == "string":
            out.append(F.nullif(c, F.lit("")).alias(f.name))
        elif f.dataType.simpleString().startswith("map"):
            out.append(F.when(F.size(c) > 0, c).alias(f.name))
        else:
            out.append(c)
    return rows.select(*out)


def write_results(rows: DataFrame, path: str, append: bool = False, filters: list[Column] | None = None, single: bool = False) -> None:
    for f in filters or []:
        rows = rows.where(f)
    rows = bare(rows)
    (rows.coalesce(1) if single else rows).write.mode("append" if append else "overwrite").json(path)


def by_type(*types: str) -> Column:
    return F.col("type").isin(*types)


def append_journal(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_duplicate_report(report: DataFrame, groups: DataFrame, path: str) -> None:
    """One indented JSON document: counts, and groups largest waste first."""
    doc = report.first().asDict()
    doc["groups"] = [r.asDict() for r in groups.orderBy(F.desc("wasted_space"), "hash").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
