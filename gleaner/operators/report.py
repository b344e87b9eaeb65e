"""Grouped statistics and the report's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

TOP_TYPES, ROWS, GROUPS, PATHS = 50, 1000, 20, 5


def type_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def totals(files: DataFrame) -> DataFrame:
    error = F.startswith(F.col("type"), F.lit("Error"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(error).alias("errors"), F.countDistinct(paths.dirname(F.col("path"))).alias("dirs"))


def _shares(files: DataFrame, key: Column, name: str) -> DataFrame:
    g = files.groupBy(key.alias(name)).agg(F.count("*").alias("count"), F.sum("size").alias("bytes"))
    total = g.agg(F.sum("count").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select(name, "count", "bytes", paths.readable_size(F.col("bytes")).alias("human"), paths.percent(F.col("count"), F.col("total")).alias("percent"))


def category_stats(files: DataFrame) -> DataFrame:
    return _shares(files, paths.report_category(F.col("target_path")), "category").orderBy(F.desc("count"), "category")


def type_top(files: DataFrame, n: int = TOP_TYPES) -> DataFrame:
    return _shares(files, F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")), "ext").orderBy(F.desc("count"), "ext").limit(n)


def first_rows(files: DataFrame, n: int = ROWS) -> DataFrame:
    return files.select("path", "size", paths.readable_size(F.col("size")).alias("human"), "type", paths.report_category(F.col("target_path")).alias("category")).orderBy("path").limit(n)


def render_html(files: DataFrame, groups: DataFrame | None = None, title: str = "Report") -> str:
    """A page of the collected aggregates and the first rows; all values escaped."""
    from html import escape

    def rows(df: DataFrame) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in df.collect())
        return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    parts = [("Totals", totals(files)), ("Categories", category_stats(files)), ("Types", type_top(files))]
    if groups is not None:
        parts.append(("Duplicates", groups.orderBy(F.desc("wasted_space"), "hash").limit(GROUPS).withColumn("paths", F.slice(F.array_sort("paths"), 1, PATHS))))
    parts.append(("Files", first_rows(files)))
    search = "<input oninput=\"for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())\">"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{search}" + "".join(f"<h2>{escape(h)}</h2>{rows(d)}" for h, d in parts) + "</body></html>"


def summary_text(files: DataFrame, verbose: bool = False) -> str:
    """Types with over ten files (all, if verbose), most first."""
    t = totals(files).first()
    s = type_stats(files) if verbose else type_stats(files).where("files > 10")
    return "\n".join([f"files {t['files']}, bytes {t['bytes']}, errors {t['errors']}", *(f"{r['type']}: {r['files']}" for r in s.orderBy(F.desc("files"), "type").collect())])
