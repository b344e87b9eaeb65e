"""Move and copy plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MoveOptions, Overwrite
from ..functions import paths


def included(o: MoveOptions) -> Column:
    """Which rows a plan takes."""
    keep = F.lit(True)
    if o.skip_corrupted:
        keep = keep & F.coalesce(F.col("valid"), F.lit(True))
    if o.skip_small > 0:
        keep = keep & (F.col("size") >= o.skip_small)
    if o.exclude:
        keep = keep & ~F.lower("type").isin([x.lower() for x in o.exclude])
    if o.only:
        keep = keep & F.lower("type").isin([x.lower() for x in o.only])
    return keep


def normalized(path: Column) -> Column:
    """Lexical clean-up without `..`: repeated slashes and `.` segments."""
    p = F.regexp_replace(path, "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"(.)/\.?$", "$1")


def violation(o: MoveOptions) -> Column:
    """Why a row's paths are unsafe; null if they are fine (links need the host, see sources.files)."""
    src, target = F.col("path"), F.coalesce(F.col("target_path"), F.lit(""))
    up = r"(^|/)\.\.(/|$)"
    out = F.when(F.coalesce(src, F.lit("")) == "", "empty source")
    if o.source_root:
        out = out.when(F.rlike(src, F.lit(up)) | ~paths.within(normalized(src), o.source_root), "source outside the root")
    return out.when(target.startswith("/"), "absolute target").when(F.rlike(target, F.lit(up)), "target leaves the destination")


def destination(o: MoveOptions) -> Column:
    base = paths.basename(F.col("path"))
    target = F.nullif("target_path", F.lit(""))
    folder = F.concat_ws("/", target, base) if o.append_basename else target
    rel = F.coalesce(F.when(target.isNotNull(), folder), F.concat_ws("/", paths.coarse_kind(F.col("type")), base))
    return F.concat(F.lit(o.dest_root.rstrip("/") + "/"), rel) if o.dest_root else rel


def operations(files: DataFrame, o: MoveOptions, ord_: str = "ord") -> DataFrame:
    """ord, source, destination, size, hash, type, category, conflict, status: before and after conflicts.

    skip: the first row of a destination stays pending.  overwrite: all stay.  rename: later rows
    take the first free `_NNN` name; the fold runs over one folder at a time and only over folders
    that have a conflict, all other rows never leave the JVM.
    """
    rows = files.where(included(o)).select(F.col(ord_).alias("ord"), F.col("path").alias("source"), destination(o).alias("destination"), "size", F.col("full_hash").alias("hash"), "type", paths.plan_category(F.col("target_path")).alias("category"))
    w = Window.partitionBy("destination").orderBy("ord")
    if o.overwrite == Overwrite.RENAME:
        return renamed(rows)
    rows = rows.withColumn("conflict", F.row_number().over(w) > 1)
    skip = F.col("conflict") if o.overwrite == Overwrite.SKIP else F.lit(False)
    return rows.withColumn("status", F.when(skip, "skipped").otherwise("pending"))


def renamed(rows: DataFrame) -> DataFrame:
    """Conflicts renamed in order of ord, dodging names that occur by themselves before.

    A family is a folder, a name without trailing numbers, and an extension; names made from one
    family clash with nothing else.  Where a family has one destination, numbers follow from the
    rank alone; the sequential fold runs only where natural names could be in the way.
    """
    dest = F.col("destination")
    stem = F.regexp_replace(paths.stem(dest), r"(_\d{3,})+$", "")
    rows = rows.withColumn("family", F.concat_ws("\0", paths.dirname(dest), stem, paths.extension(dest)))
    families = rows.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("destination").alias("names"))
    fold_ = families.where("names > 1 and n > names").select("family")
    rank = F.row_number().over(Window.partitionBy("destination").orderBy("ord"))
    easy = rows.join(fold_, "family", "left_anti").drop("family").withColumn("k", rank)
    base, ext = paths.stem(dest), paths.extension(dest)
    head = F.substring(dest, F.lit(1), F.length(dest) - F.length(base) - F.length(ext))
    number = F.when(F.col("k") > 1000, (F.col("k") - 1).cast("string")).otherwise(F.lpad((F.col("k") - 1).cast("string"), 3, "0"))
    plain = easy.withColumn("conflict", F.col("k") > 1).withColumn("destination", F.when(F.col("k") > 1, F.concat(head, base, F.lit("_"), number, ext)).otherwise(dest)).drop("k")
    hard = rows.join(fold_, "family", "left_semi")
    columns = hard.drop("family").columns
    schema = hard.select(*columns, F.lit(False).alias("conflict")).schema

    def fold(pdf):
        pdf = pdf.sort_values("ord", kind="stable")
        used, nxt, out, hit = set(), {}, [], []
        for dest in pdf["destination"]:
            name = dest
            if dest in used:
                head, slash, base = dest.rpartition("/")
                dot = base.rfind(".")
                a, ext = (base[:dot], base[dot:]) if dot >= 0 else (base, "")
                k = nxt.get(dest, 1)
                while (name := f"{head}{slash}{a}_{k:03d}{ext}") in used:
                    k += 1
                nxt[dest] = k + 1
            hit.append(dest in used)
            used.add(name)
            out.append(name)
        return pdf.assign(destination=out, conflict=hit)[[*columns, "conflict"]]

    folded = hard.groupBy("family").applyInPandas(fold, schema)
    return plain.unionByName(folded).withColumn("status", F.lit("pending"))


def counters(ops: DataFrame) -> DataFrame:
    live = F.col("status") != "skipped"
    return ops.agg(F.count_if(live).alias("files"), F.coalesce(F.sum(F.when(live, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~live).alias("skipped"), F.count_if("conflict").alias("conflicts"), F.countDistinct(F.when(live, paths.dirname(F.col("destination")))).alias("dirs"))


def stats_by_category(ops: DataFrame) -> DataFrame:
    return ops.where("status <> 'skipped'").groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def pending_bytes(ops: DataFrame) -> DataFrame:
    """Bytes still to write; a negative size is an error, and so is overflow (ANSI)."""
    size = F.when(F.col("size") < 0, F.raise_error(F.lit("negative size")).cast("long")).otherwise(F.col("size"))
    return ops.where("status = 'pending'").agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def preview(ops: DataFrame, n: int = 20, width: int = 60) -> DataFrame:
    return ops.orderBy("ord").limit(n).select("ord", paths.elided(F.col("source"), width).alias("source"), paths.elided(F.col("destination"), width).alias("destination"))


def execution_counters(done: DataFrame) -> DataFrame:
    ok, res = F.col("status") == "success", F.coalesce(F.col("resumed"), F.lit(False))
    return done.agg(F.count_if(ok).alias("succeeded"), F.count_if(ok & res).alias("resumed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(F.when(ok & ~res, F.col("size"))), F.lit(0)).alias("bytes"))
