"""Running plans: copies, moves, links, and duplicate actions.

Side effects happen in one action over the pending rows.  Every one can run twice: a copy is
made under a temporary name beside its destination and renamed, a destination that already
proves its content counts as done, and a move deletes its source last.
"""

from __future__ import annotations

import datetime as dt
import os
import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Mode, MoveOptions, Overwrite
from ..schema import OPERATION
from ..sources.files import check_space
from ..streaming.incremental import scratch
from .scan import full_hash


def copy_atomic(source: str, dest: str, sha256: str = "") -> None:
    temp = os.path.join(os.path.dirname(dest), f".{uuid.uuid4().hex}.tmp")
    try:
        with open(source, "rb") as a, open(temp, "xb") as b:
            shutil.copyfileobj(a, b, 1 << 20)
            b.flush()
            os.fsync(b.fileno())
        shutil.copystat(source, temp)
        if sha256 and full_hash(temp) != sha256.lower():
            raise OSError("content differs from its hash")
        os.replace(temp, dest)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


def run_one(op: dict, o: MoveOptions) -> tuple[str, str | None]:
    """(status, error) of one operation."""
    src, dest = op["source"], op["destination"]
    sha = (op["hash"] or "") if o.verify else ""
    try:
        if o.verify and len(sha) != 64:
            raise OSError("no full hash to verify with")
        os.makedirs(os.path.dirname(dest), exist_ok=True)
        if os.path.lexists(dest):
            if o.overwrite == Overwrite.SKIP:
                return "skipped", "destination exists"
            if o.mode in (Mode.HARDLINK, Mode.SYMLINK):
                os.unlink(dest)
        if o.mode == Mode.HARDLINK:
            os.link(src, dest)
        elif o.mode == Mode.SYMLINK:
            os.symlink(os.path.abspath(src), dest)
        else:
            copy_atomic(src, dest, sha)
            if o.mode == Mode.MOVE:
                os.unlink(src)
        return "success", None
    except OSError as e:
        return "failed", str(e)


def execute(ops: DataFrame, o: MoveOptions, free=None) -> DataFrame:
    """OPERATION rows after the run; a dry run changes nothing.  The result is read from where it was written, never run again."""
    if o.dry_run:
        return ops
    if o.mode in (Mode.COPY, Mode.MOVE):
        need = ops.where("status = 'pending'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
        try:
            check_space(need, o.dest_root, *([free] if free else []))
        except OSError as e:
            return ops.withColumn("error", F.when(F.col("status") == "pending", F.lit(str(e)))).withColumn("status", F.when(F.col("status") == "pending", "failed").otherwise(F.col("status")))
    names = [c.split()[0] for c in OPERATION.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for op in pdf.to_dict("records"):
                start = dt.datetime.now()
                status, error = run_one(op, o)
                rows.append({**op, "status": status, "error": error, "start_time": start, "end_time": dt.datetime.now()})
            yield pd.DataFrame(rows, columns=names)

    full = ops
    for c, kind in (x.split() for x in OPERATION.split(", ")):
        full = full.withColumn(c, (F.col(c) if c in ops.columns else F.lit(None)).cast(kind))
    full = full.select(*names)
    path = f"{scratch(ops.sparkSession)}/executed-{uuid.uuid4().hex}"
    done = full.where("status = 'pending'").repartition(max(1, min(16, o.workers))).mapInPandas(run, OPERATION)
    done.write.parquet(path)
    return ops.sparkSession.read.schema(OPERATION).parquet(path).unionByName(full.where("status <> 'pending'"))


def prove_destinations(ops: DataFrame) -> DataFrame:
    """destination, dest_size, dest_sha of regular files that held still while they were read."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for d in pdf["destination"]:
                try:
                    if os.path.islink(d) or not os.path.isfile(d):
                        continue
                    a = os.stat(d)
                    sha = full_hash(d)
                    b = os.stat(d)
                    if (a.st_ino, a.st_size, a.st_mtime_ns) == (b.st_ino, b.st_size, b.st_mtime_ns):
                        rows.append((d, a.st_size, sha))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["destination", "dest_size", "dest_sha"])

    return ops.select("destination").distinct().mapInPandas(run, "destination string, dest_size long, dest_sha string")


def replace_with_link(path: str, make) -> None:
    """Puts a link in a file's place; the file comes back if that fails."""
    backup = f"{path}.{uuid.uuid4().hex}.bak"
    os.rename(path, backup)
    try:
        make()
    except OSError:
        if os.path.lexists(path):
            os.unlink(path)
        os.rename(backup, path)
        raise
    os.unlink(backup)


def dedup_one(path: str, keep: str, action: str) -> None:
    if action == "delete":
        os.unlink(path)
    elif action == "hardlink":
        if not os.path.samefile(path, keep):
            replace_with_link(path, lambda: os.link(keep, path))
    elif action == "symlink":
        replace_with_link(path, lambda: os.symlink(os.path.relpath(keep, os.path.dirname(path)), path))


def run_dedup(actions: DataFrame, action: str, dry_run: bool = True) -> DataFrame:
    """path, hash, size, error of each copy acted upon (or that would be)."""
    if dry_run or action == "dry-run":
        return actions.select("path", "hash", "size", F.lit(None).cast("string").alias("error"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            errors = []
            for p, k in zip(pdf["path"], pdf["keep_path"]):
                try:
                    dedup_one(p, k, action)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"path": pdf["path"], "hash": pdf["hash"], "size": pdf["size"], "error": errors})

    path = f"{scratch(actions.sparkSession)}/dedup-{uuid.uuid4().hex}"
    actions.mapInPandas(run, "path string, hash string, size long, error string").write.parquet(path)
    return actions.sparkSession.read.parquet(path)


def confirmed(answer: str | None, o: MoveOptions, yes: bool = False, n: int = 1) -> bool:
    """Moves and overwriting need a yes (o, oui, y, yes); no answer is a no."""
    risky = o.mode == Mode.MOVE or o.overwrite == Overwrite.OVERWRITE
    return yes or not n or not risky or (answer or "").strip().lower() in ("o", "oui", "y", "yes")
