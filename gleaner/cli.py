"""Command line: scan, report duplicates, plan and move."""

from __future__ import annotations

import argparse

from .config import DateLayout, MoveOptions, Mode, OrganizeOptions, Overwrite, ScanOptions, size_of, workers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    p.add_argument("-s", "--source", default="")
    p.add_argument("-e", "--export", default="")
    p.add_argument("-R", "--resume", action="store_true", help="leave out paths that the export has")
    p.add_argument("-D", "--duplicates", default="", metavar="FILE", help="write the duplicate report")
    p.add_argument("--min-size", type=size_of, default=1 << 20)
    p.add_argument("--html", default="")
    p.add_argument("--validate", default="", help="all, or a list of image, video, audio")
    p.add_argument("--organize", default="none", type=DateLayout.parse)
    p.add_argument("--precount", action="store_true")
    p.add_argument("-w", "--workers", type=int, default=4)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-M", "--move", default="", metavar="DEST")
    p.add_argument("--mode", type=Mode.parse, default=Mode.COPY)
    p.add_argument("--overwrite", type=Overwrite.parse, default=Overwrite.SKIP)
    p.add_argument("--run", action="store_true", help="without it, nothing is changed")
    p.add_argument("--verify", action="store_true")
    p.add_argument("--journal", default="")
    p.add_argument("--move-resume", action="store_true")
    p.add_argument("-y", "--yes", action="store_true")
    return p


def main(args: list[str] | None = None, answer=input) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import dedup, execute, plan, report, scan
    from .plans import moves
    from .sources import files, jsonl

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("gleaner").getOrCreate()
    n = workers(a.workers)
    if a.precount and a.source:
        print(files.count_files(spark, a.source).first().asDict())
    if a.source and not a.move:
        o = ScanOptions(hash=bool(a.duplicates), full_hash=a.verify or bool(a.journal), validate=a.validate, organize=OrganizeOptions(layout=a.organize))
        done = jsonl.read_done(spark, a.export) if a.resume and a.export else None
        rows = scan.scan(spark, a.source, o, done).persist()
        if a.export:
            jsonl.write_results(rows.drop("mtime"), a.export, append=a.resume)
        print(report.summary_text(rows, a.verbose))
        groups = None
        if a.duplicates:
            hashed = rows.select("path", "size").join(scan.staged_hashes(rows, a.min_size).select("path", "full_hash"), "path", "left")
            groups = dedup.duplicate_groups(hashed, min_size=a.min_size)
            jsonl.write_duplicate_report(dedup.duplicate_report(hashed, min_size=a.min_size), groups, a.duplicates)
        if a.html:
            with open(a.html, "w", encoding="utf-8") as f:
                f.write(report.render_html(rows, groups))
    if a.move:
        o = MoveOptions(source_root=a.source, dest_root=a.move, mode=a.mode, overwrite=a.overwrite, dry_run=not a.run, verify=a.verify, workers=n)
        ops = moves.make(spark, a.export, o)
        if a.move_resume:
            ops = moves.resume(spark, ops, a.journal, o)
        print(plan.counters(ops).first().asDict())
        for r in plan.preview(ops).collect():
            print(r["source"], "->", r["destination"])
        pending = ops.where(F.col("status") == "pending").count()
        if a.run and not execute.confirmed(None, o, a.yes, pending) and not execute.confirmed(_ask(answer), o, a.yes, pending):
            return 1
        print(moves.summary(moves.run(ops, o, a.journal or None)))
    return 0


def _ask(answer) -> str | None:
    try:
        return answer("Files will be moved or replaced. Go on? ")
    except EOFError:
        return None


if __name__ == "__main__":
    raise SystemExit(main())
