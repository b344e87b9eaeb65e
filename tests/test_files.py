import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.config import Conflict, Keep, MoveOptions, Mode, Overwrite, ScanOptions
from gleaner.functions.validate import by_error, only_corrupted, validate
from gleaner.operators import dedup, execute, plan, renames, report, scan
from gleaner.plans import moves
from gleaner.sources import files, jsonl


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"hash me")
    (root / "sub" / "b.txt").write_bytes(b"hash me")
    (root / ".hidden").write_bytes(b"# Title")
    (root / "empty").write_bytes(b"")
    big = bytes(i % 251 for i in range(262144 + 1024))
    (root / "big1.bin").write_bytes(big)
    (root / "sub" / "big2.bin").write_bytes(big)
    (root / "sub" / "big3.bin").write_bytes(big[:100_000] + b"?" + big[100_001:])
    return str(root)


def test_scan(spark, tree):
    rows = {os.path.relpath(r["path"], tree): r for r in scan.scan(spark, tree, ScanOptions(hash=True, full_hash=True, validate="all")).collect()}
    assert set(rows) == {"a.txt", "sub/b.txt", ".hidden", "empty", "big1.bin", "sub/big2.bin", "sub/big3.bin"}
    assert rows["a.txt"]["full_hash"] == hashlib.sha256(b"hash me").hexdigest() == rows["a.txt"]["quick_hash"]
    assert rows["big1.bin"]["quick_hash"] == rows["sub/big3.bin"]["quick_hash"] and rows["big1.bin"]["full_hash"] != rows["sub/big3.bin"]["full_hash"]
    assert rows["a.txt"]["type"] == "txt" and rows["a.txt"]["target_path"] == "documents/text/txt" and rows["empty"]["type"] == "unknown"
    assert files.count_files(spark, tree).first().asDict() == {"dirs": 2, "files": 7, "bytes": 263168 * 3 + 21}
    assert "txt: 2" in report.summary_text(scan.scan(spark, tree), True)


def test_staged_duplicates(spark, tree):
    found = files.files(spark, tree)
    done = scan.staged_hashes(found)
    g = dedup.duplicate_groups(done).orderBy("size").collect()
    assert [(r["size"], r["count"], r["wasted_space"]) for r in g] == [(7, 2, 7), (263168, 2, 263168)]
    acts = dedup.actions(done.withColumn("mtime", F.lit(None).cast("timestamp")), Keep.SHORTEST)
    assert dedup.action_report(acts).first()["space_saved"] == 263175
    out = execute.run_dedup(acts, "hardlink", dry_run=False)
    assert out.where("error is not null").count() == 0
    assert os.path.samefile(f"{tree}/a.txt", f"{tree}/sub/b.txt")


def test_export_and_resume(spark, tree, tmp_path):
    out = str(tmp_path / "scan.jsonl")
    first = scan.scan(spark, tree).where(~F.col("path").contains("/sub/"))
    jsonl.write_results(first.drop("mtime"), out)
    rest = scan.scan(spark, tree, done=jsonl.read_done(spark, out))
    assert rest.count() == 3
    jsonl.write_results(rest.drop("mtime"), out, append=True)
    assert jsonl.read_results(spark, out).count() == 7
    assert jsonl.read_done(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_jsonl_golden_and_bad_lines(spark, tmp_path):
    rows = spark.createDataFrame([("photo.jpg", 0, "jpg", ""), ("video.mp4", 0, "mp4", "")], "path string, size long, type string, error string")
    out = str(tmp_path / "o")
    jsonl.write_results(rows, out, filters=[jsonl.by_type("jpg")], single=True)
    assert [r["value"] for r in spark.read.text(out).collect()] == ['{"path":"photo.jpg","size":0,"type":"jpg"}']
    bad = tmp_path / "c.jsonl"
    bad.write_text('{"path":"a.jpg"}\nnot-json\n\n{"other":true}\n{"path":"b.jpg"}\n')
    assert sorted(r["path"] for r in jsonl.read_done(spark, str(bad)).collect()) == ["a.jpg", "b.jpg"]


def test_plan_copy_journal_resume(spark, tmp_path):
    src, dest = tmp_path / "s", tmp_path / "d"
    src.mkdir()
    (src / "source.txt").write_bytes(b"content")
    sha = hashlib.sha256(b"content").hexdigest()
    line = {"path": f"{src}/source.txt", "size": 7, "type": "txt", "target_path": "documents", "full_hash": sha}
    export = tmp_path / "e.jsonl"
    export.write_text(json.dumps(line) + "\n")
    o = MoveOptions(source_root=str(src), dest_root=str(dest), dry_run=False, verify=True)
    ops = moves.make(spark, str(export), o)
    done = moves.run(ops, o, str(tmp_path / "journal"))
    assert moves.summary(done) == "succeeded 1, resumed 0, failed 0, skipped 0, bytes 7"
    assert (dest / "documents" / "source.txt").read_bytes() == b"content" and (src / "source.txt").exists()
    again = moves.resume(spark, ops, str(tmp_path / "journal"), o).first()
    assert (again["resumed"], again["unverified"], again["status"]) == (True, False, "success")
    (dest / "documents" / "source.txt").write_bytes(b"CONTENT")
    again = moves.resume(spark, ops, str(tmp_path / "journal"), o).first()
    assert (again["resumed"], again["unverified"], again["status"]) == (False, True, "pending")
    for target in ("../outside.txt", "/abs"):
        export.write_text(json.dumps(line | {"target_path": target}) + "\n")
        with pytest.raises(ValueError):
            moves.make(spark, str(export), o)
    with pytest.raises(ValueError):
        files.check_roots(str(src), str(src / "in"))
    with pytest.raises(OSError, match="100 available"):
        files.check_space(101, str(tmp_path), lambda p: 100)


@pytest.mark.parametrize("change", [{"schema_version": 2}, {"timestamp": None}, {"action": "burn"}, {"size": -1}, {"status": "pending"}, {"sha256": "abc"}])
def test_journal_is_strict(spark, tmp_path, change):
    good = {"schema_version": 1, "timestamp": "2024-01-01T00:00:00Z", "action": "copy", "source": "a", "destination": "b", "size": 1, "sha256": "a" * 64, "status": "success"}
    p = tmp_path / "j.jsonl"
    p.write_text(json.dumps(good) + "\n")
    assert jsonl.read_journal(spark, str(p)).count() == 1
    p.write_text(json.dumps(good) + "\n" + json.dumps(good | change) + "\n")
    with pytest.raises(ValueError):
        jsonl.read_journal(spark, str(p))


def test_rename_conflicts_dodge_natural_names(spark):
    names = ["/o/a.jpg", "/o/a.jpg", "/o/a_001.jpg", "/o/a.jpg", "/o/b.jpg", "/o/a_001.jpg", "/p/a.jpg"]
    rows = spark.createDataFrame([(k, n, n, 1, "", "jpg", "c") for k, n in enumerate(names)], "ord long, source string, destination string, size long, hash string, type string, category string")
    got = [r["destination"] for r in plan.renamed(rows).orderBy("ord").collect()]
    assert len(set(got)) == len(got)
    assert got == ["/o/a.jpg", "/o/a_001.jpg", "/o/a_001_001.jpg", "/o/a_002.jpg", "/o/b.jpg", "/o/a_001_002.jpg", "/p/a.jpg"]
    r = spark.createDataFrame([(1, "photos", "image", ".jpg", ""), (2, "photos", "image", ".jpg", ""), (3, "photos", "image_0003", ".jpg", ""), (4, "photos", "image", ".jpg", "")], "ord long, target_dir string, name string, ext string, hash string")
    out = [(x["new_name"], x["conflict"]) for x in renames.resolved(r, Conflict.INCREMENT).orderBy("ord").collect()]
    assert out == [("image.jpg", False), ("image_0002.jpg", True), ("image_0003.jpg", False), ("image_0004.jpg", True)]
    stamped = renames.resolved(r.limit(2), Conflict.TIMESTAMP, "101112_345").orderBy("ord").collect()
    assert stamped[1]["new_name"] == "image_101112_345.jpg"


def test_validation_frame(spark, tree):
    rows = validate(files.files(spark, tree).select(F.col("path")).union(spark.createDataFrame([(f"{tree}/none.jpg",)], "path string")))
    assert only_corrupted(rows).count() == 2  # the empty file and the missing one
    assert {r["type"]: r["files"] for r in by_error(rows).collect()} == {"empty": 1, "access_error": 1}


def test_html_escapes(spark):
    rows = spark.createDataFrame([("<b>.txt", 5, "txt", "documents")], "path string, size long, type string, target_path string")
    page = report.render_html(rows)
    assert "&lt;b&gt;.txt" in page and "<b>.txt" not in page


@pytest.mark.parametrize("mode, over, yes, text, n, want", [("copy", "skip", False, None, 1, True), ("move", "skip", False, "oui", 1, True), ("move", "skip", False, "no", 1, False), ("copy", "overwrite", False, None, 1, False), ("move", "skip", True, None, 1, True), ("move", "skip", False, None, 0, True), ("copy", "overwrite", False, " Y ", 1, True)])
def test_confirmation(mode, over, yes, text, n, want):
    assert execute.confirmed(text, MoveOptions(mode=Mode(mode), overwrite=Overwrite(over)), yes, n) is want


def test_links_are_rolled_back(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"x")

    def fail():
        raise OSError("no")

    with pytest.raises(OSError):
        execute.replace_with_link(str(p), fail)
    assert p.read_bytes() == b"x"


def test_incremental_takes_files_once(spark, tmp_path):
    from gleaner.streaming.incremental import new_files

    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"path":"a"}\n')
    args = (spark, str(src), "path string", str(tmp_path / "t"), str(tmp_path / "st"))
    assert new_files(*args).count() == 1
    (src / "2.json").write_text('{"path":"b"}\n{"path":"c"}\n')
    assert new_files(*args).count() == 3
    assert new_files(*args).count() == 3


def test_command_line(spark, tree, tmp_path, capsys):
    from gleaner import cli

    out = str(tmp_path / "x.jsonl")
    assert cli.main(["-s", tree, "-e", out, "-D", str(tmp_path / "d.json"), "--min-size", "1", "--html", str(tmp_path / "r.html"), "-v"]) == 0
    assert json.loads((tmp_path / "d.json").read_text())["duplicate_groups"] == 2
    assert cli.main(["-s", tree, "-e", out, "-M", str(tmp_path / "dest"), "--run"]) == 0
    assert "succeeded 7" in capsys.readouterr().out


def test_quick_hash_is_kept_only_for_unchanged_files(spark, tree):
    rows = scan.scan(spark, tree, ScanOptions(hash=True)).select("path", "size", "mtime", "quick_hash").persist()
    assert rows.count() == 7
    assert dedup.duplicate_groups(scan.staged_hashes(rows)).count() == 2
    with open(f"{tree}/a.txt", "wb") as f:
        f.write(b"HASH ME")
    os.utime(f"{tree}/a.txt", (1, 1))
    assert dedup.duplicate_groups(scan.staged_hashes(rows)).count() == 1


def test_rename_contexts(spark, tree):
    rows = scan.scan(spark, tree, ScanOptions(hash=True)).withColumn("ord", F.hash("path"))
    c = renames.sequenced(renames.contexts(rows), "ord")
    names = {r["new_name"] for r in renames.applied(c, "{original}_{hash:4}.{ext}").collect()}
    sha = hashlib.sha256(b"hash me").hexdigest()[:4]
    assert f"a_{sha}.txt" in names and len({r["seq"] for r in c.collect()}) == 7
