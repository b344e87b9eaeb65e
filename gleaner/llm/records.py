"""Token-ID / binary output: length-delimited binary records with masked checksums.

A file ``part-NNNNN.rec`` holds frames one after the other::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian.  A payload is ``i64 doc_id | u8 flags | u8 bytes per id | ids``; flag 1
says that doc_id is null.  The checksum is CRC-32, masked by a rotation and a constant, so
that a checksum stored inside checked data does not look like one.  Beside each file,
``part-NNNNN.idx`` lists ``u64 offset, i64 doc_id, u64 first token, u64 tokens`` of each
record: a reader draws records in any order with one range read each.

Defined results: a null text is encoded as empty (its record holds the end id alone); a null
doc_id comes first; rows that repeat a doc_id are all written, one after another, ordered by
checksum of their ids; an empty table gives no files and no rows; other columns of the input
are not read.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MASK_DELTA = 0xA282EAD8
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("start", "<u8"), ("n_tokens", "<u8")])
#: Words, and runs, kept with their ids in each Python worker, and the longest word that is kept.
KEPT_WORDS, KEPT_RUNS, KEPT_CHARS = 600_000, 600_000, 48
#: Runs of a word; below this character there are no marks that compose with a letter before them.
RUNS, PLAIN_BELOW = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), "\u0100"

_tokenizers: dict[str, tuple] = {}


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    rot = (value - MASK_DELTA) & 0xFFFFFFFF
    return ((rot >> 17) | (rot << 15)) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def frames(stream, path: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame; a wrong checksum or a cut frame is an error."""
    offset = 0
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"{path}: cut frame at {offset}")
        length, crc = struct.unpack("<QI", head)
        if unmasked(crc) != zlib.crc32(head[:8]):
            raise ValueError(f"{path}: wrong length checksum at {offset}")
        body = stream.read(length + 4)
        if len(body) < length + 4 or unmasked(struct.unpack("<I", body[length:])[0]) != zlib.crc32(body[:length]):
            raise ValueError(f"{path}: wrong payload checksum at {offset}")
        yield offset, body[:length]
        offset += length + 16


def serialized(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10)


def tokenizer(path: str):
    """The tokenizer of a file, its words kept so far, and the bytes of an id; once for each worker."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        vocab = t.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        _tokenizers[path] = (t, ({}, {}), 2 if len(ends) <= 1 << 16 else 4, ends)
    return _tokenizers[path]


def encode_runs(runs: list[str], path: str) -> list[bytes]:
    """Ids of each run.  Runs are given to the library a thousand in a text, blanks between; a
    run's last token carries the end-of-word mark, by which the ids are told apart."""
    t, _, width, ends = tokenizer(path)
    out: list[bytes] = []
    for at in range(0, len(runs), 1000):
        part = runs[at : at + 1000]
        ids = np.array(t.encode(" ".join(part), add_special_tokens=False).ids, f"<u{width}")
        cut = (np.flatnonzero(ends[ids]) + 1) * width
        if len(cut) == len(part):
            data = ids.tobytes()
            out += [data[i:j] for i, j in zip([0, *cut[:-1].tolist()], cut.tolist())]
        else:  # a run of several words or none
            out += [np.array(e.ids, f"<u{width}").tobytes() for e in t.encode_batch_fast(part, add_special_tokens=False)]
    return out


def encoded(texts: list[str | bytes | None], path: str) -> list[bytes]:
    """Little-endian ids of each text.  This tokenizer lowers case, drops white space and joins
    nothing across it or between letters and other signs; so blanks part a text into words, words
    met before are looked up, new ones are parted into runs of letters, digits and signs, and the
    library encodes the runs not met before."""
    _, (kept, runs), _, _ = tokenizer(path)
    data = [x.encode() if isinstance(x, str) else x or b"" for x in texts]
    lowered = [x if b"<|" in x else x.lower() for x in data]  # of bytes: A-Z alone; "<|" may begin a special token
    words = [x.replace(b"\n", b" ").split(b" ") for x in lowered]
    found = [list(map(kept.get, ws)) for ws in words]
    new = list({w for ws, got in zip(words, found) if None in got for w, g in zip(ws, got) if g is None})
    parted: list[list[str]] = []
    odd: set[str] = set()
    for b in new:
        w = b.decode()
        if w and max(w) < PLAIN_BELOW and "'" not in w and "<" not in w:
            parted.append(RUNS.findall(w))
        else:
            parted.append([w])
            odd.add(w)
    fresh = list({r for rs in parted for r in rs if r not in runs})
    plain = [r for r in fresh if r not in odd]
    runs.update(zip(plain, encode_runs(plain, path)))
    t, width = tokenizer(path)[0], tokenizer(path)[2]
    rest = [r for r in fresh if r in odd]
    runs.update((r, np.array(e.ids, f"<u{width}").tobytes()) for r, e in zip(rest, t.encode_batch_fast(rest, add_special_tokens=False)))
    whole = {w: runs[rs[0]] if len(rs) == 1 else b"".join([runs[r] for r in rs]) for w, rs in zip(new, parted)}
    out = [b"".join(got) if None not in got else b"".join([whole[w] if g is None else g for w, g in zip(ws, got)]) for ws, got in zip(words, found)]
    for r in fresh[max(0, KEPT_RUNS - (len(runs) - len(fresh))) :]:
        del runs[r]
    for w in new[: max(0, KEPT_WORDS - len(kept))]:
        if len(w) <= KEPT_CHARS:
            kept[w] = whole[w]
    return out


def white_space_free(path: str) -> bool:
    """Whether words can be encoded one by one: the file drops white space between words."""
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s["type"] == "Split" and s.get("invert") and s["behavior"] == "Removed" and "\\s" in str(s["pattern"]) for s in steps)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(bucket, doc_id, crc, n_tokens, ids) of every document; bucket: the file that its doc_id falls in."""
    by_word = white_space_free(tokenizer_path)

    def run(batches):
        cut = np.array(bounds, np.int64)
        t, _, width, _ = tokenizer(tokenizer_path)
        end = np.array([end_id], f"<u{width}").tobytes()
        gc.freeze()  # the kept words need no walks
        for whole in batches:
            for b in common.slices(whole):
                if by_word:
                    ids = [x + end for x in encoded(common.utf8(b.column("text")), tokenizer_path)]
                else:
                    texts = b.column("text").to_pylist()
                    ids = [np.array(e.ids, f"<u{width}").tobytes() + end for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
                crc = np.array([zlib.crc32(x) for x in ids], np.int64)
                key = np.array([-(1 << 63) if x is None else x for x in b.column("doc_id").to_pylist()], np.int64)
                low, high = np.searchsorted(cut, key, "left"), np.searchsorted(cut, key, "right")
                bucket = low + np.minimum(crc * (high - low + 1) >> 32, high - low)  # equal doc_ids may fill several files
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.astype(np.int32)), b.column("doc_id"), pa.array(crc), pa.array([len(x) // width for x in ids], pa.int64()), common.binaries(ids)],
                    ["bucket", "doc_id", "crc", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket int, doc_id long, crc long, n_tokens long, ids binary")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encodes every whole text and writes record files in ascending doc_id order under path.

    Returns the manifest, also kept as Parquet in ``path/_manifest``: bucket, file, records, tokens,
    bytes.  A task that runs twice writes the same bytes under a name of its own and renames.
    """
    spark = docs.sparkSession
    n = files or min(common.partitions(spark), 10_000)
    marks = docs.select(F.col("doc_id").cast("long").alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], max(1000, 20 * n)).alias("q")).first()["q"]
    bounds = sorted(marks or []) if n > 1 else []
    width = 2 if _width(tokenizer_path) == 2 else 4
    rows = encode(docs, tokenizer_path, end_id, bounds).repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "crc")

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        current, out, index, at, tokens, temp = None, None, [], 0, 0, ""

        def close():
            out.close()
            name = f"{root}/part-{current:05d}"
            with system.open_output_stream(f"{temp}.idx") as f:
                f.write(np.array(index, INDEX).tobytes())
            for kind in ("idx", "rec"):
                system.move(f"{temp}.{kind}", f"{name}.{kind}")
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([f"part-{current:05d}.rec"]), *(pa.array([x], pa.int64()) for x in (len(index), tokens, at))], ["bucket", "file", "records", "tokens", "bytes"])

        for b in batches:
            for bucket, doc_id, k, ids in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "n_tokens", "ids"))):
                if bucket != current:
                    if out:
                        yield close()
                    current, index, at, tokens, temp = bucket, [], 0, 0, f"{root}/_{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{temp}.rec", buffer_size=1 << 20)
                data = frame(serialized(doc_id, ids, width))
                out.write(data)
                index.append((at, doc_id or 0, tokens, k))
                at, tokens = at + len(data), tokens + k
        if out:
            yield close()

    manifest = f"{path}/_manifest"
    rows.mapInArrow(run, "bucket int, file string, records long, tokens long, bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def _width(path: str) -> int:
    return tokenizer(path)[2]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file, offset) of each record, read back and checked.

    start counts the ids of all records before; ids_crc32 is over 32-bit ids whatever their width in the file.
    """
    listed = spark.read.parquet(f"{path}/_manifest").orderBy("bucket").collect()  # a row for each file, as many as write() was told
    base, todo = 0, []
    for r in listed:
        todo.append((r["file"], base))
        base += r["tokens"]
    frame_ = spark.createDataFrame(todo, "file string, base long").repartition(max(1, len(todo)))

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "file", "offset"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                rows: list[list] = [[] for _ in names]
                with system.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as f:
                    for offset, payload in frames(f, name):
                        doc_id, ids = parsed(payload)
                        for column, x in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name, offset)):
                            column.append(x)
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names)

    return frame_.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")


def read_at(path: str, file: str, order) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file in the given order of record numbers, by the offset index: shuffled reads."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    with system.open_input_stream(f"{root}/{file.removesuffix('.rec')}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with system.open_input_file(f"{root}/{file}") as f:
        for k in order:
            f.seek(int(index["offset"][k]))
            yield parsed(next(frames(f, file))[1])
