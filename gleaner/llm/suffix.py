"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also
starts in a document with a smaller doc_id.

Distribution.  Each window of LENGTH bytes is routed by the least hash of the k-byte strings
inside it, which equal windows share; neighbouring windows of one least hash travel together
as one segment.  First only the hashes are exchanged, once for each chunk of documents, to
learn which occur in two documents at all.  Segments of those go to blocks, equal segments
once for each chunk with their smallest doc_id, and are one text there; where a hash has
several texts, the suffix array finds the windows that they share.  A block holds every
occurrence of its windows, so its suffix array settles them for the whole corpus, and the
array of any block stays small however large the corpus is.

Suffix array of a block, by the difference cover {1, 2} modulo 3: triples at sampled places
are sorted and named, the ranks of the names are found by recursion until names are unique
or reach over LENGTH bytes, the remaining suffixes are merged in by their first symbol and a
sampled rank, and windows that stand side by side with equal prefixes are one string.

Defined results: matches never cross documents; a null text is empty; documents shorter than
LENGTH keep all; rows of one doc_id do not remove from each other; a null doc_id counts as
smaller than any other; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 50
CHUNK_BYTES, PART_BYTES, BLOCK_BYTES = 6 << 20, 1 << 20, 1 << 16
LEAST = -(1 << 63)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ---- suffix array -----------------------------------------------------------------------


def _names(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, bool]:
    """Dense names from 1 of rows of symbols, in their order, and whether all differ."""
    key = columns[0]
    used = bits
    for c in columns[1:]:
        if used + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
            used = max(1, int(key.max(initial=0)).bit_length())
        key = key << bits | c
        used += bits
    order = np.argsort(key)
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(fresh)
    return out, bool(fresh.all())


def suffix_ranks(s: np.ndarray, need: int) -> np.ndarray:
    """Ranks of all suffixes, right on their first `need` symbols at least.  Symbols are 1 or more."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.concatenate([s, np.zeros(6, np.int64)])
    one, two = np.arange(1, n + 3 - n % 3, 3), np.arange(2, n + 2, 3)
    p = np.concatenate([one, two])
    bits = max(1, int(t.max()).bit_length())
    r12, unique = _names([t[p], t[p + 1], t[p + 2]], bits)
    if not unique and need > 3:
        r12 = suffix_ranks(r12, -(-need // 3)) + 1
    r = np.zeros(n + 6, np.int64)
    r[p] = r12
    r[n:] = 0
    rbits = max(1, int(r.max()).bit_length())
    zero, one, two = np.arange(0, n, 3), np.arange(1, n, 3), np.arange(2, n, 3)
    if 2 * bits + rbits > 63:
        both = np.unique(t[: n + 2] << bits | t[1 : n + 3], return_inverse=True)[1].astype(np.int64)
    else:
        both = t[: n + 2] << bits | t[1 : n + 3]
    k1 = lambda i: t[i] << rbits | r[i + 1]  # noqa: E731  against places of remainder 1
    k2 = lambda i: both[i] << rbits | r[i + 2]  # noqa: E731  against places of remainder 2
    z1, z2, a1, a2 = k1(zero), k2(zero), k1(one), k2(two)
    sorted_z1 = np.sort(z1)
    less = lambda of, keys: np.searchsorted(of, keys, "left")
    out = np.empty(n, np.int64)
    out[zero] = less(sorted_z1, z1) + less(np.sort(a1), z1) + less(np.sort(a2), z2)
    sampled = np.sort(np.concatenate([r[one], r[two]]))
    out[one] = less(sampled, r[one]) + less(sorted_z1, a1)
    out[two] = less(sampled, r[two]) + less(np.sort(z2), a2)
    return out


def window_groups(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place where a window can start, in order: its text's number, its offset, and a group number that equal windows share."""
    data = np.frombuffer(b"\x00".join(texts) + b"\x00" * 8, np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = data[:-7].astype(np.int64) + 2
    s[starts + sizes] = 1
    rank = suffix_ranks(s, length)
    counts = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(texts)), counts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = starts[which] + offset
    order = np.argsort(rank[place], kind="stable")
    q = place[order]
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight[: len(data) - 7] |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(0, len(q) - 1), bool)
    at = [*range(0, length - 7, 8), length - 8] if length >= 8 else None
    for k in at or range(length):
        view = eight if at else data
        i = np.flatnonzero(same)
        same[i] = view[q[i] + k] == view[q[i + 1] + k]
    group = np.empty(len(q), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(~same)])[: len(q)] if len(q) else 0
    return which, offset, group


# ---- segments ---------------------------------------------------------------------------


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length())]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    at = _TABLE[data]
    total, done, width = None, 0, 1
    while True:
        if k & width:
            part = at[done : len(data) - k + done + 1]
            total = part.copy() if total is None else total * _TABLE[200 + width.bit_length()] + part
            done += width
        if width * 2 > k:
            break
        at = at[:-width] * _TABLE[width.bit_length()] + at[width:]
        width *= 2
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m, width = x, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - width : len(x) - width + 1]) if w > width else m


def grams(length: int) -> int:
    return max(1, min(20, length // 2))


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(document, first window, last window, hash) of each segment; windows are places in data.  Works through parts of about PART_BYTES."""
    k = grams(length)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
        a, b = offsets[at], offsets[end]
        if b - a >= length:
            m = sliding_min(gram_hashes(data[a:b], k), length - k + 1)
            owner = np.repeat(np.arange(at, end), np.diff(offsets[at : end + 1]))
            inside = owner[: len(m)] == owner[length - 1 :]
            edge = np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1 : len(m)] != owner[: len(m) - 1]) | (inside[1:] != inside[:-1])])
            first = np.flatnonzero(edge)
            last = np.concatenate([first[1:], [len(m)]]) - 1
            ok = inside[first]
            yield owner[first][ok], first[ok] + a, last[ok] + a, m[first][ok]
        at = end


def _ids(column) -> np.ndarray:
    return np.array([LEAST if x is None else x for x in column.cast(pa.int64()).to_pylist()], np.int64)


def _cat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _all(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def dedup(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """The rows of docs with n_bytes, n_removed, n_spans, spans (start and end of each removed run) and kept (the other bytes).

    With characters, a run takes the characters it cuts through whole.  Columns of these five names are replaced.
    """
    spark = docs.sparkSession
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
    docs = docs.drop(*added, "_chunk")
    total = common.text_bytes(docs, text)
    chunks = common.blocks_for(total, CHUNK_BYTES, common.partitions(spark))
    buckets = common.blocks_for(total, 16 << 20, common.partitions(spark))
    columns = list(docs.columns)
    dealt = docs.withColumn("_chunk", F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).cast("int"))

    def bucketed(m: np.ndarray) -> np.ndarray:
        return ((m & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)

    def by_bucket(bucket: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return ((k, order[ends[k] : ends[k + 1]]) for k in np.unique(bucket).tolist())

    def hashes(key, t):
        """The distinct hashes of a chunk; those in two of its documents apart."""
        data, offsets = common.packed(t.column(text))
        ids = _ids(t.column(doc_id))
        ms, owners = [], []
        for owner, _, _, m in segments(data, offsets, length):
            ms.append(m)
            owners.append(owner)
        m, d = _cat(ms, np.uint64), ids[_cat(owners, np.int64)]
        order = np.argsort(m)
        m, d = m[order], d[order]
        cut = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.zeros(0, np.int64)
        several = (np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)) if len(m) else np.zeros(0, bool)
        m = m[cut]
        rows = []
        for k, i in by_bucket(bucketed(m)):
            five = lambda x: np.ascontiguousarray((x >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            rows.append((k, key[0].as_py(), five(m[i][~several[i]]), five(m[i][several[i]])))
        cols = list(zip(*rows)) or [[]] * 4
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "single": pa.array(cols[2], pa.binary()), "several": pa.array(cols[3], pa.binary())})

    def wide(b: bytes) -> np.ndarray:
        out = np.zeros((len(b) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
        return out.view("<u8").reshape(-1)

    def shared(key, t):
        """For each chunk, those of its hashes that two documents hold."""
        single, several = ([wide(x) for x in t.column(c).to_pylist()] for c in ("single", "several"))
        all_ = np.sort(np.concatenate([*single, *several]))
        twice = all_[1:][all_[1:] == all_[:-1]]
        good = np.unique(np.concatenate([twice, *several]))
        rows = []
        for c, a, b in zip(t.column("chunk").to_pylist(), single, several):
            v = np.concatenate([a, b])
            k = np.minimum(np.searchsorted(good, v), max(0, len(good) - 1))
            if len(good) and len(v := v[good[k] == v]):
                rows.append((c, np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()))
        cols = list(zip(*rows)) or [[]] * 2
        return pa.table({"chunk": pa.array(cols[0], pa.int32()), "hashes": pa.array(cols[1], pa.binary())})

    def wanted(t: pa.Table, found: pa.Table):
        """Segments of shared hashes of a chunk: (document, first, last, number) and the distinct segments in order of content."""
        data, offsets = common.packed(t.column(text))
        good = np.sort(_cat([wide(x) for x in found.column("hashes").to_pylist()], np.uint64))
        got: list[list] = [[], [], [], []]
        if len(good):
            for part in segments(data, offsets, length):
                v = part[3] >> np.uint64(24)
                k = np.minimum(np.searchsorted(good, v), len(good) - 1)
                ok = good[k] == v
                for g, x in zip(got, part):
                    g.append(x[ok])
        owner, first, last, m = (_cat(g, np.int64) for g in got)
        body = data.tobytes()
        contents = [body[a:b] for a, b in zip(first.tolist(), (last + length).tolist())]
        names = {c: k for k, c in enumerate(sorted(set(contents)))}
        number = np.array([names[c] for c in contents], np.int64)
        return data, offsets, owner, first, last, m.astype(np.uint64), number, list(names)

    def cut_out(key, t, found):
        """The distinct segments of a chunk with their smallest doc_id, dealt to blocks."""
        rows = []
        if t.num_rows and found.num_rows:
            _, _, owner, _, _, m, number, names = wanted(t, found)
            ids = _ids(t.column(doc_id))[owner]
            least = np.full(len(names), (1 << 63) - 1)
            np.minimum.at(least, number, ids)
            hash_ = np.zeros(len(names), np.uint64)
            hash_[number] = m
            for k, i in by_bucket(bucketed(hash_)):
                texts = [names[j] for j in i.tolist()]
                rows.append((k, key[0].as_py(), i.astype(np.int32).tobytes(), least[i].tobytes(), hash_[i].tobytes(), np.array([len(x) for x in texts], np.int32).tobytes(), b"".join(texts)))
        cols = list(zip(*rows)) or [[]] * 7
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip(("numbers", "docs", "hashes", "sizes", "texts"), cols[2:])})

    def settle(key, t):
        """Suffix arrays over the blocks of a bucket; answers, for each segment of each chunk, where windows' smallest doc_id changes and what it is."""
        chunk = np.repeat(t.column("chunk").to_numpy(), [len(x) // 4 for x in t.column("numbers").to_pylist()])
        numbers, docs_, hashes_, sizes = (_cat(_all(t.column(c), d), d) for c, d in (("numbers", np.int32), ("docs", np.int64), ("hashes", np.uint64), ("sizes", np.int32)))
        body, ends = b"".join(t.column("texts").to_pylist()), np.cumsum(sizes, dtype=np.int64)
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(body[e - n : e], len(known)) for e, n in zip(ends.tolist(), sizes.tolist())], np.int64)
        texts = list(known)
        least = np.full(len(texts), (1 << 63) - 1)
        np.minimum.at(least, which, docs_)
        hash_ = np.zeros(len(texts), np.uint64)
        hash_[which] = hashes_
        order = np.argsort(hash_, kind="stable")
        offs: list[np.ndarray] = [np.zeros(1, np.int32)] * len(texts)
        mins: list[np.ndarray] = list(least.reshape(-1, 1))
        # A segment that is the only text of its hash shares windows with its own copies alone, which are one text by now.
        h = hash_[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
        order = order[np.repeat(np.diff(edge) > 1, np.diff(edge))]
        long = np.cumsum([len(texts[k]) + 1 for k in order.tolist()]) if len(order) else np.zeros(0, np.int64)
        whole = np.flatnonzero(np.concatenate([[True], np.diff(hash_[order]) != 0])) if len(order) else np.zeros(0, np.int64)  # one hash stays in one block
        part = (long[whole] - 1) // BLOCK_BYTES
        cuts = [*whole[np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))].tolist(), len(order)] if len(order) else [0]
        for a, b in zip(cuts, cuts[1:]):
            own = order[a:b]
            w, o, g = window_groups([texts[k] for k in own.tolist()], length)
            best = np.full(int(g.max(initial=-1)) + 1, (1 << 63) - 1)
            np.minimum.at(best, g, least[own][w])
            d = best[g]
            change = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else np.zeros(0, np.int64)
            bounds = np.searchsorted(w[change], np.arange(len(own) + 1))
            for k, j in enumerate(own.tolist()):
                i = change[bounds[k] : bounds[k + 1]]
                offs[j], mins[j] = o[i].astype(np.int32), d[i]
        rows = []
        cut = np.flatnonzero(np.concatenate([[True], np.diff(chunk) != 0])) if len(chunk) else []
        for a, b in zip(cut, [*cut[1:], len(chunk)]):
            w = which[a:b].tolist()
            rows.append((int(chunk[a]), numbers[a:b].tobytes(), np.array([len(offs[k]) for k in w], np.int32).tobytes(), b"".join([offs[k].tobytes() for k in w]), b"".join([mins[k].tobytes() for k in w])))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table({"chunk": pa.array(cols[0], pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip(("numbers", "changes", "offsets", "docs"), cols[1:])})

    def remove(key, t, answers):
        """answers also holds the chunk's shared hashes, in rows whose numbers are null."""
        mark = pc.is_valid(answers.column("numbers"))
        found, answers = answers.filter(pc.invert(mark)), answers.filter(mark)
        data, offsets, owner, first, last, _, number, names = wanted(t, found)
        ids = _ids(t.column(doc_id))
        gone = np.zeros(len(data) + 1, np.int32)
        if len(owner):
            seg, changes, offs, docs_ = (_cat(_all(answers.column(c), d), d) for c, d in (("numbers", np.int32), ("changes", np.int32), ("offsets", np.int32), ("docs", np.int64)))
            start = np.zeros(len(names) + 1, np.int64)
            count = np.zeros(len(names), np.int64)
            at = np.cumsum(changes, dtype=np.int64) - changes
            start[seg], count[seg] = at, changes
            n = count[number]
            run = np.repeat(np.arange(len(number)), n)
            k = start[number][run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            a = first[run] + offs[k]
            final = np.concatenate([run[1:] != run[:-1], [True]])
            b = np.where(final, last[run], np.concatenate([a[1:] - 1, [0]])) + length
            use = docs_[k] < ids[owner[run]]
            np.add.at(gone, a[use], 1)
            np.add.at(gone, b[use], -1)
        out = np.cumsum(gone[:-1]) > 0
        rows: list[list] = [[] for _ in added]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            x = out[a:b]
            if characters and x.any():
                of = np.cumsum(data[a:b] & 0xC0 != 0x80)  # which character a byte belongs to
                hit = np.zeros(of[-1] + 1, bool)
                hit[of[x]] = True
                x = hit[of]
            if x.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8))).reshape(-1, 2)
                spans, kept = edges.tolist(), data[a:b][~x].tobytes()
            else:
                spans, kept = [], data[a:b].tobytes()
            for c, v in zip(rows, (b - a, b - a - len(kept), len(spans), spans, kept)):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
        return pa.table([*t.drop_columns(["_chunk"]).columns, *(pa.array(c, x) for c, x in zip(rows, types))], [*columns, *added])

    del spark
    first = dealt.groupBy("_chunk").applyInArrow(hashes, "bucket int, chunk int, single binary, several binary")
    both = first.groupBy("bucket").applyInArrow(shared, "chunk int, hashes binary")
    cut = dealt.groupBy("_chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut_out, "bucket int, chunk int, numbers binary, docs binary, hashes binary, sizes binary, texts binary")
    settled = cut.groupBy("bucket").applyInArrow(settle, "chunk int, numbers binary, changes binary, offsets binary, docs binary")
    answers = settled.withColumn("hashes", F.lit(None).cast("binary")).unionByName(both, allowMissingColumns=True)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary").fields])
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(remove, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with repeated passages taken out of text (a character cut through goes too) and n_chars counted anew; texts that lose all go."""
    done = dedup(docs, length, characters=True)
    kept = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    done = done.where("n_bytes = 0 or n_removed < n_bytes").withColumn("text", kept)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
