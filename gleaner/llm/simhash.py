"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the
perfect binary Golay code of length 23 (upper bits zero).  Every 23-bit word lies within
three errors of exactly one codeword, found by a syndrome table; the 12 data bits of that
codeword are its index.  One side of a comparison files a word under its own index, and the
other looks under the indices of all words within one error (about five), so that words one
error apart meet.  Of at most three errors over three segments, either a segment has none,
and then another has at most one: the key is the first as it stands and the index of the
second.  Or each has one: the key is the indices of the first two and one half of the third,
of which one half has no error.  Any two linked fingerprints meet under one of these eight
keys of 33 bits or more.  Distances are then verified.

Equal fingerprints are one node from the start, so that copies never meet as pairs.  Within
a key, members are compared in blocks with a union-find, and only the edges of a spanning
forest leave the task.  Keys with more than BLOCK members are dealt out as pairs of blocks.

Similarity of shingle sets (similar_groups) goes by the same links between fingerprints, of the
sets, and then compares the sets that these bring together.  As similar sets may be more than
three bits apart, an exact way for the rest joins groups of links: in one order of all shingles,
the frequent ones last, two similar sets share one of the first few of each (a prefix).

Defined results: null and empty texts have no shingles and the fingerprint zero, linked like
any other; fewer words than a shingle make one shingle; a text whose doc_id is null links
others and gets their component, but is never the smallest of a group that has a doc_id
(component_id is null where none has); repeated rows share their fingerprint; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (segment without error, segment with one at most)
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
HALF = 11
BLOCK = 2048
#: Edges that one task joins; more go through rounds, which cost the driver some ten jobs and plans each.
LOCAL = 1 << 16


@functools.cache
def golay_index() -> np.ndarray:
    """The index (12 data bits) of the nearest codeword of every 23-bit word."""
    error = np.zeros(1 << 11, np.uint32)

    def syndrome(rest: np.ndarray) -> np.ndarray:
        for k in range(22, 10, -1):
            rest = np.where(rest >> k & 1, rest ^ np.uint32(GENERATOR << (k - 11)), rest)
        return rest

    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[i + 1 :], i + 1) for c in bits[j + 1 :]]
    patterns = np.array(patterns, np.uint32)
    error[syndrome(patterns)] = patterns
    index = np.empty(1 << 23, np.int16)
    for at in range(0, 1 << 23, 1 << 18):  # a whole column of words would take a worker 200 MB
        words = np.arange(at, at + (1 << 18), dtype=np.uint32)
        index[at : at + (1 << 18)] = (words ^ error[syndrome(words)]) >> 11
    return index


def near_indices(x: np.ndarray) -> np.ndarray:
    """Indices of every word within one error of each x: shape (len(x), 24), repeats left in."""
    flips = np.array([0, *(1 << i for i in range(23))], np.uint32)
    return golay_index()[x[:, None].astype(np.uint32) ^ flips]


def segment(fp: np.ndarray, k: int) -> np.ndarray:
    at, width = SEGMENTS[k]
    return (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    ws = text.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ws) - words + 1)
    h64 = xxhash.xxh64_intdigest
    last = ends[min(words, len(ws)) - 1 :]
    total, ones = 0, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([h64(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + (1 << 15))].tolist(), last[at : at + (1 << 15)].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""

    def run(batches):
        for whole in batches:
            for b in common.slices(whole):
                fp = np.array([fingerprint(x, words, seed) for x in common.utf8(b.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, probe, node, fp): one filed row and the probing rows of each fingerprint, for each of the eight kinds of key."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                node, fp = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp"))
                seg = [segment(fp.view(np.uint64), k) for k in range(3)]
                filed = [golay_index()[s].astype(np.int64) for s in seg]
                near = [near_indices(s).astype(np.int64) for s in seg]
                whole_ = [x.astype(np.int64) for x in seg]
                kinds = [((whole_[i] << 12), filed[j], near[j]) for i, j in PAIRS]
                both = near[0][:, :, None] << 12 | near[1][:, None, :]
                for half in (whole_[2] & (1 << HALF) - 1, whole_[2] >> HALF):
                    kinds.append((half << 24, filed[0] << 12 | filed[1], both.reshape(len(fp), -1)))
                for kind, (exact, own, around) in enumerate(kinds):
                    exact = exact | kind << 40
                    keys = np.sort(around, axis=1)
                    fresh = np.ones(keys.shape, bool)
                    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, _ = np.nonzero(fresh)
                    key = np.concatenate([exact | own, exact[row] | keys[fresh]])
                    row = np.concatenate([np.arange(len(fp)), row])
                    probe = np.arange(len(key)) >= len(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(probe), pa.array(node[row]), pa.array(fp[row])], ["key", "probe", "node", "fp"])

    return nodes.mapInArrow(run, "key long, probe boolean, node long, fp long")


def linked(filed_fp: np.ndarray, filed: np.ndarray, probe_fp: np.ndarray, probe: np.ndarray, most: int) -> set[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within most bits, smaller node first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    edges = set()
    for at in range(0, len(filed), 256):
        part = filed_fp[at : at + 256]
        a, b = np.nonzero(np.bitwise_count(part[:, None] ^ probe_fp[None, :]) <= most)
        for x, y in zip(filed[at + a].tolist(), probe[b].tolist()):
            if x != y and (u := find(x)) != (v := find(y)):
                root[max(u, v)] = min(u, v)
                edges.add((min(x, y), max(x, y)))
    return edges


def links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b) edges between node ids that connect all fingerprints within most (up to 3) bits."""
    if not 0 <= most <= 3:
        raise ValueError("three segments with one error each find distances up to 3")
    rows = common.written(keyed(nodes), "simhash-keys")
    sizes = rows.groupBy("key").agg(F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("n_filed"), F.sum(F.when(F.col("probe"), 1).otherwise(0)).alias("n_probe"))
    # A key that holds one fingerprint (which probes its own key) links nothing.
    sizes = sizes.where("n_filed > 0 and n_probe > 1").select("key", F.ceil(F.col("n_filed") / BLOCK).cast("int").alias("f"), F.ceil(F.col("n_probe") / BLOCK).cast("int").alias("g"))
    r = rows.join(sizes, "key")
    own = F.pmod(F.hash("node"), F.when(F.col("probe"), F.col("g")).otherwise(F.col("f")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("f")).otherwise(F.col("g")) - 1))
    small = r.where("f = 1 and g = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "probe", "node", "fp")
    large = r.where("f > 1 or g > 1").withColumn("own", own).withColumn("other", other)
    large = large.select("key", F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")).alias("j"), "probe", "node", "fp")

    def run(batches):
        """Sorted rows of a partition, a group at a time, whatever the batches' edges."""
        held: list[tuple] = []

        def group(cols):
            key, probe, node, fp = cols
            out: set = set()
            cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                q = probe[a:b]
                if q.any() and not q.all():
                    out |= linked(fp[a:b][~q], node[a:b][~q], fp[a:b][q], node[a:b][q], most)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        def joined():
            return [np.concatenate(x) for x in zip(*held)]

        for b in batches:
            c = [b.column(x).to_numpy(zero_copy_only=False) for x in ("key", "i", "j", "probe", "node", "fp")]
            if not b.num_rows:
                continue
            held.append((np.stack(c[:3], axis=1), c[3], c[4], c[5].view(np.uint64)))
            key, probe, node, fp = joined()
            last = np.any(key != key[-1], axis=1)
            k = len(key) - int(np.argmin(last[::-1] == False)) if last.any() else 0  # noqa: E712  where the last group starts
            if k:
                yield group((key[:k], probe[:k], node[:k], fp[:k]))
            held[:] = [(key[k:], probe[k:], node[k:], fp[k:])]
        if held:
            yield group(joined())

    n = common.partitions(nodes.sparkSession)
    found = small.unionByName(large).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()
    found._scratch = rows._scratch  # for common.dropped, once the links are written
    return found


def forest(edges: DataFrame) -> DataFrame:
    """(node, component) by a union-find over all edges (u, v) in one task, for up to LOCAL of them."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = y
            return x

        for b in batches:
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                u, v = find(x), find(y)
                root[max(u, v)] = min(u, v)
        for x in sorted(root):  # a root is less than what hangs on it
            root[x] = root[root[x]]
        node = np.fromiter(root, np.int64, len(root))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.fromiter(root.values(), np.int64, len(root)))], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with edges.

    Up to LOCAL edges are joined in one task.  More go through rounds of large-star and small-star,
    each written to the shared folder, until every node has one edge, to a node without any below it.
    """
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    while edges.count() > LOCAL:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        star = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        j = star.join(low, "u")
        fresh = common.written(j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(j.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        common.dropped(edges)
        edges = fresh
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 and down > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
    return forest(edges)


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest doc_id reachable over links."""
    prints = common.written(fingerprints(docs, words, seed), "simhash")
    # A node is its fingerprint, so that one whose only doc_id is null links others too.
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), most))
    comp = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    comp = common.written(comp, "simhash-groups")
    first = comp.groupBy("group").agg(F.min("least").alias("component_id"))
    comp = comp.join(first, "group").select("fp", "component_id")
    return prints.join(comp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similarity of shingle sets ---------------------------------------------------------

ALL_PAIRS = 8
#: Rows whose shingles are counted to find the frequent ones, and how many of those at most are told to all tasks.  Any order gives the same links; this one makes few pairs.
SAMPLED, FREQUENT = 20_000, 1 << 20
#: The most bits of a set's parities; fewer bits than shingles only weaken the bound.
WIDEST = 1 << 14


def shingles(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """The set of word shingles, as sorted 64-bit hashes."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.int64)
    h64, k = xxhash.xxh64_intdigest, min(words, len(ws))
    h = np.array([h64(w, seed) for w in ws], np.uint64)
    n = len(ws) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = (x ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique((x ^ x >> np.uint64(32)).view(np.int64))


def set_name(found: np.ndarray, seed: int = 42) -> int:
    """A signed 64-bit name of a set of shingles: texts of equal sets are one node."""
    x = xxhash.xxh3_64_intdigest(found.tobytes(), seed)
    return x - (1 << 64) if x >> 63 else x


def majority(found: np.ndarray) -> int:
    """The fingerprint of a set of shingles, signed: a bit is set if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def parities(found: np.ndarray) -> bytes:
    """One bit for each bin of shingles: whether it holds an odd number.  Bins are a power of two, no fewer than the shingles up to WIDEST."""
    width = min(WIDEST, 1 << max(6, (len(found) - 1).bit_length()))
    odd = np.bincount(found & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many bits the parities of row p of (x, i) and row q of (y, j) (bytes, and where each row starts) differ in, the wider one folded.

    A shingle of one set alone changes one bit, so the sets differ in no fewer shingles.
    """
    wide = np.stack([i[p + 1] - i[p], j[q + 1] - j[q]], axis=1)
    out = np.zeros(len(wide), np.int64)
    for u, v in np.unique(wide, axis=0).tolist():
        same = np.flatnonzero((wide == (u, v)).all(axis=1))
        step = max(1, (1 << 20) // max(u, v))
        for k in (same[at : at + step] for at in range(0, len(same), step)):
            sides = []
            for data, start, w in ((x, i[p[k]], u), (y, j[q[k]], v)):
                bits = data[start[:, None] + np.arange(w)].view("<u8")
                while bits.shape[1] > min(u, v) // 8:
                    half = bits.shape[1] // 2
                    bits = bits[:, :half] ^ bits[:, half:]
                sides.append(bits)
            out[k] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return out


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many bits the parities of each row's two sets differ in."""
    row = np.arange(len(a))
    return apart(*common.packed(a), *common.packed(b), row, row)


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node (the name of the text's set of shingles), the set's size n, its fingerprint and its parities."""

    def run(batches):
        for whole in batches:
            for b in common.slices(whole):
                got = [shingles(x, words) for x in common.utf8(b.column("text"))]
                node, n = pa.array([set_name(x) for x in got], pa.int64()), pa.array([len(x) for x in got], pa.int32())
                fp = pa.array([majority(x) for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), node, n, fp, common.binaries([parities(x) for x in got])], ["doc_id", "node", "n", "fp", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n int, fp long, bits binary")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node (the name of the text's set of shingles) and the set."""

    def run(batches):
        for whole in batches:
            for b in common.slices(whole):
                got = [shingles(x, words) for x in common.utf8(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([set_name(x) for x in got], pa.int64()), common.binaries([x.tobytes() for x in got])], ["doc_id", "node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, shingles binary")


def prefixes(docs: DataFrame, words: int, ratio: Fraction) -> DataFrame:
    """(key, node, n, place): the first shingles of each set, of which similar sets share one.

    Of n shingles a similar set holds at least ratio * n, so that it lacks at most the rest, and
    one more than those is enough.  place is where in the order of the set a shingle stands.
    """

    def flat(batches):
        for whole in batches:
            for b in common.slices(whole):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x, words) for x in common.utf8(b.column("text"))]))], ["key"])

    part = max(1, docs.count() // SAMPLED)
    counts = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text").mapInArrow(flat, "key long").groupBy("key").count()
    counts = common.written(counts.where("count > 2"), "shingle-counts")
    # The least count that no more than FREQUENT shingles reach: no task sorts or holds them all.
    sizes = sorted(((x["count"], x["n"]) for x in counts.groupBy("count").agg(F.count("*").alias("n")).collect()), reverse=True)
    reach = np.cumsum([0, *(n for _, n in sizes)])[1:]
    least = min((c for (c, _), n in zip(sizes, reach.tolist()) if n <= FREQUENT), default=None)
    counts_, counts = counts, counts.where(F.col("count") >= least if least else F.lit(False)).toArrow().sort_by("key")
    common.dropped(counts_)
    frequent = docs.sparkSession.sparkContext.broadcast((counts.column("key").to_numpy(), counts.column("count").to_numpy()))
    del counts
    common.freed(docs.sparkSession)

    def run(batches):
        known, count = frequent.value
        for whole in batches:
            for b in common.slices(whole):
                got = [shingles(x, words) for x in common.utf8(b.column("text"))]
                h, n = np.concatenate(got), np.array([len(x) for x in got])
                row = np.repeat(np.arange(len(n)), n)
                seen = np.zeros(len(h), np.int64)
                if len(known):
                    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    seen = np.where(known[k] == h, count[k], 0)
                order = np.argsort(row << 40 | seen, kind="stable")
                place = np.arange(len(h)) - (np.cumsum(n) - n)[row]
                ok = place < (n + 1 - -(-n * ratio.numerator // ratio.denominator))[row]
                row, node = row[ok], np.array([set_name(x) for x in got], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[order[ok]]), pa.array(node[row]), pa.array(n[row], pa.int32()), pa.array(place[ok], pa.int32())], ["key", "node", "n", "place"])

    return docs.select("text").mapInArrow(run, "key long, node long, n int, place int")


def by_size(x: np.ndarray, y: np.ndarray, t: dict, ratio: Fraction) -> np.ndarray:
    """Whether the sets of rows x and y can be similar: they share no more than what is left of each from the first common shingle on.

    t holds columns: node, n, left, and bits and start (the parities, packed).
    """
    return np.minimum(t["left"][x], t["left"][y]) * (ratio.numerator + ratio.denominator) >= (t["n"][x] + t["n"][y]) * ratio.numerator


def by_parities(x: np.ndarray, y: np.ndarray, t: dict, ratio: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (x, y) whose sets can be similar by their parities, and in how many bits those differ."""
    bits = apart(t["bits"], t["start"], t["bits"], t["start"], x, y)
    near = bits * (ratio.numerator + ratio.denominator) <= (ratio.denominator - ratio.numerator) * (t["n"][x] + t["n"][y])
    return x[near], y[near], bits[near]


def compared(one: np.ndarray, two: np.ndarray, alone: bool, t: dict, ratio: Fraction, wanted):
    """Pairs of a row of one and a row of two as by_parities gives them, of 256 rows of one at a time.

    alone: one and two are the same rows.  wanted(x, y) tells the pairs that need a look.
    """
    for p in (one[at : at + 256, None] for at in range(0, len(one), 256)):
        ok = by_size(p, two, t, ratio) & wanted(p, two)
        if alone:
            ok &= t["node"][p] < t["node"][two]
        x, y = np.nonzero(ok)
        yield by_parities(p[x, 0], two[y], t, ratio)


def merged(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root, a label for each row, after the labels of the rows of each pair (x, y) are made one, the least."""
    while (u := root[x]).size and (differ := u != (v := root[y])).any():
        names, place = np.unique(root, return_inverse=True)
        least = names.copy()
        np.minimum.at(least, np.searchsorted(names, np.maximum(u, v)[differ]), np.minimum(u, v)[differ])
        root = least[place]
    return root


def dealt(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows with i, j and second: those of a key in pairs of blocks, of which a task sees both."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.hash("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("second", F.col("own") > F.col("other")).drop("blocks", "own", "other")
    return rows.repartition(common.partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def groups_of(t: pa.Table, key: str, least: int = 1):
    """(one, two, alone) row numbers of each pair of blocks, of so many rows at least, in a table from dealt()."""
    k = np.stack([t.column(c).to_numpy() for c in (key, "i", "j")], axis=1)
    second = t.column("second").to_numpy()
    cut = np.concatenate([[0], np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1, [len(k)]])
    big = np.flatnonzero(np.diff(cut) >= least)
    for a, b in zip(cut[big].tolist(), cut[big + 1].tolist()):
        one, alone = np.flatnonzero(~second[a:b]) + a, bool(k[a, 1] == k[a, 2])
        yield one, one if alone else np.flatnonzero(second[a:b]) + a, alone


def crowd_columns(b: pa.Table) -> dict:
    t = {c: b.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "place", "label")}
    t["bits"], t["start"] = common.packed(b.column("bits"))
    return t | {"left": t["n"] - t["place"]}


def crowd_rows(rows: DataFrame) -> DataFrame:
    return dealt(rows, "key", F.ceil(F.col("crowd") / BLOCK)).select("key", "i", "j", "second", "node", "n", "place", "label", "bits")


def crowd_pairs(rows: DataFrame, ratio: Fraction) -> DataFrame:
    """(a, b) nodes, a the smaller, that meetings() finds near: all pairs, for tests; their number grows with the square of a key's rows."""

    def run(batches):
        for b in common.whole_groups(batches, "key", "i", "j"):
            t = crowd_columns(b)
            for one, two, alone in groups_of(b, "key"):
                for x, y, _ in compared(one, two, alone, t, ratio, lambda p, q: t["label"][p] != t["label"][q]):  # noqa: B023
                    x, y = t["node"][x], t["node"][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return crowd_rows(rows).mapInArrow(run, "a long, b long")


def meetings(rows: DataFrame, ratio: Fraction) -> DataFrame:
    """(node, label, root): nodes that share a key with a node of another label and may be similar to it by size, place and parities.

    Edges from label to root connect the labels of all such nodes.  Rows are key, node, n, place,
    label, bits, and crowd, the number of rows of the key.  Rows of a key meet in one task, those of
    more than BLOCK rows as pairs of blocks; no more rows leave a task than come in.
    """

    def run(batches):
        for b in common.whole_groups(batches, "key", "i", "j"):
            t = crowd_columns(b)
            label = root = t["label"]
            near = np.zeros(len(label), bool)
            # Keys of few rows: rows at each distance, of all keys at once.
            k = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
            group = np.cumsum(np.concatenate([[False], np.any(k[1:] != k[:-1], axis=1)]))
            few = np.flatnonzero(np.bincount(group)[group] <= ALL_PAIRS)
            for step in range(1, ALL_PAIRS):
                x = few[few + step < len(group)]
                x = x[(group[x] == group[x + step]) & (label[x] != label[x + step])]
                x = x[by_size(x, x + step, t, ratio)]
                x, y, _ = by_parities(x, x + step, t, ratio)
                near[x] = near[y] = True
                root = merged(root, x, y)
            # Of a crowded key, rows known to be near something, and under one root, need no further look.
            for one, two, alone in groups_of(b, "key", ALL_PAIRS + 1):
                for x, y, _ in compared(one, two, alone, t, ratio, lambda p, q: (label[p] != label[q]) & ~(near[p] & near[q] & (root[p] == root[q]))):  # noqa: B023
                    near[x] = near[y] = True
                    root = merged(root, x, y)
            node, place = np.unique(t["node"][near], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label[near][place]), pa.array(root[near][place])], ["node", "label", "root"])

    return crowd_rows(rows).mapInArrow(run, "node long, label long, root long")


def similar_edges(rows: DataFrame, ratio: Fraction) -> DataFrame:
    """(a, b) edges that connect the similar sets of each group: rows are group, node and shingles.

    A pair is decided by its two sets: what they share is counted, not estimated.  Pairs whose
    parities already differ in more bits than similar sets can differ in shingles go before that.
    Only the edges of a spanning forest leave a task.
    """
    up, down = ratio.numerator, ratio.denominator
    sizes = rows.groupBy("group").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("shingles")).alias("n_bytes"))
    blocks = F.ceil(F.greatest(F.col("n_rows") / (4 * BLOCK), F.col("n_bytes") / (8 * common.SLICE_BYTES), F.lit(1)))

    def run(batches):
        for t in common.whole_groups(batches, "group", "i", "j"):
            data, start = common.packed(t.column("shingles"))
            data, start = data.copy().view(np.int64), start // 8
            sets_ = [data[a:b] for a, b in zip(start[:-1].tolist(), start[1:].tolist())]
            n = np.diff(start)
            c = {"node": t.column("node").to_numpy(), "n": n, "left": n}
            c["bits"], c["start"] = common.packed(common.binaries([parities(x) for x in sets_]))
            root, edges = np.arange(len(n)), []
            for one, two, alone in groups_of(t, "group"):
                for x, y, bits in compared(one, two, alone, c, ratio, lambda p, q: root[p] != root[q]):  # noqa: B023
                    for k in np.argsort(bits, kind="stable").tolist():  # the nearest first: later ones are often linked by then
                        u, v = x[k], y[k]
                        if root[u] != root[v]:
                            both = len(np.intersect1d(sets_[u], sets_[v], assume_unique=True))
                            if both * (up + down) >= up * (n[u] + n[v]):
                                root[root == root[v]] = root[u]
                                edges.append((c["node"][u], c["node"][v]))
            yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in edges], pa.int64()), pa.array([max(e) for e in edges], pa.int64())], ["a", "b"])

    return dealt(rows.join(sizes, "group"), "group", blocks).select("group", "i", "j", "second", "node", "shingles").mapInArrow(run, "a long, b long")


def fingerprint_groups(prints: DataFrame, most: int = 3) -> DataFrame:
    """(fp, label): the fingerprints that links within most bits connect, by the Golay indices, and the least of them."""
    spark = prints.sparkSession
    fps = common.written(prints.select("fp").distinct(), "simhash-nodes")
    nodes = fps.repartition(common.partitions(spark)).select(F.col("fp").alias("node"), "fp")
    found = links(nodes, most)
    edges = common.written(found, "simhash-links")
    common.dropped(found)
    groups = components(edges)
    out = common.written(fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("label")), "simhash-groups")
    for x in (fps, edges):
        common.dropped(x)
    common.freed(spark)
    return out


def similar_links(docs: DataFrame, prints: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b) edges that connect all nodes whose sets are similar; prints is described(docs).

    Candidates are the groups that links between fingerprints make (fingerprint_groups).  Similar
    sets whose fingerprints lie farther apart than any chain of links come to these by shingles of
    their prefixes: nodes of two groups that share one and may be similar by size, place and parities
    make one group of both.  The sets of each group are then compared, which decides every link.
    """
    ratio = Fraction(least).limit_denominator(1000)
    labels = fingerprint_groups(prints)
    marks = common.written(prints.select("node", "fp", "bits").dropDuplicates(["node"]).join(labels, "fp").select("node", "label", "bits"), "marks")
    w = Window.partitionBy("key")
    rows = prefixes(docs, words, ratio).repartition(common.partitions(prints.sparkSession), "key").distinct()
    rows = common.written(rows.withColumn("crowd", F.count("*").over(w)).where("crowd > 1"), "prefixes")
    met = common.written(meetings(rows.join(marks, "node"), ratio).select("label", "root").distinct(), "met")
    common.freed(prints.sparkSession)
    groups = components(met.select(F.col("label").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("label"), "component")
    members = marks.join(groups, "label", "left").select("node", F.coalesce("component", "label").alias("group"))
    several = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    members = common.written(members.join(several, "group", "left_semi"), "members")
    # Sets are many times the size of what stands for them: only those of members are made again, from one text each.
    ids = common.written(prints.join(members, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct(), "ids")
    own = sets(docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi"), words).select("node", "shingles").dropDuplicates(["node"])
    held = common.written(own.join(members, "node"), "sets")
    edges = common.written(similar_edges(held, ratio), "similar")
    for x in (labels, rows, marks, met, members, ids, held):
        common.dropped(x)
    return edges


def grouped(docs: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, node (the name of the text's set) and component_id, the smallest doc_id reachable over links."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = common.written(described(rows, words), "nodes")
    found = components(similar_links(rows, prints, words, least))
    comp = prints.join(found, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("group"))
    first = comp.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return comp.join(first, "group").select("doc_id", "node", "component_id")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and component_id over links between texts whose shingle sets are similar."""
    return grouped(docs, words, least).select("doc_id", "component_id")


def keep_first(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of one document, that of the smallest doc_id, of each group of similar texts."""
    kept = grouped(docs, words, least).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node")).distinct()
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")

    # Rows that repeat an id are told apart by their sets, and are copies if their texts are equal.
    def named(batches):
        for whole in batches:
            for b in common.slices(whole):
                node = pa.array([set_name(shingles(x, words)) for x in common.utf8(b.column("text"))], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, node], [*b.schema.names, "_node"])

    rows = docs.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())]))
    left = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["_node"] == kept["kept_node"]), "left_semi")
    return left.drop("_node").dropDuplicates(["doc_id", "text"])
