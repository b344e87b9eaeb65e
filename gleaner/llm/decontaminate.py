"""Benchmark decontamination over a distributed positional inverted index.

The index is parted by documents: a block of documents (about SLICE_BYTES of text, one long
document at most beyond) is one row that lists, for each term, its ascending word positions
in the block.  A window of test words is looked up by intersection in every block: the list of
its rarest term (in fewest documents of the whole corpus) gives candidate places, and the
lists of its other terms, rarest first and shifted by their offsets, strike candidates out
until the phrase stands within one document.  With a slop, a term may stand that many words
away from its place (proximity).  Postings never leave their block, so nothing is shuffled but
counts and hits, and no term or document, however frequent, gathers in one task.

Only terms that the test set asks for are stored where its vocabulary is at most VOCABULARY
words; beyond that every term is.  Windows are sent to the blocks QUERIES at a time.

Defined results: words are lower-cased (A-Z alone) runs of digits, letters and characters
beyond ASCII; null and empty texts have no words and no hits; test rows without words or
item_id match nothing; repeated document rows each have a result of their own; repeated
item_ids count once; an empty test set hits nothing.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, VOCABULARY, QUERIES = 8, 1_000_000, 200_000
#: Bytes: A-Z to a-z; what is neither digit, letter nor beyond ASCII to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, words): every window of n consecutive words of each item; a shorter item is one window."""

    def run(batches):
        for b in batches:
            ids, ws = [], []
            for i, x in zip(b.column("item_id").to_pylist(), common.utf8(b.column("text"))):
                if (w := words(x)) and i is not None:
                    for k in range(max(1, len(w) - n + 1)):
                        ids.append(i)
                        ws.append([x.decode("utf-8", "replace") for x in w[k : k + n]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(ws, pa.list_(pa.string()))], ["item_id", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id string, words array<string>").distinct()


INDEX = "block long, doc_ids array<long>, n_words array<int>, terms array<string>, docs array<int>, counts array<int>, positions binary"


def index(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """Blocks: documents with their numbers of words; terms with the number of documents and of places, and all places (32-bit, term after term)."""
    known = None if vocabulary is None else [x.encode() for x in vocabulary]

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        ids = None if known is None else {w: i for i, w in enumerate(known)}
        for whole in batches:
            for b in common.slices(whole):
                lists = [words(x) for x in common.utf8(b.column("text"))]
                counts = np.array([len(x) for x in lists], np.int64)
                if ids is None:
                    local: dict[bytes, int] = {}
                    term = np.array([local.setdefault(w, len(local)) for ws in lists for w in ws], np.int64)
                    names = list(local)
                else:
                    term = np.fromiter((k for ws in lists for k in map(ids.get, ws, itertools.repeat(-1))), np.int64, int(counts.sum()))
                    names = known
                place = np.flatnonzero(term >= 0)
                term = term[place]
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                doc = np.searchsorted(np.cumsum(counts), place, "right")
                cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]).astype(np.int32) if len(term) else np.zeros(0, np.int32)
                one = lambda x, t: pa.array([x], pa.list_(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), one(b.column("doc_id").to_pylist(), pa.int64()), one(counts, pa.int32()), one([names[i].decode("utf-8", "replace") for i in term[cut].tolist()], pa.string()), one(np.add.reduceat(fresh, cut) if len(cut) else [], pa.int32()), one(np.diff(np.concatenate([cut, [len(term)]])), pa.int32()), common.binaries([place.astype("<u4").tobytes()])],
                    ["block", "doc_ids", "n_words", "terms", "docs", "counts", "positions"],
                )
                block += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.written(rows.mapInArrow(run, INDEX), "postings")


def vocabulary_of(wins: DataFrame) -> list[str] | None:
    terms = wins.select(F.explode("words").alias("w")).distinct()
    found = [r["w"] for r in terms.limit(VOCABULARY + 1).collect()]
    return None if len(found) > VOCABULARY else sorted(found)


def document_counts(blocks: DataFrame) -> DataFrame:
    """(term, df): the number of documents of the whole corpus that hold a term."""
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "docs")).alias("x"))
    return pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.docs").alias("df"))


def intersect(lists: dict[str, np.ndarray], ends: np.ndarray, plan: list[tuple[int, str]], slop: int) -> np.ndarray:
    """Starts (in a block) of a window given as (offset, term), rarest first, each inside one document."""
    if any(t not in lists for _, t in plan):
        return np.zeros(0, np.int64)
    offset, term = plan[0]
    start = lists[term] - offset
    for offset, term in plan[1:]:
        if not len(start):
            return start
        at = lists[term]
        k = np.searchsorted(at, start + offset - slop)
        start = start[(k < len(at)) & (at[np.minimum(k, len(at) - 1)] <= start + offset + slop)]
    start = start[start >= 0]
    last = start + len(plan) - 1
    doc = np.searchsorted(ends, start, "right")
    return start[(doc < len(ends)) & (doc == np.searchsorted(ends, last, "right"))]


def search(blocks: DataFrame, wins: DataFrame, slop: int = 0) -> DataFrame:
    """(block, doc, words, start, n): where each distinct window stands, n words from word `start` of document number `doc` of a block on."""
    phrases = wins.select("words").distinct()
    asked = phrases.select("words", F.posexplode("words").alias("offset", "term")).join(document_counts(blocks), "term")
    plans = asked.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("df", "offset", "term"))).alias("plan")).where(F.size("plan") == F.size("words"))
    plans = common.written(plans.select(F.pmod(F.xxhash64("words"), F.lit(max(1, -(-phrases.count() // QUERIES)))).alias("part"), "words", "plan"), "plans")
    out = None
    for part in range(plans.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("n")).first()["n"]):
        rows = plans.where(F.col("part") == part).select("words", "plan").collect()  # about QUERIES windows
        asked_ = [(r["words"], [(x["offset"], x["term"]) for x in r["plan"]]) for r in rows]

        def run(batches, asked_=asked_):
            for b in batches:
                for row in range(b.num_rows):
                    counts = b.column("n_words")[row].values.to_numpy()
                    ends = np.cumsum(counts, dtype=np.int64)
                    cuts = np.cumsum(b.column("counts")[row].values.to_numpy(), dtype=np.int64)
                    places = np.frombuffer(b.column("positions")[row].as_py(), "<u4").astype(np.int64)
                    lists = dict(zip(b.column("terms")[row].as_py(), np.split(places, cuts[:-1])))
                    doc, start, which = [], [], []
                    for w, (_, plan) in enumerate(asked_):
                        if len(s := intersect(lists, ends, plan, slop)):
                            d = np.searchsorted(ends, s, "right")
                            doc.append(d)
                            start.append(s - (ends - counts)[d])
                            which += [w] * len(s)
                    if which:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([b.column("block")[row].as_py()] * len(which), pa.int64()), pa.array(np.concatenate(doc).astype(np.int32)), pa.array([asked_[w][0] for w in which], pa.list_(pa.string())), pa.array(np.concatenate(start).astype(np.int32)), pa.array([len(asked_[w][1]) for w in which], pa.int32())],
                            ["block", "doc", "words", "start", "n"],
                        )

        found = blocks.mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return blocks.sparkSession.createDataFrame([], HITS) if out is None else out


HITS = "block long, doc int, words array<string>, start int, n int"


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, least: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_items >= least) of each document row."""
    wins = common.written(windows(items, n), "windows")
    blocks = index(docs, vocabulary_of(wins))
    hits = common.written(search(blocks, wins), "hits")
    row = ["block", "doc"]
    words_hit = hits.select(*row, F.explode(F.expr("sequence(start, start + n - 1)")).alias("w")).distinct().groupBy(row).agg(F.count("*").alias("n_hit"))
    which = hits.select(*row, "words").distinct().join(wins, "words").select(*row, "item_id").distinct()
    items_hit = which.groupBy(row).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    rows = blocks.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "x")).select("block", "doc", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").cast("long").alias("n_words"))
    all_ = rows.join(words_hit, row, "left").join(items_hit, row, "left")
    n_items = F.coalesce("n_items", F.lit(0))
    return all_.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_items >= least).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, least: int = 2) -> DataFrame:
    """The rows of documents that are not contaminated."""
    bad = contamination(docs, items, n, least).where("contaminated").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
