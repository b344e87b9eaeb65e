"""Words of a batch with repeats looked up once, and bounded samples of labelled rows; shared by the two classifiers."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def indexed_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (parted by white space), the number of each word in order, and where each text starts (one more at the end)."""
    words = [(x or "").split() for x in texts]
    known: dict[str, int] = {}
    fresh = itertools.count()
    known = {w: next(fresh) for w in dict.fromkeys(itertools.chain.from_iterable(words))}
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    ids = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(offsets[-1]))
    return list(known), ids, offsets


def crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def held_out(doc_id, parts: int, part: int):
    """Whether crc32 of the doc_id as text leaves the remainder kept for testing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled documents outside the held-out part, half of either label where there are enough.

    The labels' rows are picked first, in order of a hash, so that what is broadcast has at most `most` rows.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("picked"), F.col(label).cast("int").alias("y")).where("picked is not null and y in (0, 1)").where(~held_out(F.col("picked"), parts, part)).dropDuplicates(["picked"])
    halves = [rows.where(F.col("y") == y).orderBy(F.xxhash64("picked")).limit(most // 2) for y in (0, 1)]
    picked = halves[0].unionByName(halves[1])
    return docs.select(F.col("doc_id").cast("long").alias("picked"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "picked").select("picked", "text", "y")
