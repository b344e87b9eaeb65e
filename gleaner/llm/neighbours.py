"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by k-means centroids of its own (fitted on a
sample of at most SAMPLE rows; every row is indexed).  A cell is a pair of centroids.  For a
query, a heap yields cells in order of the summed distance of their two centroids; cells are
taken until they hold a SHARE of all rows, a very full cell counting as HEAVY ordinary ones,
so that one crowded cell does not end the search early.  Rows of the cells are reranked by
Euclidean distance in double precision.

Rows lie in blocks of at most BLOCK rows, of whole cells where they fit; a fuller cell is
split over several.  A query goes once to each block that holds cells of it, and the block's
best go on.  What the driver sees grows with the number of cells (CELLS at most), not rows.

Defined results: vectors that are null, zero, of another length than the most common one, or
hold null or non-finite components take no part; a row is no neighbour of its own id; ties go
to the smaller id; repeated rows of an id are separate candidates and one query; fewer rows
than asked for give all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CENTROIDS, SAMPLE, SHARE, LEAST, HEAVY, BLOCK = 96, 20_000, 0.45, 2048, 4, 8192
CELLS = CENTROIDS * CENTROIDS


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors in double precision that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size(v) == (length["n"] if length else 0)) & finite & F.exists(v, lambda x: x != 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centroids (fewer, if there are fewer distinct rows)."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = squared(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    picked = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toArrow()
    if not picked.num_rows:
        return None
    x = matrix(picked.column("v"))
    half = x.shape[1] // 2
    return kmeans(x[:, :half], CENTROIDS), kmeans(x[:, half:], CENTROIDS)


def traverse(d1: np.ndarray, d2: np.ndarray, weight: np.ndarray, want: float) -> list[int]:
    """Cells by ascending summed distance until their weights reach want; empty cells are passed over."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen, out, got = [(d1[a[0]] + d2[b[0]], 0, 0)], {(0, 0)}, [], 0.0
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * CENTROIDS + int(b[j])
        if weight[cell]:
            out.append(cell)
            got += weight[cell]
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (d1[a[p[0]]] + d2[b[p[1]]], *p))
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by `every`: its k nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    books = fit(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if books is None:
        return spark.createDataFrame([], schema)
    one, two = books
    half = one.shape[1]

    def assign(batches):
        for b in batches:
            x = matrix(b.column("v"))
            cell = squared(x[:, :half], one).argmin(1) * CENTROIDS + squared(x[:, half:], two).argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], ["vec_id", "v", "cell"])

    index = common.written(rows.mapInArrow(assign, "vec_id long, v array<double>, cell int"), "multi-index")
    counts = np.zeros(CELLS, np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    want = max(LEAST, share * total)
    weight = np.minimum(counts, max(1.0, HEAVY * counts[counts > 0].mean())).astype(np.float64)
    first, parts, at, room = np.zeros(CELLS, np.int64), np.ones(CELLS, np.int64), 0, BLOCK
    for c, n in enumerate(counts.tolist()):
        if n > room:
            at, room = at + (room < BLOCK), BLOCK
        first[c] = at
        if n > BLOCK:
            parts[c] = -(-n // BLOCK)
            at, room = at + int(parts[c]), BLOCK
        else:
            room -= n
    blocks = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(CELLS) if counts[c]], "cell int, first long, parts long")
    placed = index.join(F.broadcast(blocks), "cell").select("vec_id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"))

    def route(batches):
        for b in batches:
            q = matrix(b.column("v"))
            ids, which, blocks_, cells_ = b.column("vec_id").to_pylist(), [], [], []
            if not len(q):
                continue
            for n, (d1, d2) in enumerate(zip(squared(q[:, :half], one), squared(q[:, half:], two))):
                got: dict[int, list[int]] = {}
                for c in traverse(d1, d2, weight, want):
                    for p in range(int(parts[c])):
                        got.setdefault(int(first[c]) + p, []).append(c)
                for block, cells in got.items():
                    which.append(n)
                    blocks_.append(block)
                    cells_.append(cells)
            yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n in which], pa.int64()), b.column("v").take(pa.array(which, pa.int32())), pa.array(blocks_, pa.int64()), pa.array(cells_, pa.list_(pa.int32()))], ["query_id", "v", "block", "cells"])

    queries = index.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select("vec_id", "v")
    routed = queries.mapInArrow(route, "query_id long, v array<double>, block long, cells array<int>")

    def rerank(key, table, asked):
        x, ids, cell = matrix(table.column("v")), table.column("vec_id").to_numpy(), table.column("cell").to_numpy()
        q, qid, cells = matrix(asked.column("v")), asked.column("query_id").to_numpy(), asked.column("cells").to_pylist()
        out: list[list] = [[], [], []]
        for at in range(0, len(q) if len(x) else 0, 256):
            rough = squared(q[at : at + 256], x)
            for n, d in enumerate(rough, at):
                use = np.zeros(CELLS, bool)
                use[cells[n]] = True
                i = np.flatnonzero(use[cell] & (ids != qid[n]))
                if len(i) > k:
                    near = d[i]
                    i = i[near <= np.partition(near, k - 1)[k - 1] + 1e-6 * (1 + np.abs(d).max())]
                exact = np.sqrt(((x[i] - q[n]) ** 2).sum(1))
                best = np.lexsort((ids[i], exact))[:k]
                out[0] += [int(qid[n])] * len(best)
                out[1] += ids[i][best].tolist()
                out[2] += exact[best].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = placed.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
