"""Toxicity: a bidirectional gated recurrent network with attention pooling over character
and word inputs, trained in numpy, scoring all overlapping windows.

A word's input is a hashed word vector, the mean of hashed vectors of its letter triples, and
the mean of hashed vectors of its beginnings (of 3 to 8 bytes).
Windows of WINDOW words begin every STRIDE words, so that every word lies in two windows (in
one at a text's ends).  A window passes a gated recurrent unit in both directions; attention
pools the states and a logistic unit gives its margin.  A document's margin is that of its
worst window, so training follows the worst window too (for clean documents a random one
besides).  The margin that best parts documents set aside (by F1) becomes the score 0.5.

Fitted on at most SAMPLE labelled documents, all windows of each; every document is scored
whole.

Defined results: null and empty texts are one empty window; without labels of both kinds every
score is the share of label 1 among them (0 if there are none); null labels are not learned from;
repeated rows get the same score; other columns are passed through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, labelled

WORDS, TRIPLES, WIDTH, HIDDEN, HEADS = 1 << 14, 1 << 15, 8, 8, range(3, 9)
WINDOW, STRIDE, SAMPLE, EPOCHS, THRESHOLD = 32, 16, 6000, 5, 0.5
#: Windows whose margins training makes at once.
AT_ONCE = 1 << 14
SIGNS = ".,;:!?\"'()[]{}<>|*#$%&/\\-_=+~^`@"


class Inputs:
    """Of distinct words: the word place, the places of letter triples (flat, with where each word's begin and how many there are), and the places of beginnings (-1: too short)."""

    def __init__(self, place, triples, start, count, heads):
        self.place, self.triples, self.start, self.count, self.heads = place, triples, start, count, heads

    @classmethod
    def of(cls, words: list[str]) -> Inputs:
        cores = [w.strip(SIGNS).lower().encode("utf-8", "replace") for w in words]
        data = np.frombuffer(b"".join([b"<" + c + b">" for c in cores]) + b"  ", np.uint8).astype(np.uint64)
        count = np.array([len(c) + 2 for c in cores], np.int64)
        h = (data[:-2] * np.uint64(0x9E3779B1) ^ data[1:-1] * np.uint64(0x85EBCA77) ^ data[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
        heads = np.array([[zlib.crc32(c[:n]) % TRIPLES if len(c) >= n else -1 for n in HEADS] for c in cores], np.int64).reshape(-1, len(HEADS))
        return cls((labelled.crcs(cores) % WORDS).astype(np.int64), (h * np.uint64(0x27D4EB2F) >> np.uint64(7)).astype(np.int64) % TRIPLES, np.cumsum(count) - count, count, heads)

    def take(self, k: np.ndarray) -> Inputs:
        count = self.count[k]
        start = np.cumsum(count) - count
        flat = np.arange(int(count.sum())) - np.repeat(start - self.start[k], count)
        return Inputs(self.place[k], self.triples[flat], start, count, self.heads[k])

    def __len__(self) -> int:
        return len(self.place)


def window_table(ids: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every window (padded), and the text each belongs to."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[:-1][text] + k * STRIDE
    places = at[:, None] + np.arange(WINDOW)[None, :]
    ok = places < offsets[1:][text][:, None]
    padded = np.concatenate([ids, [pad]])
    return padded[np.where(ok, places, len(ids))], text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters p: word and triple vectors E, C; for each direction input weights W, recurrent weights U, biases b; attention A, v; output o, c."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"E": f(WORDS, WIDTH) * 0.1, "C": f(TRIPLES, WIDTH) * 0.1, "D": f(TRIPLES, WIDTH) * 0.1, "A": f(2 * HIDDEN, HIDDEN), "v": f(HIDDEN), "o": f(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(3 * WIDTH, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.shift = 0.0
        self.constant: float | None = None

    def vectors(self, words: Inputs) -> np.ndarray:
        """Inputs of distinct words; one more row at the end, of zeros, pads."""
        x, p = np.zeros((len(words) + 1, 3 * WIDTH), np.float32), self.p
        if len(words):
            x[:-1, :WIDTH] = p["E"][words.place]
            x[:-1, WIDTH : 2 * WIDTH] = np.add.reduceat(p["C"][words.triples[: int(words.count.sum())]], words.start, axis=0) / words.count[:, None]
            ok = words.heads >= 0
            for j in range(len(HEADS)):
                x[:-1, 2 * WIDTH :] += np.where(ok[:, j, None], p["D"][words.heads[:, j]], 0)
            x[:-1, 2 * WIDTH :] /= np.maximum(ok.sum(1), 1)[:, None]
        return x

    def states(self, gates: np.ndarray, table: np.ndarray, d: str, keep: bool = False):
        """States of one direction at every step: (WINDOW, windows, HIDDEN).  gates: input parts of all three gates by word."""
        U, H = self.p[f"U{d}"], HIDDEN
        h = np.zeros((len(table), H), np.float32)
        out = np.empty((WINDOW, len(table), H), np.float32)
        cache = []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            g = gates[table[:, t]]
            zr = sigmoid(g[:, : 2 * H] + h @ U[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(g[:, 2 * H :] + (r * h) @ U[:, 2 * H :])
            new = h + z * (n - h)
            if keep:
                cache.append((t, h, z, r, n))
            out[t] = h = new
        return (out, cache) if keep else out

    def margins(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        p = self.p
        gates = {d: x @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"}
        out = []
        for at in range(0, len(table), 2048):
            t = table[at : at + 2048]
            h = np.concatenate([self.states(gates["f"], t, "f"), self.states(gates["b"], t, "b")], axis=2)
            e = np.tanh(h @ p["A"]) @ p["v"]
            a = np.exp(e - e.max(0))
            a /= a.sum(0)
            out.append((a[:, :, None] * h).sum(0) @ p["o"] + p["c"][0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def gradients(self, words: Inputs, table: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """table: windows over `words`, whose number is the pad."""
        p, H = self.p, HIDDEN
        x = self.vectors(words)
        states, caches = {}, {}
        for d in "fb":
            states[d], caches[d] = self.states(x @ p[f"W{d}"] + p[f"b{d}"], table, d, True)
        h = np.concatenate([states["f"], states["b"]], axis=2)
        q = np.tanh(h @ p["A"])
        e = q @ p["v"]
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        dm = ((sigmoid(pooled @ p["o"] + p["c"][0]) - y) * weight).astype(np.float32)
        g = {"o": pooled.T @ dm, "c": np.array([dm.sum()], np.float32)}
        dpool = dm[:, None] * p["o"]
        da = (h * dpool).sum(2)
        de = a * (da - (a * da).sum(0))
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["v"] = (q * de[:, :, None]).sum((0, 1))
        g["A"] = np.einsum("tnh,tnk->hk", h, dq)
        dh_all = a[:, :, None] * dpool + dq @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U, W = p[f"U{d}"], p[f"W{d}"]
            dU, dgates = np.zeros_like(U), np.zeros((len(x), 3 * H), np.float32)
            carry = np.zeros((len(table), H), np.float32)
            for t, h0, z, r, n in reversed(caches[d]):
                dh = dh_all[t, :, k * H : (k + 1) * H] + carry
                dn = dh * z * (1 - n * n)
                drh = dn @ U[:, 2 * H :].T
                dz, dr = dh * (n - h0) * z * (1 - z), drh * h0 * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                dU[:, 2 * H :] += (r * h0).T @ dn
                dU[:, : 2 * H] += h0.T @ dzr
                carry = dh * (1 - z) + drh * r + dzr @ U[:, : 2 * H].T
                np.add.at(dgates, table[:, t], np.concatenate([dzr, dn], axis=1))
            g[f"U{d}"], g[f"b{d}"], g[f"W{d}"] = dU, dgates.sum(0), x.T @ dgates
            dx += dgates @ W.T
        dx = dx[:-1]
        g |= {k: np.zeros_like(p[k]) for k in "ECD"}
        np.add.at(g["E"], words.place, dx[:, :WIDTH])
        np.add.at(g["C"], words.triples[: int(words.count.sum())], np.repeat(dx[:, WIDTH : 2 * WIDTH] / words.count[:, None], words.count, axis=0))
        ok = words.heads >= 0
        share = dx[:, 2 * WIDTH :] / np.maximum(ok.sum(1), 1)[:, None]
        for j in range(len(HEADS)):
            np.add.at(g["D"], words.heads[ok[:, j], j], share[ok[:, j]])
        return g

    def document_margins(self, texts: list[str | None]) -> np.ndarray:
        words, ids, offsets = labelled.indexed_words(texts)
        table, text = window_table(ids, offsets, len(words))
        m = self.margins(self.vectors(Inputs.of(words)), table)
        return np.maximum.reduceat(m, np.searchsorted(text, np.arange(len(texts)))) if len(texts) else m

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(self.document_margins(texts).astype(np.float64) + self.shift)


def train(texts: list[str | None], y: np.ndarray, seed: int = 17) -> Net:
    net, r = Net(), np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    aside = np.arange(len(y)) % 5 == 0
    words, ids, offsets = labelled.indexed_words(texts)
    table, text = window_table(ids, offsets, len(words))
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    every = Inputs.of(words)
    # The first coordinate of a vector starts from how much more often toxic documents hold what it stands for.
    n = np.array([(~aside & (y == c)).sum() for c in (0, 1)])
    for name, size in (("E", WORDS), ("D", TRIPLES)):
        seen = np.zeros((2, size))
        for k in np.flatnonzero(~aside).tolist():
            own = np.unique(ids[offsets[k] : offsets[k + 1]])
            places = np.unique(every.place[own] if name == "E" else every.heads[own])
            seen[y[k], places[places >= 0]] += 1
        net.p[name][:, 0] = np.clip(np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1)), -2, 4) * 0.5
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def narrowed(t: np.ndarray) -> tuple[Inputs, np.ndarray]:
        """The words that windows hold, and the windows over those."""
        used = np.unique(t)
        used = used[used < len(every)]
        return every.take(used), np.searchsorted(used, t)  # the pad comes after all

    step, learn = 0, np.flatnonzero(~aside)
    for _ in range(EPOCHS):
        for part in np.array_split(r.permutation(learn), max(1, len(learn) // 64)):
            rows = [np.arange(first[k], first[k + 1]) for k in part]
            every_row, m = np.concatenate(rows), []
            for at in range(0, len(every_row), AT_ONCE):
                own, t = narrowed(table[every_row[at : at + AT_ONCE]])
                m.append(net.margins(net.vectors(own), t))
            m = np.concatenate(m)
            picked, target = [], []
            at = 0
            for k, w in zip(part.tolist(), rows):
                worst = w[m[at : at + len(w)].argmax()]
                at += len(w)
                picked.append(worst)
                target.append(y[k])
                if not y[k]:
                    picked.append(w[r.integers(len(w))])
                    target.append(0)
            target = np.array(target, np.float32)
            weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())).astype(np.float32)
            step += 1
            for k, g in net.gradients(*narrowed(table[picked]), target, weight).items():
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                net.p[k] -= (0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    m, t = net.document_margins([x for x, s in zip(texts, aside) if s]).astype(np.float64), y[aside].astype(np.float64)
    if len(set(t.tolist())) == 2:
        order = np.argsort(m)
        m, t = m[order], t[order]
        right = t.sum() - np.concatenate([[0], np.cumsum(t)])  # toxic ones from each cut on
        f1 = 2 * right / (len(t) - np.arange(len(t) + 1) + t.sum())
        best = np.flatnonzero(f1 == f1.max())
        k = int(best[len(best) // 2])
        net.shift = -float((m[max(k - 1, 0)] + m[min(k, len(m) - 1)]) / 2)
    return net


def score(docs: DataFrame, net: Net, column: str = "score") -> DataFrame:
    kept = docs.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, limit=2 << 20):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.scores(b.column("text").cast(pa.string()).to_pylist()).astype(np.float64))], [*b.schema.names, column])

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """The rows of docs with held_out, score and predicted."""
    got = labelled.sample(docs, labels, "toxic", parts, part, SAMPLE).toArrow().sort_by("picked")
    net = train(got.column("text").to_pylist(), got.column("y").to_numpy())
    done = score(docs.drop("held_out", "predicted"), net)
    return done.withColumn("held_out", labelled.held_out(F.col("doc_id"), parts, part)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
