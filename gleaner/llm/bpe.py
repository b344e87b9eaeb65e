"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves; a leaf holds the merge rank of the pair that begins there,
an inner node the least of its two children with the leftmost place.  The root therefore
names the leftmost pair of lowest rank.  A merge changes two or three leaves, each a
logarithmic update, and the loop ends when the root holds no rank.  Words are met again and
again, so each worker keeps the ids of words it has encoded.

Defined results: null and empty texts have no ids and decode to the empty text; strings of
added tokens in a text become their ids, as in the library's default; rows and other columns
are kept as they are, and an input column of a name that is added here is replaced.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Fixed value: the public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLACE_BITS, NONE = 40, 1 << 80
#: Words kept with their ids in each Python worker (the first that come, so mostly frequent ones), and the longest that is kept.
KEPT_WORDS, KEPT_CHARS = 400_000, 64


def byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class ByteBPE:
    """A byte-level BPE file of the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, letters = j["model"]["vocab"], byte_letters()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(j["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 24 | vocab[b], (rank, vocab[a + b]))
        self.id_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in j.get("added_tokens", [])}
        self.id_bytes |= {i: t.encode() for t, i in self.added.items()}
        self.added_split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges, size = self.merges, 1
        while size < n:
            size *= 2
        # A node is rank << PLACE_BITS | place, so that the least is the leftmost of the lowest rank.
        tree = [NONE] * (2 * size)
        get = merges.get
        for i in range(n - 1):
            if m := get(ids[i] << 24 | ids[i + 1]):
                tree[size + i] = m[0] << PLACE_BITS | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int) -> None:
            j = after[i]
            m = get(ids[i] << 24 | ids[j]) if j < n else None
            k = size + i
            tree[k] = m[0] << PLACE_BITS | i if m else NONE
            while k := k >> 1:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b

        while (root := tree[1]) < NONE:
            i = root & (1 << PLACE_BITS) - 1
            j = after[i]
            ids[i] = merges[ids[i] << 24 | ids[j]][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            after[j] = n
            put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        words, kept = self.words.findall(text), self.kept
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            pass
        rare = {}
        for w in [w for w in set(words) if w not in kept]:
            (kept if len(w) <= KEPT_CHARS and len(kept) < KEPT_WORDS else rare)[w] = np.array(self.merge(w.encode("utf-8", "replace")), "<u4").tobytes()
        return b"".join([kept[w] if w in kept else rare[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if not self.added_split or not self.added_split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.added_split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids) -> str:
        return b"".join(map(self.id_bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of every whole text, and the text decoded from those ids."""
    kept = docs.drop(ids, decoded)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches):
        bpe = loaded(tokenizer_path)
        for whole in batches:
            for b in common.slices(whole, limit=2 << 20):
                out = [np.frombuffer(bpe.encode(x or ""), "<u4") for x in b.column("text").to_pylist()]
                texts = [bpe.decode(x.tolist()) for x in out]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                values = np.concatenate([*out, np.zeros(0, "<u4")]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(texts, pa.string())], [*b.schema.names, ids, decoded])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: derived natively from encode_decode()."""
    done = encode_decode(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), tokenizer_path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
