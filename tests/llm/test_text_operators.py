"""Operators on texts against brute force, with nulls, empty and odd texts, ties and repeats."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontaminate, queries, records, simhash, suffix
from tests.conftest import DATA

SMALL = f"{DATA}/sf0.001"


def texts(spark, sf=SMALL):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, block string")


ODD = ["<|endoftext|>a<|endoftext|> b", "  x  ", "\n\n a\t b", " ", "", "<|startoftext|>hé́ o", "É ΑΣ x ǅ ª1º² don't I'LL '''S", "x" * 3000, "q\u0085r\x1cs\x1ft İ|ſ½", "中文 \U0001f600!!"]


def test_bpe_query_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_bpe"](spark, SMALL).collect()}
    for i, x in texts(spark):
        ids = t.encode(x, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tokenizers_on_odd_texts():
    from tokenizers import Tokenizer

    byte, word = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
    a, b, own = Tokenizer.from_file(byte), Tokenizer.from_file(word), bpe.ByteBPE(byte)
    for x in ODD:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == a.encode(x, add_special_tokens=False).ids
    assert [np.frombuffer(y, "<u2").tolist() for y in records.encoded(ODD, word)] == [b.encode(x, add_special_tokens=False).ids for x in ODD]


def test_bpe_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (None, "a", "k"), (None, "a", "k")], "doc_id long, text string, ids string")
    rows = bpe.encode_decode(df, queries.tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"], len(r["ids"])) for r in rows) == [(0, "a", 1), (0, "a", 1), (1, "", 0)]
    assert bpe.digests(df.limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_records"](spark, SMALL).collect()}
    start = 0
    for i, x in texts(spark):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = f"file://{tmp_path}/r"
    df = frame(spark, [(3, "c", "", ""), (1, None, "", ""), (None, "z", "", ""), (3, "d", "", ""), (2, "b", "", "")])
    m = records.write(df, path, queries.tokenizer_path("word_bpe_49k.json"), files=2)
    back = records.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 2, 3, 3] and back[1]["n_tokens"] == 1
    one = m.orderBy("bucket").first()
    assert [d for d, _ in records.read_at(path, one["file"], [one["records"] - 1, 0])][-1] is None
    f = tmp_path / "r" / one["file"]
    data = bytearray(f.read_bytes())
    data[14] ^= 1
    with pytest.raises(ValueError):
        import io

        list(records.frames(io.BytesIO(bytes(data))))
    assert records.unmasked(records.masked(12345)) == 12345
    empty = f"file://{tmp_path}/e"
    records.write(df.limit(0), empty, queries.tokenizer_path("word_bpe_49k.json"))
    assert records.read(spark, empty).count() == 0


def brute_repeats(docs, length):
    out, first = {}, {}
    for i, x in sorted(docs):
        x = x.encode()
        gone = np.zeros(len(x), bool)
        ws = [x[k : k + length] for k in range(len(x) - length + 1)]
        for k, w in enumerate(ws):
            if first.get(w, i) < i:
                gone[k : k + length] = True
        for w in ws:
            first.setdefault(w, i)
        out[i] = (len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_query_equals_brute_force(spark):
    want = brute_repeats(texts(spark), 50)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op2_suffix"](spark, SMALL).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


@pytest.mark.parametrize("length", [8, 13, 50])
def test_suffix_on_random_repeats(spark, length):
    r = np.random.default_rng(length)
    parts = ["".join(r.choice(list("abé "), 40)) for _ in range(6)]
    docs = [(i, "".join(parts[k] for k in r.integers(0, 6, r.integers(0, 6))) + "".join(r.choice(list("xyz"), 9))) for i in range(40)] + [(40, "a" * 500), (41, "a" * 300), (42, ""), (43, "short")]
    df = frame(spark, [(i, x, "n", "b") for i, x in docs])
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffix.dedup(df, length).collect()}
    assert got == brute_repeats(docs, length)


def test_suffix_ranks_sort():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 10, 100, 1001):
        s = r.integers(1, 4, n)
        order = np.argsort(suffix.suffix_ranks(s, 50))
        assert all(tuple(s[a : a + 50]) <= tuple(s[b : b + 50]) for a, b in zip(order, order[1:]))


def test_suffix_edges(spark):
    x = "0123456789" * 6
    df = frame(spark, [(1, None, "", ""), (None, x, "", ""), (5, x, "", ""), (5, x, "", "")])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix.dedup(df).collect())
    assert got == [(0, 0), (1, 0), (5, 60), (5, 60)]
    assert suffix.dedup(df.limit(0)).count() == 0
    kept = suffix.remove_repeats(df.where("doc_id is null or doc_id = 1"))
    assert kept.columns == df.columns and kept.count() == 2


def test_repeats_take_cut_characters_and_no_others(spark):
    shared = "0123456789" * 6
    df = frame(spark, [(1, f"\u00e9{shared}\u00e9", "", ""), (2, f"\ufffda\u00e8 {shared} b\ufffd", "", ""), (3, f"c\ufffd\u00e9{shared}\u00ea\ufffd", "", "")])
    got = {r["doc_id"]: r["text"] for r in suffix.remove_repeats(df).collect()}
    # The bytes of 3 that repeat 1 end within a character, whose other half goes with them.
    assert got == {1: f"\u00e9{shared}\u00e9", 2: "\ufffda\u00e8  b\ufffd", 3: "c\ufffd\ufffd"}


def brute_fingerprint(x):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    w = re.findall("[^\x20\x09-\x0d]+", low)
    sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(q.encode(), 42) for q in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, fps, most=3):
    p = list(range(len(ids)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= most):
            u, v = find(a), find(int(b))
            p[max(u, v)] = min(u, v)
    return [ids[find(k)] for k in range(len(ids))]


def test_simhash_query_equals_brute_force(spark):
    docs = texts(spark)
    fps = np.array([brute_fingerprint(x) for _, x in docs], np.uint64)
    want = {i: (f"{int(f):016x}", c) for (i, _), f, c in zip(docs, fps, brute_components([i for i, _ in docs], fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op10_simhash"](spark, SMALL).collect()} == want


def test_simhash_links_chains(spark):
    r = np.random.default_rng(3)
    fps = [int(x) for x in r.integers(0, 1 << 63, 200)]
    for k in range(400):  # chains of flips, and pairs just too far
        x = fps[r.integers(0, len(fps))]
        for b in r.choice(64, r.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = np.array(sorted(set(fps)), np.uint64)
    nodes = spark.createDataFrame([(k, int(np.int64(np.uint64(f)))) for k, f in enumerate(fps)], "node long, fp long")
    got = {x["node"]: x["component"] for x in simhash.components(simhash.links(nodes)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == brute_components(list(range(len(fps))), fps)


def test_golay_code_is_perfect():
    index = simhash.golay_index()
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096


def test_simhash_edges(spark):
    df = frame(spark, [(3, None, "", ""), (2, "", "", ""), (7, " \n", "", ""), (9, "a b", "", ""), (9, "a b", "", ""), (None, "a b", "", "")])
    got = sorted((r["doc_id"] or 0, r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, False, 9), (2, True, 2), (3, True, 2), (7, True, 2), (9, False, 9), (9, False, 9)]
    kept = simhash.keep_first(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_null_ids_link_others(spark):
    r = np.random.default_rng(4)
    body, chain = [f"w{x}" for x in r.integers(0, 1 << 30, 200)], []
    for k in range(120):
        body[int(r.integers(200))] = f"x{k}"
        chain.append(" ".join(body))
    fp = [simhash.fingerprint(x.encode()) for x in chain]
    near = lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3
    a, b, c = next((i, j, k) for i in range(120) for j in range(i) for k in range(j) if near(i, j) and near(j, k) and not near(i, k))
    df = frame(spark, [(1, chain[a], "", ""), (None, chain[b], "", ""), (9, chain[c], "", "")])
    assert [x["component_id"] for x in simhash.near_duplicates(df).collect()] == [1, 1, 1]
    assert sorted(x["component_id"] for x in simhash.near_duplicates(df.where("doc_id is not null")).collect()) == [1, 9]


def test_parities_never_exceed_the_difference():
    r = np.random.default_rng(8)
    one, two, want = [], [], []
    for k in range(300):
        both, a, b = (r.integers(-(1 << 63), (1 << 63) - 1, r.integers(0, n)) for n in (400, 1 + 2 * k, 90))
        a, b = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
        one.append(simhash.parities(a))
        two.append(simhash.parities(b))
        want.append(len(np.setxor1d(a, b)))
    got = simhash.differing(pa.array(one, pa.binary()), pa.array(two, pa.binary()))
    assert (got <= want).all() and (got % 2 == np.array(want) % 2).all() and got.sum() > 0.4 * sum(want)
    assert len({len(x) for x in one + two}) > 2


def test_decontamination_equals_sql(spark, duck, same):
    got = queries.QUERIES["op4_decontaminate"](spark, SMALL).toPandas()
    same(got, duck(queries.ORACLES["op4_decontaminate"], "sf0.001"))
    assert got["n_hit"].sum() > 0


def test_decontamination_edges(spark):
    items = spark.createDataFrame([("i1", "one two three four five six seven eight nine"), ("i1", "one two three four five six seven eight nine"), ("i2", "Alpha beta"), ("i3", "..."), ("i4", None), (None, "gamma")], "item_id string, text string")
    docs = frame(spark, [(1, "x ONE two, three four five six seven eight. alpha-beta gamma", "", ""), (2, None, "", ""), (2, "alpha x beta", "", ""), (None, "beta alpha beta", "", "")])
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(0, 3, 2, 1, False), (1, 12, 10, 2, True), (2, 0, 0, 0, False), (2, 3, 0, 0, False)]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    wins = decontaminate.windows(items)
    near = decontaminate.search(decontaminate.index(docs, None), wins, slop=1).where(F.size("words") == 2)
    assert near.count() == 3  # "alpha x beta" too
    assert decontaminate.keep_clean(docs, items).count() == 3


def test_similar_texts_are_grouped(spark):
    r = np.random.default_rng(9)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    rows, group = [], {}
    for g in range(40):
        base = [word() for _ in range(300)]
        for c in range(3):
            copy = list(base)
            for k in r.choice(300, 2 * c, replace=False):  # up to 4 words changed: at most 20 of 296 shingles
                copy[k] = word()
            rows.append((10 * g + c, " ".join(copy), "", ""))
            group[10 * g + c] = 10 * g
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert all(group[i] == c or i == c for i, c in got.items())  # nothing else is joined
    assert sum(group[i] == c for i, c in got.items()) >= 0.95 * len(rows)
    assert simhash.keep_first(frame(spark, rows)).count() <= 45


def test_large_group_of_near_copies(spark):
    r = np.random.default_rng(10)
    base = ["w%d" % k for k in range(400)]
    rows = []
    for c in range(60):
        copy = list(base)
        copy[int(r.integers(400))] = f"x{c}"
        rows.append((c, " ".join(copy), "", ""))
    assert {x["component_id"] for x in simhash.similar_groups(frame(spark, rows)).collect()} == {0}


def test_bpe_merges_beyond_16_mib():
    b = bpe.ByteBPE.__new__(bpe.ByteBPE)
    b.byte_id, b.merges = list(range(256)), {ord("b") << 24 | ord("c"): (0, 300)}
    got = b.merge(b"a" * (1 << 24) + b"bc")
    assert len(got) == (1 << 24) + 1 and got[-1] == 300


def test_crowded_keys_in_blocks(spark, monkeypatch):
    """Pairs of a key dealt out as pairs of blocks are those of one block, and those of brute force."""
    r = np.random.default_rng(12)
    rows, sets = [], {}
    for k in range(90):
        base = r.integers(0, 1 << 60, 40) if k % 3 == 0 else base
        own = np.unique(np.concatenate([base, r.integers(0, 1 << 60, int(r.integers(1, 12)))]))
        sets[k] = own
        rows += [(key, k, len(own), int(r.integers(0, 3)), k // 2, 90, bytearray(simhash.parities(own))) for key in (5, 6)]
    df = spark.createDataFrame(rows, "key long, node long, n int, place int, label long, crowd long, bits binary")
    ratio = Fraction(4, 5)
    place = {(x[0], x[1]): x[3] for x in rows}
    want = set()
    for a in range(90):
        for b in range(a):
            n = len(sets[a]), len(sets[b])
            apart = simhash.differing(*(pa.array([simhash.parities(sets[x])], pa.binary()) for x in (a, b)))[0]
            fits = any(min(n[0] - place[k, a], n[1] - place[k, b]) * 9 >= sum(n) * 4 for k in (5, 6))
            if a // 2 != b // 2 and fits and apart * 9 <= sum(n):
                want.add((b, a))
    got = lambda: {tuple(x) for x in simhash.crowd_pairs(df, ratio).collect()}
    assert got() == want and len(want) > 10
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert got() == want


def test_parities_of_wide_sets_are_a_bound():
    r = np.random.default_rng(13)
    one = np.unique(r.integers(-(1 << 63), (1 << 63) - 1, 40_000))
    two = np.concatenate([one[:-3000], [1, 2, 3]])
    a, b = simhash.parities(one), simhash.parities(np.unique(two))
    assert len(a) * 8 == len(b) * 8 == simhash.WIDEST
    assert 1000 < simhash.differing(pa.array([a], pa.binary()), pa.array([b], pa.binary()))[0] <= 3003


def test_crowded_keys_leave_no_more_rows_than_come(spark, monkeypatch):
    """Two families of 150 sets, all near in each: rows that leave the tasks, and what their roots connect."""
    r = np.random.default_rng(14)
    base, rows = [r.integers(0, 1 << 60, 200) for _ in range(2)], []
    for k in range(300):
        own = np.unique(np.concatenate([base[k % 2], r.integers(0, 1 << 60, 3)]))
        rows += [(key, k, len(own), 0, k, 300, bytearray(simhash.parities(own))) for key in (5, 6)]
    rows += [(100 + k // 2, 1000 + k, 50, 0, 1000 + k, 2, bytearray(simhash.parities(r.integers(0, 1 << 60, 50)))) for k in range(10)]
    df = spark.createDataFrame(rows, "key long, node long, n int, place int, label long, crowd long, bits binary")
    for block in (simhash.BLOCK, 64):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.meetings(df, Fraction(4, 5)).collect()
        assert len(got) <= 600 * -(-300 // block)
        assert {x["node"] for x in got} == set(range(300)) and all(x["label"] == x["node"] for x in got)
        edges = spark.createDataFrame([(x["label"], x["root"]) for x in got], "a long, b long")
        assert {(x["node"], x["component"]) for x in simhash.components(edges).collect()} == {(k, k % 2) for k in range(2, 300)}
