"""Each stage of the pipeline against a brute-force version over the same rows."""

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import decontaminate, labelled, quality, queries, simhash
from tests.conftest import DATA
from tests.llm.test_text_operators import SMALL, brute_repeats


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def held(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    w, bias = quality.train(labelled.sample(docs, labels, "quality", 4, 2, quality.SAMPLE))
    want = set()
    for i, x in held(docs).items():
        places, _ = quality.features([x])
        n = max(1, len(places[0]))
        margin = sum(float(w[p].sum()) for p in places) * quality.SCALE / n + bias
        if 1 / (1 + np.exp(-margin)) >= quality.THRESHOLD:
            want.add(i)
    got = set(held(stage("quality_classifier")(spark, docs, SMALL)))
    assert len(got ^ want) <= 1 and 0 < len(got) < docs.count()  # single against double precision


def test_near_duplicates(spark, docs):
    rows = sorted(held(docs).items())
    sets = []
    for _, x in rows:
        ws = (x or "").encode().lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    want = {rows[k][0] for k in range(len(rows)) if find(k) == k}
    assert set(held(stage("near_dedup")(spark, docs, SMALL))) == want and len(want) < len(rows)


def test_suffix(spark, docs):
    before = held(docs)
    want = brute_repeats([(i, x or "") for i, x in before.items()], 50)
    got = held(stage("suffix_dedup")(spark, docs, SMALL))
    assert set(got) == {i for i, (n, gone, _, _) in want.items() if not n or gone < n}
    for i, x in got.items():
        n, gone = want[i][:2]
        assert (x == before[i]) if not gone else n - gone - 6 * want[i][2] <= len(x.encode()) <= n - gone  # halves of cut characters go


def test_decontamination(spark, docs):
    wins = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = decontaminate.words((r["text"] or "").encode())
        for k in range(max(1, len(w) - 7)) if w else ():
            wins.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    want = set()
    for i, x in held(docs).items():
        w = decontaminate.words((x or "").encode())
        if not any(tuple(w[k : k + n]) in wins for n in {len(t) for t in wins} for k in range(len(w) - n + 1)):
            want.add(i)
    got = set(held(stage("decontamination")(spark, docs, SMALL)))
    assert got == want and len(got) < docs.count()


def test_encoding(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    for r in stage("encoding")(spark, docs, SMALL).collect():
        assert r["ids"] == t.encode(r["text"], add_special_tokens=False).ids and r["decoded"] == r["text"]


def jaccard(x, y):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_copies_in_a_crowded_source(spark):
    """Documents of one template share most shingles; each has a closer copy of its own."""
    r = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    template, texts = word(320), []
    for _ in range(3000):
        body = template + word(80)
        texts.append(" ".join(body))
        copy = list(body)
        for place in (330, 341, 352, 363, 374):
            copy[place] = "changed"
        texts.append(" ".join(copy))
    assert jaccard(texts[0], texts[2]) < 0.7 and 0.87 < jaccard(texts[0], texts[1]) < 0.89
    order = r.permutation(len(texts)).tolist()
    rows = [(order[k], x) for k, x in enumerate(texts)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[order[k]] != min(order[k], order[k ^ 1]) for k in range(len(texts))) == 0


def test_copies_at_the_threshold(spark):
    """Pairs of similarity just over 0.8 are all found."""
    r = np.random.default_rng(6)
    rows = []
    for k in range(300):
        body = [f"w{x}" for x in r.integers(0, 1 << 40, 244)]  # 240 shingles
        copy = list(body)
        for place in range(9, 9 + 10 * 5, 10):  # five words more apart than a shingle: 25 shingles go and come
            copy[place] = "changed"
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(copy))]
    assert 0.81 < jaccard(rows[0][1], rows[1][1]) < 0.82
    shared = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x["component_id"] != x["doc_id"] // 2 * 2 for x in shared) == 0


@pytest.mark.parametrize("n, extra, kept", [(8, 1, 1), (9, 1, 1), (7, 1, 2), (10, 1, 1), (12, 3, 2), (16, 3, 1)])
def test_short_texts_are_decided_exactly(spark, n, extra, kept):
    """A text and the same with more words, n - 4 shingles of n - 4 + extra; and such as differ in the last word."""
    rows = []
    for k in range(20):
        body = [f"t{k}w{j}" for j in range(n)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(body + [f"t{k}x{j}" for j in range(extra)]))]
    assert (jaccard(rows[0][1], rows[1][1]) >= 0.8) == (kept == 1)
    assert simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).count() == 20 * kept
    rows = [(k, " ".join(["w"] + [f"t{k // 2}w{j}" for j in range(10)] + [f"last{k}"])) for k in range(40)]
    assert jaccard(rows[0][1], rows[1][1]) == 7 / 9  # eight shingles, seven in common
    assert simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40


def test_links_of_fingerprints_bring_sets_together(spark, monkeypatch):
    """Close copies are found by the links between fingerprints alone, and far texts under one fingerprint are not linked."""
    r = np.random.default_rng(15)
    rows = []
    for k in range(30):
        body = [f"w{x}" for x in r.integers(0, 1 << 40, 600)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join([*body[:-1], "changed"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda: {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(df).collect()}
    want = {i: i // 2 * 2 for i, _ in rows}
    assert groups() == want
    with monkeypatch.context() as m:
        whole = simhash.prefixes
        m.setattr(simhash, "prefixes", lambda *a: whole(*a).where("false"))
        assert groups() == want
    apart = [(x.bit_count(), i) for i, (a, b) in enumerate(zip(rows[::2], rows[1::2])) for x in [(simhash.majority(simhash.shingles(a[1].encode(), 5)) ^ simhash.majority(simhash.shingles(b[1].encode(), 5))) & (1 << 64) - 1]]
    assert max(apart)[0] <= 3
    keep = spark.createDataFrame([(i, k, 7) for i, k in ((1, 10), (2, 11), (3, 12))], "doc_id long, node long, fp long")
    assert {x["label"] for x in simhash.fingerprint_groups(keep).collect()} == {7}
    sets = spark.createDataFrame([(7, k, bytearray(np.arange(k * 100, k * 100 + 50).tobytes())) for k in range(3)] + [(7, 9, bytearray(np.arange(5, 50).tobytes()))], "group long, node long, shingles binary")
    assert {tuple(x) for x in simhash.similar_edges(sets, simhash.Fraction(4, 5)).collect()} == {(0, 9)}


def test_few_edges_take_few_jobs(spark, monkeypatch):
    """Components of a chain, stars and random edges, by rounds and in one task; the latter without the rounds' jobs, whose plans fill the driver."""
    r = np.random.default_rng(9)
    edges = [(k, k + 1) for k in range(-20, 20)] + [(100, k) for k in range(101, 130)] + [(k, 300) for k in range(270, 290)]
    edges += [(5, 5), (1, 0)] + [tuple(x) for x in r.integers(1000, 1200, (150, 2)).tolist()] + [(-(1 << 63), (1 << 63) - 1)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        root[v] = u
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    sc, jobs = spark.sparkContext, {}

    def held(name):
        sc.setJobGroup(name, name)
        rows = simhash.components(df).collect()
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
        sc.setLocalProperty("spark.jobGroup.id", None)
        got = {x["node"]: x["component"] for x in rows}
        assert len(got) == len(rows) and {x: got.get(x, x) for x in want} == want and set(got) <= set(want)

    held("one task")
    with monkeypatch.context() as m:
        m.setattr(simhash, "LOCAL", 0, raising=False)
        held("rounds")
    assert jobs["one task"] <= 6
    assert simhash.components(df.where("a = 5 and b = 5")).count() == 0


def test_training_copies_no_rows(spark, docs):
    """What training brings to the driver is not copied there a second time."""
    import tracemalloc

    rows = docs.where("length(text) > 0").limit(400).selectExpr("doc_id as picked", "repeat(concat(text, ' ', text, ' ', sha2(text, 256), ' '), 2) as text", "cast(doc_id % 2 as int) as y").localCheckpoint()
    entries = 0
    for x in rows.toArrow().column("text").to_pylist():
        places, _ = quality.features([x])
        entries += len(np.unique(np.concatenate(places)))
    peaks = []
    for part in (rows.limit(4), rows):  # the tables of weights are in both
        tracemalloc.start()
        quality.train(part)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert entries > 50_000 and peaks[1] - peaks[0] < 4 * entries
