"""Chat trees, shards, neighbours, classifiers and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, neighbours, quality, queries, sharding, toxicity
from tests.conftest import DATA

SMALL, MEDIUM = f"{DATA}/sf0.001", f"{DATA}/sf0.01"


def test_chat_equals_sql(spark, duck, same):
    same(queries.QUERIES["op5_chat"](spark, SMALL).toPandas(), duck(queries.ORACLES["op5_chat"], "sf0.001"))


def test_chat_trees(spark):
    rows = [("c", 1, None, "user", "hi", 0.0), ("c", 2, 1, "assistant", "a\\h###</turn>", 1.0), ("c", 3, 1, "assistant", None, 2.0), ("c", 4, 3, "us:er\n", "x", 0.5), ("c", 5, 99, "user", "lone", 0.0), ("d", 1, 2, "user", "loop", 0.0), ("d", 2, 1, "user", "loop", 0.0)]
    m = spark.createDataFrame(rows, "conv_id string, id long, parent long, role string, text string, score double").fillna({"text": ""})
    back = {r["leaf"]: r for r in chat.read_back(chat.formatted(m)).collect()}
    assert set(back) == {2, 4, 5}  # a loop has no leaf
    assert [tuple(t) for t in back[2]["turns"]] == [("user", "hi"), ("assistant", "a\\h###</turn>")] and back[2]["loss"] == ["a\\h###</turn>"]
    assert [tuple(t) for t in back[4]["turns"]] == [("user", "hi"), ("assistant", ""), ("us:er\n", "x")]
    assert (back[4]["rank"], back[2]["rank"]) == (1, 2)
    best = [r["leaf"] for r in chat.formatted(m, best=1).collect()]
    assert sorted(best) == [4, 5]
    long = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert len(chat.read_back(chat.formatted(chat.linear(long))).first()["turns"]) == 300
    assert chat.formatted(chat.linear(long.limit(0))).count() == 0


def test_chat_null_conversation(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.formatted(chat.linear(turns))).collect()}
    assert got == {None: [("user", "a"), ("assistant", "b")], 7: [("user", "c")]}
    assert {r["conv_id"] for r in chat.formatted(chat.linear(turns), best=1).collect()} == {None, 7}


def test_shards(spark):
    got = queries.QUERIES["op8_shards"](spark, MEDIUM).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got.itertuples():
        data = (docs[r.doc_id] or "").encode()
        assert (r.size if not callable(r.size) else got.loc[r.Index, "size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    sums = got.groupby("shard")["size"].sum()
    assert set(sums.index) == set(range(24)) and sums.max() < 1.02 * sums.min()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_shard_map_grows_into_new_shards_alone(spark, tmp_path):
    rows = sharding.measured(spark.read.parquet(f"{MEDIUM}/documents.parquet"))
    slots = sharding.slot_bytes(rows).persist()
    one = sharding.slot_map(slots, 8)
    sharding.store_map(one, str(tmp_path / "map"))
    two = sharding.grown(sharding.load_map(spark, str(tmp_path / "map")), slots, 8)
    sharding.store_map(two, str(tmp_path / "map"))
    assert sharding.load_map(spark, str(tmp_path / "map")).first()["version"] == 2
    both = two.withColumnRenamed("shard", "new").join(one.drop("version"), "virtual_slot").join(slots, "virtual_slot").toPandas()
    assert set(both[both["new"] != both["shard"]]["new"]) == {8}
    share = both[both["new"] == 8]["bytes"].sum() / both["bytes"].sum()
    assert 0.08 < share < 0.16


def test_shard_edges(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (1, "a", "x")], "doc_id long, text string, shard string")
    got = sharding.shard_by_bytes(df, 3).toPandas()
    assert len(got) == 4 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shard_by_bytes(df.limit(0), 3).count() == 0


def test_neighbours_recall(spark):
    got = queries.QUERIES["op3_multi_index"](spark, f"{DATA}/sf0.1").toPandas()
    e = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    found = wanted = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(g) + 1)) and list(g["score"]) == sorted(g["score"])
        assert np.allclose(g["score"], [d[ids == v][0] for v in g["vec_id"]], rtol=0, atol=1e-12)
        found, wanted = found + len(set(best) & set(g["vec_id"])), wanted + 10
    assert set(got["query_id"]) == {int(v) for v in ids if v % 100 == 0} and found / wanted >= 0.9


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (7, [1.0]), (100, [0.5, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 100), (0, 6), (0, 6), (100, 0), (100, 1), (100, 6), (100, 6)]
    assert neighbours.nearest(df.limit(0)).count() == 0
    one = np.array([0.0, 1.0, 2.0])
    cells = neighbours.traverse(one, one, np.ones(neighbours.CELLS), 9)
    sums = [one[c // neighbours.CENTROIDS] + one[c % neighbours.CENTROIDS] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == 9


def auc(score, y):
    r = score.argsort().argsort() + 1
    return (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize("name, label, least, parts, part", [("op6_quality", "quality", 0.97, 4, 2), ("op7_toxicity", "toxic", 0.85, 5, 0)])
def test_classifiers_on_held_out_labels(spark, name, label, least, parts, part):
    sf = f"{DATA}/sf0.1"
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert ((got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % parts == part)) == got["held_out"]).all()
    assert got["score"].between(0, 1).all()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    m = m[m["held_out"]]
    assert auc(m["score"].to_numpy(), (m[label] == 1).to_numpy()) > least


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, "idiot " * 50, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    q = quality.classify(docs, labels)
    assert q.count() == 4 and q.where("predicted = 1").count() == 4 and q.columns[:2] == ["doc_id", "text"]
    assert toxicity.classify(docs, labels.limit(0)).where("predicted = 0").count() == 4
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_network_gradients():
    net, words = toxicity.Net(), toxicity.Inputs.of(["idiot", "the", "word", ""])
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    table = np.array([[0, 1, 2, 3] * 8, [1, 1, 4, 2] * 8])
    y, weight = np.array([1.0, 0.0]), np.array([0.5, 0.5])

    def loss():
        p = toxicity.sigmoid(net.margins(net.vectors(words), table))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = net.gradients(words, table, y, weight)
    for name, at in (("o", 0), ("c", 0), ("v", 1), ("A", (2, 1)), ("Uf", (1, 3)), ("Ub", (2, 20)), ("Wf", (3, 5)), ("bb", 4), ("E", (int(words.place[0]), 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name


def test_windows_cover_all_words():
    ids, offsets = np.arange(100), np.array([0, 0, 5, 37, 100])
    table, text = toxicity.window_table(ids, offsets, 100)
    for t in range(4):
        assert set(table[text == t].ravel()) - {100} == set(range(offsets[t], offsets[t + 1]))


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "suffix_dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 100 and got.where("decoded <> text").count() == 0


def test_toxicity_learns_from_any_window_of_a_long_text():
    """One bad word in a text of thousands, wherever it stands."""
    r = np.random.default_rng(21)
    texts, y = [], []
    for k in range(240):
        words = [f"w{x}" for x in r.integers(0, 300, 2000)]
        if k % 2:
            words[int(r.integers(2000))] = "grobnik"
        texts.append(" ".join(words))
        y.append(k % 2)
    net = toxicity.train(texts[:200], np.array(y[:200]))
    got = net.scores(texts[200:])
    assert ((got >= 0.5) == np.array(y[200:])).mean() >= 0.9
