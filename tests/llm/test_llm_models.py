"""Fitted models and neighbour search, and the registered queries on the smallest tables."""

import random

import numpy as np
import pytest

FOLDER = "/root/testdata/sf0.001"


def texts(count=240):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("an", "el", "or", "ist")]
    rows = []
    for k in range(count):
        own = rng.choices(words, k=40)
        if k % 4 == 0:
            own[rng.randrange(40)] = "rotten"
            own[rng.randrange(40)] = "rotten,"
        rows.append((k, " ".join(own), int(k % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = texts()
    docs = spark.createDataFrame(
        [(d, t, 0.5, 3) for d, t, _ in rows] + [(900, None, 0.5, 3), (901, "", 0.5, 3), (None, "rotten rotten", 0.5, 3)],
        "doc_id long, text string, score double, label int")
    labels = [(d, y) for d, _, y in rows] + [(None, 1), (5, None), (7, 0), (7, 1), (8, 1), (4000, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, mark int")


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_classifier(spark, labelled, kind):
    from lodeseek.llm import quality, toxicity
    from lodeseek.llm.nbsvm import held_out

    docs, labels = labelled
    train, score = {"quality": (quality.quality_model, quality.quality_scores),
                    "toxicity": (toxicity.toxicity_model, toxicity.toxicity_scores)}[kind]
    model = train(docs, labels.where(~held_out("doc_id")), "mark")
    result = score(docs, model, threshold=0.5)
    assert sorted(result.columns) == ["doc_id", "label", "predicted", "score", "text"]
    got = result.withColumn("held", held_out()).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = {d: y for d, _, y in texts()}
    judged = [r for r in got if r.held and r.doc_id in known]
    assert len(judged) > 20 and sum(r.predicted == known[r.doc_id] for r in judged) >= 0.95 * len(judged)
    none = {r.score for r in got if not r.text}
    assert len(none) == 1


def test_classifier_without_two_classes(spark, labelled):
    from pyspark.sql import functions as F

    from lodeseek.llm.toxicity import toxicity_model, toxicity_scores

    docs, labels = labelled
    assert toxicity_model(docs, labels.limit(0), "mark").score("x") == pytest.approx(0.5)
    assert toxicity_model(docs, labels.where("mark = 1"), "mark").score("x") > 0.9
    assert toxicity_model(docs, labels.where("mark = 0"), "mark").score("x") < 0.1
    model = toxicity_model(docs.limit(0), labels, "mark")
    assert toxicity_scores(docs.limit(0), model).select(F.count("*")).first()[0] == 0


def test_dual_coordinate_descent_is_near_the_least_loss():
    from lodeseek.llm.nbsvm import dual_coordinate_descent

    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    values = [np.ones(6, np.float32) for _ in rows]
    signs = np.array([1.0 if 3 in r or 7 in r else -1.0 for r in rows])

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - y * (w[r].sum() + b)) for r, y in zip(rows, signs, strict=True))

    w, b = dual_coordinate_descent(rows, values, signs, 30, rounds=3000)
    v, c, least = np.zeros(30), 0.0, np.inf
    for step in range(1, 6000):
        g, h = v.copy(), c
        for r, y in zip(rows, signs, strict=True):
            if y * (v[r].sum() + c) < 1:
                g[r] -= y
                h -= y
        v, c = v - g / (step + 10), c - h / (step + 10)
        least = min(least, loss(v, c))
    assert loss(w.astype(float), b) <= least * 1.01


def test_log_count_ratios():
    from lodeseek.llm.nbsvm import log_count_ratios

    rows = [np.array([0, 1])] * 30 + [np.array([1, 2])] * 30
    labels = np.array([1] * 30 + [0] * 30)
    ratio = log_count_ratios(rows, labels, 4)
    assert ratio[0] == pytest.approx(np.log(31 / 32) - np.log(1 / 32), rel=1e-5)
    assert ratio[2] == -ratio[0] and ratio[1] == 0 and ratio[3] == 0


def brute(ids, vectors, queries, k):
    from lodeseek.llm.vantage_trees import inner_products

    out = {}
    for q in queries:
        scores = inner_products(vectors, vectors[ids == q][0])
        rows = [r for r in np.lexsort((ids, -scores)) if ids[r] != q][:k]
        out[q] = [(rank + 1, int(ids[r]), float(scores[r])) for rank, r in enumerate(rows)]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_exact(spark, monkeypatch, kind):
    from lodeseek.llm import vantage_trees

    monkeypatch.setattr(vantage_trees, "SHARD", 150)
    monkeypatch.setattr(vantage_trees, "BLOCK", 20)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(500, 8)).astype(np.float32)
    vectors[100:180] = vectors[40]  # a common vector
    vectors[7] *= 9
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    bad = [(600, None, 1), (620, [0.0] * 8, 1), (640, [float("nan")] + [1.0] * 7, 1), (660, [None] + [1.0] * 7, 1),
           (680, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (700, [1.0] * 3, 1), (720, [2.0] * 3, 1)]
    frame = spark.createDataFrame([*rows, *bad, rows[20]], f"vec_id long, embedding array<{kind}>, rank int")
    got = {}
    for r in vantage_trees.nearest(frame, frame.where("vec_id % 20 = 0"), k=20, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = brute(np.arange(500), vectors.astype(np.float64), range(0, 500, 20), 20)
    wanted |= {700: [(1, 720, 6.0)], 720: [(1, 700, 6.0)]}
    assert {q: sorted(v) for q, v in got.items()} == wanted
    assert vantage_trees.nearest(frame.limit(0), frame, k=3).collect() == []
    assert vantage_trees.nearest(frame, frame.limit(0), k=3).collect() == []


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall_with_unlike_lengths(spark, spread):
    from lodeseek.llm.queries import VANTAGE_FACTOR
    from lodeseek.llm.vantage_trees import nearest

    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors *= np.exp(spread * rng.normal(size=3000))[:, None]
    vectors[11] *= 3 * np.linalg.norm(vectors, axis=1).max() / np.linalg.norm(vectors[11])  # a very long one
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    wanted = brute(np.arange(3000), vectors, range(0, 3000, 20), 20)
    rows = nearest(frame, frame.where("vec_id % 20 = 0"), k=20, factor=VANTAGE_FACTOR).collect()
    found = {(r.query_id, r.vec_id) for r in rows}
    true = {(q, v) for q, best in wanted.items() for _, v, _ in best}
    assert len(rows) == len(true) and len(found & true) >= 0.9 * len(true)


def test_recall_on_the_smallest_tables(spark):
    from lodeseek.llm.queries import QUERIES, table

    rows = table(spark, FOLDER, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], np.float64)
    wanted = brute(ids, vectors, ids[ids % 20 == 0].tolist(), 20)
    found = {(r.query_id, r.vec_id) for r in QUERIES["op8_nearest_neighbours"](spark, FOLDER).collect()}
    true = {(q, v) for q, best in wanted.items() for _, v, _ in best}
    assert len(found & true) >= 0.9 * len(true)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    from lodeseek.llm.staging import staged

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(5000, None, "en", None, None), (5001, "", None, "src0", 0), (None, "x y", "en", "src1", 3)], docs.schema)
    docs = staged(docs.union(docs.limit(3)).union(odd))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, FOLDER)
        if name != "packed_pieces":
            assert result.columns == docs.columns and result.dtypes == docs.dtypes
            assert stage(spark, docs.limit(0), FOLDER).count() == 0
        before, docs = docs, staged(result)
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if name not in ("quality_filter", "drop_near_copies"):
            assert ids(docs) == ids(before)
    assert docs.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES].index("quality_filter") == 0


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("values", [(-1.0, 1.0), (0.0, 1.0, 2.0)])
def test_nearest_with_ties_everywhere(spark, monkeypatch, values):
    from lodeseek.llm import vantage_trees as module

    monkeypatch.setattr(module, "SHARD", 150)
    monkeypatch.setattr(module, "LEAF", 16)
    rng = np.random.default_rng(4)
    vectors = rng.choice(values, (400, 12)).astype(np.float32)
    vectors[:, 0] += (vectors == 0).all(1)
    ids = rng.permutation(1000)[:400]
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    queries = sorted(i for i in ids.tolist() if i % 20 == 0)
    found = module.nearest(frame, frame.where("vec_id % 20 = 0"), k=20, factor=1.0).collect()
    want = brute(ids, vectors.astype(np.float64), queries, 20)
    got = {q: sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q) for q in queries}
    assert got == want
