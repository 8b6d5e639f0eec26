"""Toxicity scores: the update rule against a plain one, features against brute force, held-out rows, and edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import EDGE
from rainweave.llm import toxicity
from rainweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def plain_ftrl(rows, size, alpha, beta, l1, l2):
    """The published per-coordinate update, one example and one coordinate at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i, l1):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for y, features in rows:
        w = {i: weight(i, l1 if i < size else 0.0) for i in [*features, size]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    return z, n


def test_the_update_rule():
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), sorted(rng.sample(range(40), rng.randint(0, 8)))) for _ in range(300)]
    z, n = np.zeros(41), np.zeros(41)
    bounds = np.concatenate(([0], np.cumsum([len(f) for _, f in rows])))
    toxicity.learn(z, n, np.array([y for y, _ in rows]), np.array([i for _, f in rows for i in f]), bounds, 0.7, 1.0, 0.5, 0.1, batch=1)
    want = plain_ftrl(rows, 40, 0.7, 1.0, 0.5, 0.1)
    assert z == pytest.approx(want[0]) and n == pytest.approx(want[1])


def test_features_are_words_pairs_and_skip_pairs():
    texts = ["a b c a b", "A, b! C", None, "", "x", "b a"]
    features, bounds = toxicity.distinct_features(pa.array(texts))
    own = [set(features[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    # a b c | a_b b_c c_a | a__c b__a c__b, with two of each of a, b and a_b
    assert [len(s) for s in own] == [9, 6, 0, 0, 1, 3]
    assert own[1] < own[0] and len(own[5] & own[0]) == 2


def test_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op11_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) > 0.95 * len(toxic) * len(clean)
    assert sum(p for _, y, p in held if not y) <= 0.005 * len(clean)
    assert sum(p for _, y, p in held if y) >= 0.7 * len(toxic)


def labelled(spark, n=600):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(1, 30))
        if i % 5 == 0:
            body.insert(rng.randrange(len(body)), "HORRID")
        rows.append((i, " ".join(body), int(i % 5 == 0), 1, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, y int, features string")


def test_any_order_and_dealing_gives_one_model(spark):
    rows = labelled(spark)
    models = [toxicity.fit(df.drop("toxic"), df.drop("text"), shard_rows=200, width=16, rounds=6) for df in (rows, rows.repartition(7).orderBy("text"))]
    assert models[0].bias == models[1].bias and (models[0].features == models[1].features).all() and (models[0].weights == models[1].weights).all()
    own = toxicity.distinct_features(pa.array(["horrid"]))[0]
    assert models[0].features[models[0].weights.argmax()] == own[0]
    few = toxicity.fit(rows, rows, most=100, width=12, rounds=1)
    assert len(few.features) <= 1 << 12


def test_edges(spark, documents):
    model = toxicity.fit(labelled(spark), labelled(spark), shard_rows=1000, width=16)
    long = "w1 w2 w3 " * 60_000
    docs = documents(EDGE + [(20, long), (21, long + "horrid"), (22, "horrid")], extra=True).withColumnRenamed("h1", "score").withColumnRenamed("low", "kept")
    got = {r.kept.doc_id: r.score for r in toxicity.predict(docs, model, keep=("doc_id", "score")).collect()}
    assert len(got) == len(EDGE) + 3 and got[1] == got[2] == got[3] < 0.5
    assert got[22] >= 0.7 and got[21] > got[20]
    empty = toxicity.fit(labelled(spark), labelled(spark).where("doc_id < 0"), width=12, rounds=2)
    assert not len(empty.features)
    assert {r.score for r in toxicity.predict(docs, empty).collect()} == {0.5}
    assert not len(toxicity.fit(labelled(spark).where("doc_id < 0"), labelled(spark), width=12, rounds=1).features)
    unlabelled = toxicity.fit(labelled(spark), labelled(spark).selectExpr("doc_id", "text", "cast(null as int) AS toxic"), width=12, rounds=1)
    assert not len(unlabelled.features)
    assert toxicity.predict(docs.where("doc_id < 0"), model).count() == 0
