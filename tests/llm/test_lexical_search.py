"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import EDGE, lower
from rainweave.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if i is not None and t is not None]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)] + ["é", "x_y", "Straße", "\U0001F600", "don't", "中文"]
    pick = lambda: words[min(int(rng.expovariate(0.03)), len(words) - 1)]
    rows = EDGE + [(i, " ".join(pick() for _ in range(rng.choice([1, 5, 30, 300])))) for i in range(10, 10 + n)]
    rows += [(i, rows[20][1].upper()) for i in range(5000, 5150)] + [(5000, rows[20][1]), (7000, "w150 " * 20000), (None, "w150 w151")]
    items = [(k, " ".join(pick() for _ in range(rng.choice([1, 3, 40])))) for k in range(12)] + [(20, rows[20][1]), (21, None), (22, " ,. "), (23, "unknownterm"), (None, "w1"), (3, "w2 w3 w2")]
    return rows, items


@pytest.mark.parametrize("postings", [1 << 20, 300])
def test_ranking(spark, documents, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "MOST_POSTINGS", postings)
    rows, items = corpus(3)
    table = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, rank int, doc_id int")
    docs = documents(rows, extra=True).withColumnRenamed("h1", "score").withColumnRenamed("low", "n")
    got = lexical_search.rank_documents(docs, table, k=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, items, 50)


def test_blocks_of_items(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEM_BLOCK", 4)
    rows, items = corpus(4, 60)
    got = lexical_search.rank_documents(documents(rows), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, items, 5)


def test_nothing_to_search(spark, documents):
    docs, items = documents([(1, "a b"), (2, None)]), spark.createDataFrame([(1, "a"), (2, "")], "item_id long, text string")
    assert lexical_search.rank_documents(docs.where("doc_id > 5"), items).count() == 0
    assert lexical_search.rank_documents(docs.where("doc_id = 2"), items).count() == 0
    assert lexical_search.rank_documents(docs, items.where("item_id = 2")).count() == 0
    assert lexical_search.rank_documents(docs, items.where("item_id > 5")).count() == 0


def test_few_documents_are_scored():
    """Rare terms: the search ends long before it has met every document."""
    rng = np.random.default_rng(1)
    owner, term = np.repeat(np.arange(20_000), 3), rng.zipf(1.5, 60_000) % 5000
    pairs = np.unique(owner * 5000 + term)
    impact = rng.integers(1, 10**6, len(pairs))
    shard = lexical_search.Shard(np.arange(20_000) * 3, 5000, pairs // 5000, pairs % 5000, impact)
    met = []
    whole = shard.bounds
    shard.bounds = lambda left, right: met.append(len(left)) or whole(left, right)
    terms = np.array([1, 2, 3, 40, 500, 4999])
    sums = np.bincount(pairs // 5000, np.where(np.isin(pairs % 5000, terms), impact, 0), 20_000).astype(int)
    want = sorted(((int(s), i * 3) for i, s in enumerate(sums) if s), key=lambda x: (-x[0], x[1]))[:50]
    assert shard.best(terms, 50, 0) == want
    assert sum(met) / 2 < 20_000 / 4  # two intervals for each document scored
    floor = want[20][0]
    assert shard.best(terms, 50, floor) == [x for x in want if x[0] >= floor]
