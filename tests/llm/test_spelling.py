"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import pytest
from conftest_llm import EDGE, lower
from rainweave.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def some_words(seed, n=400, letters="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randint(7, 9))) for _ in range(n)}
    for w in sorted(words)[:150]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]}
    return sorted(words | {"", "a", "b", "ab", "é", "x" * 5000, "x" * 5001, "x" * 4999 + "y"})


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_near_pairs(spark, parts):
    words = some_words(parts)
    table = spark.createDataFrame([(w, 1, 2) for w in words] + [(None, 1, 2)], "word string, key long, n long")
    got = sorted(map(tuple, spelling.near_pairs(table, parts).collect()))
    assert got == [(a, b) for a in words for b in words if a < b and near(a, b)]
    assert len(got) > 100


def test_groups(spark):
    rng = random.Random(9)
    n = {w: rng.choice([2, 3, 20, 30, 300, 3000]) for w in some_words(8)}
    want = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        top = min(others, key=lambda x: (-n[x], x), default=None)
        form = top if others and n[top] >= 10 * n[w] else None
        want[w] = (form, n[w], len(others), n[form] if form else None)

    def root(w):
        return root(want[w][0]) if want[w][0] else w

    table = spark.createDataFrame([(w, k, "x", 1) for w, k in n.items()], "word string, n long, form string, n_near int")
    got = spelling.spelling_variants(table)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: (r.form, r.n, r.n_near, r.form_n) for r in got.collect()} == want
    assert {r.word: r.root for r in got.collect()} == {w: root(w) for w in n}
    assert any(want[v[0]][0] for v in want.values() if v[0])
    assert spelling.spelling_variants(table.where("n < 0")).count() == 0


def test_counts(spark, documents, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    text = "Variants of a word: VARIANTS variånts ÀÈÌÒÙàèì abcdefg×hij abc_defghij " + "long" * 9000 + "\n" + "ordinary " * 300
    rows = EDGE + [(k, text) for k in range(40, 60)] + [(40, text), (61, "once only seenonce")]
    want, plain = Counter(), Counter()
    for i, t in rows:
        for w in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in lower(t)).split():
            plain[w] += t is not None
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None:
                want[w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w] += 1
    fine = lambda c: {w: k for w, k in c.items() if len(w) >= 7 and k >= 2}
    docs = documents(rows, extra=True).withColumnRenamed("low", "word").withColumnRenamed("h1", "n")
    got = {r.word: r.n for r in spelling.word_counts(docs, damage_every=31).collect()}
    assert got == fine(want) and len(got) > 5
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == fine(plain)
    assert spelling.word_counts(docs.where("doc_id = -1"), damage_every=31).count() == 0
