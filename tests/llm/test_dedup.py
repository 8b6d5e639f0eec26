"""Passage, line and similarity deduplication against brute force."""

import hashlib
import random

from conftest_llm import EDGE, lower, split_words
from rainweave.llm import graph, line_dedup, ngram_join, substring_dedup


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    rows = list(EDGE)
    for i in range(10, 10 + n):
        body = " ".join(rng.choices(words, k=rng.randint(0, 120)))
        if i % 3 == 0:
            body += "\n" + passage + "\n A Line That Several Documents Share \nshort"
        rows.append((i, body))
    base = " ".join(rng.choices(words, k=200)).split()
    for i in range(200, 230):  # near copies, some near enough
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words).upper()
        rows.append((i, " ".join(copy)))
    rows += [(300, rows[20][1]), (301, rows[20][1]), (302, "spam " * 3000), (302, "spam " * 3000)]
    return rows


def expected_passages(rows, n=13):
    low = {}
    for i, t in rows:
        w = split_words(t)
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k:k + n])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t in rows:
        w = split_words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and low[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        out.append((i, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return sorted(out, key=repr)


def test_passages(documents):
    rows = corpus(1)
    got = substring_dedup.remove_repeated(documents(rows, extra=True), width=16)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_passages(rows)


def test_passages_with_a_full_sketch(documents):
    rows = corpus(2, 20)
    got = substring_dedup.remove_repeated(documents(rows), width=4)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_passages(rows)


def test_empty_tables(documents, spark):
    empty = documents([(1, "x")]).where("doc_id = 2")
    assert substring_dedup.remove_repeated(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert ngram_join.similar_components(empty).count() == 0


def test_lines(documents):
    rows = corpus(3)
    key = lambda line: lower(line.strip(" \t\n\r\x0b\x0c"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        want.append((i, hashlib.sha256("\n".join(kept).encode()).hexdigest(), len(lines), len(lines) - len(kept)))
    got = line_dedup.dedup_lines(documents(rows, extra=True), keep=("lang", "h1"))
    assert sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert any(r[3] for r in want)


def test_components(documents):
    rows = [r for r in corpus(4) if r[0] not in (302, None)] + [(400, "a b c d e f"), (401, "A b C d e F"), (402, "one two")]
    sets = {}
    for i, t in rows:
        w = split_words(lower(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = ngram_join.similar_components(documents(rows, extra=True), width=18, level_width=16)
    assert sorted(map(tuple, got.collect())) == sorted((i, len(sets[i]), root(i)) for i in sets)
    assert len({root(i) for i in sets}) < len(sets) - 10


def overlapping_families(seed, groups=12):
    """{doc_id: columns}, columns ordered by number: per group two near documents x > y, whose hubs are near y or neither.

    Half of the first-block columns of x and y lie with y's family f, half with a family g of other documents.
    """
    rng = random.Random(seed)
    ids = [rng.sample(range(100 * k, 100 * k + 50), 6) + rng.sample(range(100 * k + 50, 100 * k + 100), 2) for k in range(1, groups + 1)]
    out = {}
    for k in range(groups):
        at = iter(range(k * 10**6, (k + 1) * 10**6))
        take = lambda n: [next(at) for _ in range(n)]
        own = [take(9) for _ in range(3)]
        ux, uy, ug, a, b, r, rx, ry, rg = (take(n) for n in (3, 3, 12, 9, 9, 75, 4, 4, 79))
        y, x = sorted(ids[k][6:])
        out[x], out[y] = ux + a + b + r + rx, uy + a + b + r + ry
        for i, mine in enumerate(own):
            out[ids[k][i]] = mine + uy + a + r + ry
            out[ids[k][3 + i]] = ug + b + rg
    return out


def test_links_between_overlapping_families(spark):
    sets = {i: set(c) for i, c in overlapping_families(6).items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    rows = []
    for i, c in sets.items():
        c, cut = sorted(c), len(c) - -(-80 * len(c) // 100) + 1
        rows.append((i, len(c), c[:cut], c[cut:]))
    able = spark.createDataFrame(rows, "doc_id long, n long, first array<long>, rest array<long>")
    links = ngram_join._all_links(able, 80).collect()
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in links)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {i: found.get(i, i) for i in sets} == {i: root(i) for i in sets}


def test_repeated_texts_without_words_link_with_nothing(documents):
    rows = [(1, ""), (2, ""), (3, " \t\n"), (4, " \t\n"), (5, ""), (6, None), (7, None), (8, "one two"), (9, "one two"), (10, "\x0b\r"), (11, "\x0b\r"), (12, "\xa0"), (13, "\xa0")]
    got = ngram_join.similar_components(documents(rows), width=16, level_width=16)
    linked = {9: 8, 13: 12}
    assert sorted(map(tuple, got.collect())) == [(i, int(i in (8, 9, 12, 13)), linked.get(i, i)) for i, _ in rows]


def linked(rows):
    """Components of rows (doc_id, text) by brute force: {row number: (size, component)}; rows of one doc_id are linked."""
    sets = []
    for _, t in rows:
        w = split_words(lower(t))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = rows[a][0] is not None and rows[b][0] is not None
            if both and (rows[a][0] == rows[b][0] or sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [(i, len(sets[k]), low.get(root(k)) if i is not None else None) for k, (i, _) in enumerate(rows)]


def test_components_with_repeated_and_null_ids(documents):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    for i in range(120, 150):  # families of near copies
        copy = rows[i % 12 + 20][1].split()
        copy[-1:] = [rng.choice(words)]
        rows.append((i, " ".join(copy)))
    for _ in range(40):  # ids again, with the text of an earlier document, another one, none, or the same
        i = rng.randrange(150)
        rows.append((i, rng.choice([rows[rng.randrange(i + 1)][1], " ".join(rng.choices(words, k=30)), "", None, rows[i][1]])))
    rows += [(None, rows[3][1]), (None, None), (None, ""), (7, None), (8, " ")]
    got = ngram_join.similar_components(documents(rows, extra=True), width=18, level_width=16)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(linked(rows), key=repr)


def test_no_setting_is_changed(documents, spark):
    from rainweave.llm import decontaminate, language_id, sentencepiece_codec, warc
    from rainweave.llm.queries import piece_model
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = documents(EDGE)
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for build in (lambda: substring_dedup.remove_repeated(docs, width=12), lambda: line_dedup.dedup_lines(docs, width=12), lambda: ngram_join.similar_components(docs, width=12, level_width=12),
                  lambda: decontaminate.contained_items(docs, items, width=12), lambda: language_id.predict(docs, language_id.fit(docs)),
                  lambda: sentencepiece_codec.encode_texts(docs, piece_model()), lambda: warc.classify(docs, "doc_id", "lang", "text")):
        build()
        assert spark.conf.get(name) == before
