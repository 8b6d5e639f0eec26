"""Decontamination, language identification and subword encoding."""

import random

import pytest
from conftest_llm import EDGE, lower, split_words
from pyspark.sql import functions as F
from rainweave.llm import decontaminate, language_id, sentencepiece_codec
from rainweave.llm.queries import held_out, piece_model

SF = "/root/testdata/sf0.01"


def test_contained_items(documents, spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 50)))) for k in range(20)] + [(50, None), (51, ""), (None, "a b c d e f g"), (0, "other text of one id")]
    rows = list(EDGE)
    for i in range(100, 160):
        body = rng.choices(words, k=rng.choice([20, 3000]))
        item = split_words(items[i % 20][1])
        cut = rng.choice([0, 1, 2, 8])
        rows.append((i, " ".join(body[:10] + item[cut:] + body[10:]).upper()))
    rows.append((170, items[3][1]))
    shingles = lambda t: ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) if (w := split_words(lower(t))) is not None else set()
    want = {(i, k, len(shingles(t) & shingles(x)), len(shingles(x))) for i, t in rows for k, x in items if i is not None and k is not None
            and shingles(x) and 100 * len(shingles(t) & shingles(x)) >= 80 * len(shingles(x))}
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(documents(rows, extra=True), table, width=16)
    assert {tuple(r)[:4] for r in got.collect()} == want
    assert len(want) > 20


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out())
    model = language_id.fit(docs.where("not held_out"))
    rows = language_id.predict(docs.where("held_out"), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(documents):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 34 !!", "en"), (5, "", None), (6, "the dog", None)]
    docs = documents(rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model, keep=("doc_id",)).collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    nothing = language_id.fit(docs.where("doc_id = 9"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing, keep=("doc_id",)).collect()} == {"und"}


def reference(kind):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(piece_model())
    proto.trainer_spec.model_type = kind
    raw = proto.SerializeToString()
    return raw, sentencepiece.SentencePieceProcessor(model_proto=raw)


def texts():
    rng = random.Random(1)
    alphabet = "etaoinshr .,;:()[]{}\"'/*-_=+0123456789ABCabc\n\t é中\U0001F600"
    return ["", " ", "  a  b ", "a▁b", "日本語 テスト"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 90))) for _ in range(1500)]


def test_bpe_equals_the_library():
    raw, library = reference(2)
    codec = sentencepiece_codec.Codec(raw)
    got = [ids.tolist() for ids in codec.encode(texts())]
    assert got == library.encode(texts())
    assert [codec.decode(ids) for ids in got] == library.decode(got)


def test_unigram_finds_a_best_path():
    codec = sentencepiece_codec.Codec(reference(1)[0])
    score = lambda p: codec.scores.get(p, codec.lowest)
    for word in ("▁the", "▁and", "▁inthing", "▁abcab", "▁x1é"):
        best = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max(best[k] + score(word[k:end]) for k in range(end) if word[k:end] in codec.scores or end - k == 1)
        states = [(0, 0.0, ())]
        codec._best_states(word, states)
        assert states[-1][1] == pytest.approx(best[-1])


def test_encode_documents(documents):
    rows = documents(EDGE + [(9, "x" * 5000), (9, "x" * 5000)], extra=True)
    got = sentencepiece_codec.encode_texts(rows, piece_model(), keep=("doc_id", "text"))
    for r in got.collect():
        assert (r.token_ids is None) == (r.text is None) and r.round_trip in ((None,) if r.text is None else (True,))
    back = sentencepiece_codec.decode_tokens(got.withColumnRenamed("text", "before"), piece_model(), keep=("doc_id", "before"))
    assert all(r.before == r.text for r in back.collect())


def test_runs_of_spaces():
    import time
    raw, library = reference(2)
    codec = sentencepiece_codec.Codec(raw)
    rng = random.Random(3)
    rows = [" " * rng.randint(1, 40) + rng.choice(["", "word", "x", "é", "  "]) + " " * rng.randint(0, 70) for _ in range(300)]
    assert [ids.tolist() for ids in codec.encode(rows)] == library.encode(rows)
    start = time.time()
    long = " " * 200_000 + "x" + " " * 5
    ids = codec.encode([long])[0]
    assert time.time() - start < 2
    assert codec.decode(ids.tolist()) == long
    assert ids.tolist() == library.encode(long)
    assert not any(len(w) > sentencepiece_codec.KEPT_LENGTH for w in codec.words)


def test_more_labels_than_one_lot(documents, monkeypatch):
    rows = [(k, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} the", f"l{k:03}") for k in range(600)]
    docs = documents(rows)
    model = language_id.fit(docs, buckets=1 << 12)
    assert len(model.languages) == 600 and len(model.weights) == 3
    monkeypatch.setattr(language_id, "LABELS", 1000)
    whole = language_id.fit(docs, buckets=1 << 12)
    texts = [t for _, t, _ in rows[::50]]
    assert language_id.score(texts, model)[0] == language_id.score(texts, whole)[0]
    assert language_id.score(texts, model)[1] == pytest.approx(language_id.score(texts, whole)[1])


def test_posteriors_by_definition(documents):
    import math
    from collections import Counter
    rows = [(1, "the cat", "en"), (2, "The hat!", "en"), (3, "le chat", "fr"), (4, "die katze", "de"), (5, None, "fr"), (6, "x", None)]
    model = language_id.fit(documents(rows))

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = " " + " ".join(t.split()) + " "
        return [t[k:k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)]

    counts = {lang: Counter(g for _, t, x in rows if t and x == lang for g in grams(t)) for lang in ("de", "en", "fr")}
    prior = {"de": 1, "en": 2, "fr": 1}

    def posterior(t):
        logs = {lang: math.log(prior[lang] / 4) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * language_id.BUCKETS)) for g in grams(t)) for lang, c in counts.items()}
        total = sum(math.exp(v - max(logs.values())) for v in logs.values())
        return max(logs, key=logs.get), 1 / total

    texts = ["the", "chat", "katze die", "a", "zzz"]
    got = language_id.score(texts, model)
    assert list(zip(*got)) == [(lang, pytest.approx(value, rel=1e-4)) for lang, value in map(posterior, texts)]


def test_columns_of_any_name(documents, spark):
    import corpus_pipeline as p
    docs = documents([(k, "the cat sat on the mat with the hat " * 3 + str(k), "en") for k in range(1, 12)]).withColumns(
        {name: F.lit("x") for name in ("source", "score", "lang_pred", "_text", "kept", "n_dropped", "n_lines", "held_out", "component_id", "item_id", "packed")})
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() > 0, name
    assert p.STAGES[-1][1](spark, docs, SF).count() == 11
    got = sentencepiece_codec.encode_texts(docs, piece_model(), keep=("doc_id", "_text", "kept"))
    assert got.columns == ["doc_id", "_text", "kept", "token_ids", "round_trip"] and got.count() == 11


def test_empty_tables(documents, spark):
    import corpus_pipeline as p
    empty = documents([(1, "x")]).where("doc_id = 2").withColumns({"source": F.lit("x"), "n_chars": F.lit(1).cast("long")})
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.contained_items(documents([(1, "x y z")]), items.where("item_id = 9")).count() == 0
    assert sentencepiece_codec.encode_texts(empty, piece_model()).count() == 0
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_very_long_texts(documents, spark):
    long = "the cat and the dog " * 60_000
    docs = documents([(1, long, "en"), (2, "der hund und die katze", "de")])
    model = language_id.fit(docs)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model, keep=("doc_id",)).collect()} == {1: "en", 2: "de"}
    items = spark.createDataFrame([(1, "dog the cat and the dog")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contained_items(docs, items, width=16).collect()] == [1]
