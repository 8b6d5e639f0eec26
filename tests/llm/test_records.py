"""Archives, preference formatting, licences, neighbours, and the pipeline."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from rainweave.llm import chat_format, license_scan, neighbours, warc

SF = "/root/testdata/sf0.001"


def test_archives(spark, tmp_path):
    long, mid = "é<p>" * 90_000, "m" * 1500
    rows = [(1, "http://a/ b", long), (2, None, mid), (3, "u", mid), (7, "u", mid), (7, "u", mid), (8, "u", None), (9, "u", ""), (10, "u", "short"),
            (11, "u", "short"), (12, "u", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 100), (None, "u", mid)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(warc.classify(pages), str(tmp_path / "w"), segment_bytes=1000, records_per_file=7)
    back = warc.reassemble(warc.read_archives(spark, str(tmp_path / "w")))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.problem) for r in warc.resolve_revisits(back).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == mid and i is not None and i < 7
        want.append((i, "revisit" if again else "response", 7 if again else None, len(data), hashlib.sha1(data).hexdigest(), None))
    assert got == sorted(want, key=repr)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    cut = records.where("segment = 2").count()
    assert cut > 1 and warc.reassemble(records.where("segment is null or segment <> 2")).where("problem is not null").count() == cut


def test_broken_chunks():
    assert warc.unchunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "q"), (1, 3, "assistant", "good"), (2, 0, None, None), (3, 0, "user", "x"), (None, 0, "user", "x")]
    other = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "q"), (1, 3, "assistant", "bad"), (2, 0, None, None)]
    schema = "pair_id long, turn long, role string, text string"
    got = {r.pair_id: r for r in chat_format.format_preferences(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert r.prefix_turns == 3 and r.prompt.count("<|im_start|>") == 3 and "good" in r.chosen and "bad" in r.rejected
    assert [(s.text, s.mask) for s in r.chosen_segments] == [("<|im_start|>assistant\n", 0), ("good<|im_end|>\n", 1)]
    assert got[2].prefix_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].prefix_turns == 0 and got[3].rejected == "" and got[3].rejected_segments == []
    for r in got.values():
        assert "".join(s.text for s in r.chosen_segments) == r.chosen


def test_substitute_reply(spark):
    turns = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "r0"), (1, 0, "user", "b"), (1, 1, "assistant", "r1"), (2, 0, "user", "c")],
                                  "conv_id long, turn long, role string, text string")
    chosen, rejected = chat_format.with_substitute_reply(turns)
    assert sorted(map(tuple, rejected.collect())) == [(0, 0, "user", "a"), (0, 1, "assistant", "r1"), (1, 0, "user", "b"), (1, 1, "assistant", "r0"), (2, 0, "user", "c")]
    assert chosen.count() == 5


def test_licences(spark):
    rows = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "/a/b/c/x.py", "plain words only"), (3, "/a/b/LICENSE-2", "intro\nLicensed under the Apache License, Version 2.0.\nend"),
            (4, "/a/b/c/y.py", "x\nReleased under the MIT license\n" + "noise words " * 200), (5, "/z/q.py", None), (6, None, "nothing here"), (7, "/a/q.py", ""), (8, "/z/LICENSE", "no licence at all in here")]
    files = spark.createDataFrame([(*r, 1) for r in rows], "file_id long, path string, text string, word int")
    got = {r.file_id: (r.license, r.inherited_from) for r in license_scan.scan(files).collect()}
    assert got == {1: ("MIT", None), 2: ("Apache-2.0", "/a/b"), 3: ("Apache-2.0", None), 4: ("MIT", None), 5: (None, None), 6: (None, None), 7: ("MIT", "/a"), 8: (None, None)}
    # scores against the definition
    units = {i: t.split("\n") + ([t] if re.search(license_scan.LICENCE_NAME, p or "") else []) for i, p, t in rows if t is not None}
    tokens = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    df = Counter(w for i, u in units.items() for w in {w for t in u for w in tokens(t)})
    n = len(units)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(tokens(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    cosine = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / norm(a) / norm(b)
    best = {i: max(cosine(vector(t), vector(x)) for t in u for _, x in license_scan.TEMPLATES) for i, u in units.items()}
    own = {r.file_id: r.score for r in license_scan.own_licences(files.select("file_id", "path", "text")).collect()}
    assert own == pytest.approx({i: s for i, s in best.items() if s >= license_scan.THRESHOLD}, abs=1e-6)


def test_licence_scores_use_the_frequencies_of_all_words(spark):
    notice = "This project is released under the MIT License"
    rows = [(i, f"/a/f{i}", f"this project is ordinary{i % 7}") for i in range(300)] + [(900, "/a/n", notice), (901, "/a/m", notice + " rareword"), (902, "/a/e", "")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    tokens = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    df = Counter(w for _, _, t in rows for w in set(tokens(t)))
    vector = lambda t: {w: c * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, c in Counter(tokens(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cosine = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / norm(a) / norm(b)
    want = {i: max(cosine(vector(t), vector(x)) for _, x in license_scan.TEMPLATES) for i, _, t in rows if i >= 900 and t}
    got = {r.file_id: (r.license, r.score) for r in license_scan.own_licences(files).collect()}
    assert want[900] > 0.9 and got == {i: ("MIT", pytest.approx(s, abs=1e-8)) for i, s in want.items()}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(60)] + [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [None] * 16), (804, [1.0, 2.0]), (5, rows[5][1])]
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0 or vec_id = 804"), block=256, query_block=8)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 16}
    assert set(found) == {i for i in fine if i % 20 == 0}
    hit = 0
    for q, list_ in found.items():
        exact = sorted(((-float((fine[q] * v).sum()), i) for i, v in fine.items() if i != q))[:20]
        assert [r for r, _, _ in sorted(list_)] == list(range(1, 21))
        assert [(i, s) for _, i, s in sorted(list_)] == sorted(((i, s) for _, i, s in list_), key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float((fine[q] * fine[i]).sum()), abs=1e-12) for _, i, s in list_)
        hit += len({i for _, i in exact} & {i for _, i, _ in list_})
    assert hit >= 0.9 * 20 * len(found)
    few = neighbours.nearest(vectors.where("vec_id < 5"), vectors.where("vec_id = 0"))
    assert few.count() == 4
    assert neighbours.nearest(vectors.where("vec_id = -1"), vectors.where("vec_id = -1")).count() == 0


def test_recall_on_the_table(spark):
    from rainweave.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    fine = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding}
    got = {}
    for r in QUERIES["op10_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {i for _, i in sorted((-float((fine[q] * v).sum()), i) for i, v in fine.items() if i != q)[:20]}) for q in got)
    assert hit >= 0.9 * 20 * len(got)


def test_pipeline(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = docs.count()
        assert 0 < after <= before
        before = after
    assert docs.where("n_chars <> length(text)").count() == 0
    assert p.STAGES[-1][1](spark, docs, SF).count() == before
    assert p.run(spark, SF).count() == before


def a_record(fields, block):
    return b"WARC/1.1\r\n" + b"".join(b"%s\r\n" % f for f in fields) + b"\r\n" + block + b"\r\n\r\n"


def a_response(k, body=b"text"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return a_record([b"WARC-Type: response", b"WARC-Record-ID: <r%d>" % k, b"WARC-Page-ID: %d" % k, b"Content-Length: %d" % len(block)], block)


def test_a_cut_archive_has_a_problem_row(spark, tmp_path):
    members = [gzip.compress(a_response(k)) for k in range(50)]
    (tmp_path / "cut.gz").write_bytes(b"".join(members)[:-12])
    (tmp_path / "whole.gz").write_bytes(gzip.compress(a_response(100) + a_response(101)))
    (tmp_path / "torn.gz").write_bytes(gzip.compress(a_response(102)) + b"\x1f\x8b" + b"\x00" * 30)
    rows = warc.reassemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert sorted(r.page_id for r in rows if r.problem is None) == [*range(49), 100, 101, 102]
    problems = sorted(r.problem for r in rows if r.problem)
    assert len(problems) == 2 and problems[0] == "archive cut short" and problems[1].startswith("broken compression")


def test_headers_of_any_spelling_and_other_types(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n\xff\x00body"
    odd = a_record([b"warc-type:response", b"WARC-RECORD-ID:<a>", b"X-Note: folded", b"  on", b"warc-page-id : 5", b"content-length:%d" % len(block)], block)
    info = a_record([b"WARC-Type: warcinfo", b"WARC-Record-ID: <i>", b"Content-Length: 2"], b"ok")
    bad = [a_record([b"no colon here"], b""), a_record([b"WARC-Type: response", b"Content-Length: 0"], b""),
           a_record([b"WARC-Type: response", b"WARC-Record-ID: <z>", b"Content-Length: many"], b"x")]
    (tmp_path / "a.warc").write_bytes(info + odd + bad[0] + a_response(6) + bad[1] + a_response(7) + bad[2] + a_response(8))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.reassemble(warc.read_archives(spark, str(tmp_path))).collect()
    assert {r.page_id: bytes(r.payload) for r in rows if r.problem is None} == {5: b"\xff\x00body", 6: b"text", 7: b"text", 8: b"text"}
    assert sum(r.problem is not None for r in rows) == 3


def test_payloads_that_are_no_text(spark, tmp_path):
    rng = random.Random(1)
    bodies = {k: rng.randbytes(size) for k, size in enumerate((0, 1, 500, 5000, 40_000))}
    pages = spark.createDataFrame([(k, "u", bytearray(b)) for k, b in bodies.items()], "page_id long, url string, html binary")
    warc.write_archives(warc.classify(pages), str(tmp_path / "w"), segment_bytes=3000)
    rows = warc.reassemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert {r.page_id: bytes(r.payload) for r in rows} == bodies and not any(r.problem for r in rows)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.classify(pages), str(tmp_path / "w"))
    assert warc.resolve_revisits(warc.reassemble(warc.read_archives(spark, str(tmp_path / "w")))).count() == 0


def test_turns_without_a_number(spark):
    rows = [(0, None, "system", "s"), (0, 0, "user", "a"), (0, 1, "assistant", "r0"), (1, 1, "assistant", "r1"), (2, None, "assistant", "z"), (3, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen, rejected = chat_format.with_substitute_reply(turns)
    assert sorted(map(tuple, rejected.collect()), key=repr) == sorted(
        [(0, None, "system", "s"), (0, 0, "user", "a"), (0, 1, "assistant", "r1"), (1, 1, "assistant", "r0"), (2, None, "assistant", "z"), (3, 0, "user", None)], key=repr)
    got = {r.pair_id: r for r in chat_format.format_preferences(chosen, rejected).collect()}
    assert got[0].prefix_turns == 2 and got[0].prompt.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user")


def preferences(chosen, rejected):
    """The definition, one pair at a time."""
    def turns(rows, p):
        own = [(t is not None, t or 0, r or "", x or "") for q, t, r, x in rows if q == p]
        return [(r, x) for _, _, r, x in sorted(own)]

    def render(part):
        return "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in part)

    def segments(part):
        out = []
        for r, x in part:
            head = f"<|im_start|>{r}\n"
            out += [(head, 0), (x + "<|im_end|>\n", 1)] if r == "assistant" else [(head + x + "<|im_end|>\n", 0)]
        return out

    for p in {r[0] for r in [*chosen, *rejected]} - {None}:
        a, b = turns(chosen, p), turns(rejected, p)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        yield p, n, render(a[:n]), render(a[n:]), render(b[n:]), segments(a[n:]), segments(b[n:])


def test_preferences_by_definition(spark):
    rng = random.Random(7)
    pick = lambda: (rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "x", "y" * 3000, "é\n"]))
    chosen, rejected = [], []
    for p in [*range(60), None]:
        own = [pick() for _ in range(rng.randint(0, 6))]
        chosen += [(p, *t) for t in own]
        rejected += [(p, *(t if rng.random() < 0.8 else pick())) for t in own] + [(p, *pick())] * rng.randint(0, 1)
    schema = "pair_id long, turn long, role string, text string"
    got = chat_format.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()
    want = sorted(preferences(chosen, rejected))
    assert sorted((r.pair_id, r.prefix_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_segments], [tuple(s) for s in r.rejected_segments]) for r in got) == want
    empty = spark.createDataFrame([], schema)
    assert chat_format.format_preferences(empty, empty).count() == 0


def test_many_template_words_and_no_files(spark):
    rng = random.Random(5)
    templates = [(f"L{k:03}", " ".join(f"t{k}x{j}" for j in range(60))) for k in range(100)]
    rows = [(k, f"/d{k}/LICENSE", templates[k % 100][1] if k % 2 else "plain words " + str(k)) for k in range(40)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r.file_id: r.license for r in license_scan.own_licences(files, templates).collect()}
    assert got == {k: f"L{k:03}" for k in range(40) if k % 2}
    assert license_scan.scan(files.where("file_id < 0")).count() == 0


def test_inheritance_by_definition(spark):
    rng = random.Random(6)
    notice = {name: t for name, t in license_scan.TEMPLATES}
    folders = ["", "/a", "/a/b", "/a/b/c", "/a/d", "/e", "/e/f/g", "rel", "rel/x"]
    rows = []
    for k in range(150):
        name = rng.choice(["LICENSE", "licence.txt", "COPYING", "main.c", "x.py", "notice-old"])
        rows.append((k, rng.choice(folders) + f"/{name}{'' if rng.random() < .3 else k}", rng.choice([*notice.values(), "some code", "some code", "some code", None, ""])))
    rows += [(200, None, "some code"), (201, "alone.py", "some code")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    own = {r.file_id: (r.license, r.score) for r in license_scan.own_licences(files).collect()}
    best = {}
    folder = lambda p: re.sub("/[^/]*$", "", p)
    for i, p, _ in rows:
        if i in own and p and re.search(license_scan.LICENCE_NAME, p):
            key = (-own[i][1], p, own[i][0])
            best[folder(p)] = min(best.get(folder(p), key), key)

    def inherited(p):
        steps = folder(p).split("/") if p else []
        for k in range(len(steps), 0, -1):
            if "/".join(steps[:k]) in best:
                return best["/".join(steps[:k])][2], "/".join(steps[:k])
        return None, None

    want = {i: (own[i][0], None) if i in own else inherited(p) for i, p, _ in rows}
    assert {r.file_id: (r.license, r.inherited_from) for r in license_scan.scan(files).collect()} == want
    assert sum(v[1] is not None for v in want.values()) > 20


def test_neighbours_do_not_depend_on_order():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 24))
    lines = neighbours.Lines(x / np.linalg.norm(x, axis=1).max(), 1.0, 64)
    queries, order = x[:100], rng.permutation(100)
    one = lines.candidates(queries, 300, 38)
    other = lines.candidates(queries[order], 300, 38)
    alone = [lines.candidates(queries[k:k + 1], 300, 38)[0] for k in range(100)]
    assert all((one[k] == alone[k]).all() for k in range(100)) and all((other[k] == one[order[k]]).all() for k in range(100))
