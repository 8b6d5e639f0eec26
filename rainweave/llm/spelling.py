"""Spelling variants: words one inserted, deleted or replaced code point apart, by PartEnum over letter multisets.

A word's letters, each numbered by its occurrence, are a binary vector; one edit moves it by a Hamming distance of at most
two. The vector's positions are dealt into PARTS parts, so two such words agree on at least PARTS - 2 of them: a word has a
signature for every choice of PARTS - 2 parts, and only words that share one meet in an equi-join. Multisets say nothing of
order, so a signature also carries one half of the word as it is written (an edit leaves the first or the last half as it
was) and the length of the longer word; that loses no pair. The join itself verifies each candidate and gives on true
pairs only. Nothing is capped: a crowded signature is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm.shingles import mix, slices
from rainweave.session import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_POINTS = 7
LEAST_COUNT = 2
RATIO = 10
PARTS = 4
HAMMING = 2
HELD_WORDS = 200_000


def damaged(run: str, seed: int, every: int) -> str:
    """The run without one code point, where the CRC-32 of its UTF-8 bytes, begun at seed, is a multiple of every."""
    h = zlib.crc32(run.encode(), seed)
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: str = RUN, least_points: int = LEAST_POINTS,
                least_count: int = LEAST_COUNT, damage_every: int | None = None) -> DataFrame:
    """(word, n): the words of all texts, A-Z lowered, of at least least_points code points and least_count occurrences.

    Rows with a null text give none. With damage_every, a run loses a code point where the CRC-32 of `<doc_id>:<run>` is a
    multiple of it (a fixed share of misspellings, to measure the grouping by); rows without doc_id are then left out.
    """
    rows = docs.where(F.col(text).isNotNull() if damage_every is None else F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    pattern = f"{run}{{{least_points},}}"

    def count(batches):
        find = re.compile(pattern).findall
        held: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for name, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = Counter(find(body.encode().lower().decode()))
                if damage_every is None:
                    held.update(found)
                else:
                    seed = zlib.crc32(f"{name}:".encode())
                    for word, n in found.items():
                        held[damaged(word, seed, damage_every)] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return (rows.mapInArrow(count, "word string, n long").where(F.length("word") >= least_points)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def signatures(words: list[str], parts: int = PARTS, hamming: int = HAMMING) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of shape (words, signatures): keys of a word as the longer (or equal) one of a pair, and as the shorter one."""
    size = np.array([len(w) for w in words], np.int64)
    n, first = len(words), np.cumsum(size) - size
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), size)
    place = np.arange(len(points)) - first[owner]

    # binary vector: (letter, how many such letters came before), by its parts
    order = np.lexsort((points, owner))
    same = np.zeros(len(points), bool)
    same[1:] = (points[order][1:] == points[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    begins = np.maximum.accumulate(np.where(same, 0, np.arange(len(points))))
    element = mix((points[order] << np.uint64(20)) + (np.arange(len(points)) - begins).astype(np.uint64) + np.uint64(1))
    sums = np.zeros(n * parts, np.uint64)
    np.add.at(sums, owner[order] * parts + (element % np.uint64(parts)).astype(np.int64), mix(element))
    sums = sums.reshape(n, parts)

    # halves as they are written
    letters = mix(points + np.uint64(0x51ED27))
    power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))))
    total = lambda p: np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters * power[p])))
    ahead, back = total(place), total(size[owner] - 1 - place)
    out = []
    for longest in (size, size + 1):
        head, tail = longest // 2, longest - longest // 2
        halves = [mix(ahead[first + head] - ahead[first] + np.uint64(1)), mix(back[first + size] - back[first + size - tail] + np.uint64(2))]
        keys = []
        for k, kept in enumerate(combinations(range(parts), parts - hamming)):
            vector = np.full(n, k + 1, np.uint64)
            for j in kept:
                vector = mix(vector + sums[:, j])
            keys += [mix(vector ^ half + longest.astype(np.uint64)) for half in halves]
        out.append(np.column_stack(keys).reshape(n, -1))
    return out[0], out[1]


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct words exactly one inserted, deleted or replaced code point apart. Nulls have none."""

    def keyed(which: int):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 20_000):
                    own = batch.column("word").slice(at, 20_000)
                    keys = signatures(own.to_pylist(), parts)[which]
                    where = pa.array(np.repeat(np.arange(len(own)), keys.shape[1]))
                    yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), own.take(where)], ["key", "word"])
        return words.where("word is not null").select("word").mapInArrow(run, "key long, word string")

    near = "levenshtein(x.word, y.word, 1) = 1"
    longer, shorter = keyed(0), keyed(1)
    equal = longer.alias("x").join(longer.alias("y"), F.expr(f"x.key = y.key AND x.word < y.word AND {near}"))
    one_more = longer.alias("x").join(shorter.alias("y"), F.expr(f"x.key = y.key AND length(x.word) = length(y.word) + 1 AND {near}"))
    ends = [F.least("x.word", "y.word").alias("a"), F.greatest("x.word", "y.word").alias("b")]
    return equal.select(*ends).unionByName(one_more.select(*ends)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word by following (word, form). Paths double in length each round; they never close."""
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not further.where("moved").limit(1).count():
            return further.select("word", "root")
        reached = further.select("word", "root")


def spelling_variants(counts: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of counts (distinct word, n).

    form is the near word of largest n (ties: the smallest in code-point order), if that n is at least ratio times the
    word's; root follows forms to the last one and is the word itself where there is none. An empty table gives no rows.
    """
    counts = cut_lineage(counts.where("word is not null").select("word", "n"))
    pairs = cut_lineage(near_pairs(counts, parts))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = both.join(counts.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    near = partner.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    worthy = -F.col("best.less") >= ratio * F.col("n")
    rows = cut_lineage(counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(worthy, F.col("best.word")).alias("form"),
        F.when(worthy, -F.col("best.less")).alias("form_n")))
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
