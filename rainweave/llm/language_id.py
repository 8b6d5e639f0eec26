"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting sums n-gram counts per language inside each task and sends blocks of BLOCK buckets on, so what is shuffled
depends on tasks, languages and buckets, not on text. Languages are learned LABELS at a time, each lot in its own pass. The
matrix of log probabilities (languages x buckets) is broadcast by lots; scoring gathers and sums its rows for a batch of
texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm.packing import in_small_batches
from rainweave.llm.shingles import slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
LABELS = 256
HELD_LABELS = 64
PIECE = 1 << 20
BLOCK = 1 << 12
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray                 # (languages,)
    weights: tuple[np.ndarray, ...]   # lots of languages in order, each (buckets, languages of the lot), logs


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_buckets(texts: list[str], orders=ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, index of its text) piece by piece, over whole texts.

    Upper case counts as lower case; characters that are not letters count as one space, a run of them once.
    """
    points, owner, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[max(0, at - max(orders) + 1):at + PIECE]  # n-grams across pieces are kept; shorter ones recur by a few
            at += PIECE
            one = np.frombuffer((" " + part.lower() + " ").encode("utf-32-le"), np.uint32)
            points.append(one)
            owner.append(np.full(len(one), k, np.int64))
            held += len(one)
            if held >= PIECE:
                yield from _buckets(np.concatenate(points), np.concatenate(owner), orders, buckets)
                points, owner, held = [], [], 0
    if points:
        yield from _buckets(np.concatenate(points), np.concatenate(owner), orders, buckets)


_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def _buckets(points, owner, orders, buckets):
    letter = np.ones(len(points), bool)
    low = points < 0x10000
    letter[low] = _LETTER[points[low]]
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        h = (h[:m] + points[n - 1:] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in orders:
            inside = owner[:m] == owner[n - 1:]
            yield ((h[inside] * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64), owner[:m][inside]


@in_small_batches
def fit(rows: DataFrame, text: str = "text", label: str = "lang", buckets: int = BUCKETS, orders=ORDERS, smoothing: float = SMOOTHING) -> Model:
    """Counts over all rows with a text with letters and a label, for any number of labels (they make up the model's size)."""
    rows = rows.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"))
    labels = sorted(r.lang for r in rows.select("lang").distinct().collect())
    parts = [_fit_lot(rows.where(F.col("lang").isin(labels[k:k + LABELS])) if len(labels) > LABELS else rows, buckets, orders, smoothing)
             for k in range(0, len(labels), LABELS)]
    parts = [p for p in parts if p[0]]
    texts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
    return Model(tuple(name for p in parts for name in p[0]), np.log(texts / max(texts.sum(), 1)), tuple(p[2] for p in parts))


def _fit_lot(rows: DataFrame, buckets: int, orders, smoothing: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages of the rows, in order, the texts of each, and their log probabilities."""
    rows = rows.where("text is not null")
    per = min(BLOCK, buckets)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def out():
            for lang, total in sums.items():
                n = buckets // per
                yield pa.record_batch([pa.array([lang] * n), pa.array(range(n), pa.int32()), pa.array(total.reshape(n, per).tolist(), pa.list_(pa.int64())),
                                       pa.array([texts[lang]] + [0] * (n - 1), pa.int64())], ["lang", "block", "counts", "texts"])

        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(t):
                    by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                if lang not in sums and len(sums) >= HELD_LABELS:
                    yield from out()
                    sums, texts = {}, {}
                total = sums.setdefault(lang, np.zeros(buckets, np.int64))
                texts[lang] = texts.get(lang, 0) + len(own)
                for b, _ in ngram_buckets(own, orders, buckets):
                    total += np.bincount(b, minlength=buckets)
        yield from out()

    def add(batches):
        held: dict = {}
        for batch in batches:
            for lang, block, counts, texts in zip(*batch.columns):
                have = held.setdefault((lang.as_py(), block.as_py()), [np.zeros(per, np.int64), 0])
                have[0] += counts.values.to_numpy()
                have[1] += texts.as_py()
        if held:
            yield pa.record_batch([pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()),
                                   pa.array([v[0].tolist() for v in held.values()], pa.list_(pa.int64())),
                                   pa.array([v[1] for v in held.values()], pa.int64())], ["lang", "block", "counts", "texts"])

    schema = "lang string, block int, counts array<long>, texts long"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = rows.mapInArrow(count, schema).repartition(parts, "lang", "block").mapInArrow(add, schema).toPandas()  # languages x buckets
    languages = sorted(set(merged["lang"]))
    at = {lang: k for k, lang in enumerate(languages)}
    counts, texts = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    for lang, block, part, n in zip(merged["lang"], merged["block"], merged["counts"], merged["texts"]):
        k = at[lang]
        counts[block * per:(block + 1) * per, k] = part
        texts[k] += n
    weights = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
    return languages, texts, weights.astype(np.float32)


def score(texts: list[str | None], model: Model, orders=ORDERS) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text; UNKNOWN and 0 for a text without letters or a model without languages."""
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model.languages else []
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not known:
        return langs, scores
    sums = np.tile(model.prior.astype(np.float64), (len(known), 1))
    ends = np.cumsum([w.shape[1] for w in model.weights])
    for b, owner in ngram_buckets([texts[k] for k in known], orders, len(model.weights[0])):
        cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
        if len(cuts):
            for lot, end in zip(model.weights, ends):
                sums[owner[cuts], end - lot.shape[1]:end] += np.add.reduceat(lot[b], cuts, axis=0, dtype=np.float64)
    sums -= sums.max(axis=1, keepdims=True)
    odds = np.exp(sums)
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)  # ties: the language first in the alphabet
    for k, at, value in zip(known, best, odds.max(axis=1)):
        langs[k], scores[k] = model.languages[at], value
    return langs, scores


def judge(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """kept (a struct of the columns in keep, whatever their names), lang_pred and score, for every row. Only text decides.

    A null, empty or letterless text is `und` with score 0.
    """
    context = docs.sparkSession.sparkContext
    shared, lots = context.broadcast((model.languages, model.prior)), [context.broadcast(w) for w in model.weights]
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    rows = docs.select(kept.alias("kept"), F.col(text).alias("text"))

    def run(batches):
        learned = Model(*shared.value, tuple(lot.value for lot in lots))
        for batch in slices(batches):
            langs, scores = score(batch.column("text").to_pylist(), learned)
            yield pa.record_batch([batch.column("kept"), pa.array(langs, pa.string()), pa.array(scores)], ["kept", "lang_pred", "score"])

    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, lang_pred and score, for every row, as judge() tells them. Names in keep must not be lang_pred or score."""
    return judge(docs, model, text, keep).select(*(F.col("kept")[c].alias(c) for c in keep), "lang_pred", "score")
