"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Labels are learned from a sample of labelled rows, bounded by MOST_EXAMPLES and dealt into shards of about SHARD_ROWS.
Every round starts all shards from one broadcast state: per bucket the FTRL sums z and n, whose size is BUCKETS alone.
A shard goes through its rows in small batches with per-coordinate rates; the shards' states are then averaged block by
block, in a fixed order, so the same rows give the same model. L1 leaves few weights. Each of them is then tied to the
feature that fills its bucket (by its whole 32-bit hash), so that other words of a long text which fall into the bucket
count for nothing. The table of these features is what the scoring pass, one scan of the texts without a shuffle, carries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm.packing import in_small_batches
from rainweave.llm.shingles import PIECE, Terms, mix, slices
from rainweave.session import checkpoint_dir, cut_lineage

MOST_EXAMPLES = 40_000
SHARD_ROWS = 20_000
WIDTH = 20          # 2**WIDTH buckets
ROUNDS = 10
BATCH = 32
ALPHA, BETA, L1, L2 = 8.0, 1.0, 6.0, 0.001
GAPS = (1, 2)       # distances of the words of a pair: next to each other, and with one word between
BLOCK = 16


@dataclass(frozen=True)
class Model:
    bias: float
    features: np.ndarray   # uint32, ascending
    weights: np.ndarray    # float64


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, 32-bit feature hash) of the words, word pairs and skip-pairs of whole texts, with repeats."""
    words = Terms(column, lower=True)
    h = words.hashes[0]
    owner, value = [words.text], [mix(h ^ np.uint64(0xA5A5))]
    for gap in GAPS:
        m = max(0, len(h) - gap)
        at = np.flatnonzero(words.text[:m] == words.text[gap:])
        owner.append(at if not len(at) else words.text[at])
        value.append(mix(h[at] * np.uint64(2 * gap + 1) + h[at + gap] + np.uint64(gap)))
    return np.concatenate(owner), (np.concatenate(value) >> np.uint64(32)).astype(np.uint32)


def distinct_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, ordered by text: (features, bounds of each text's own)."""
    owner, feature = text_features(column)
    key = np.unique((owner.astype(np.uint64) << np.uint64(32)) | feature)
    bounds = np.searchsorted(key, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(32))
    return key.astype(np.uint32), bounds


def truncated(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """The weights that a state stands for: 0 wherever |z| is at most l1."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def learn(z: np.ndarray, n: np.ndarray, labels: np.ndarray, buckets: np.ndarray, bounds: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1,
          l2: float = L2, batch: int = BATCH) -> None:
    """One pass of FTRL-proximal over examples, in place. The last place of z and n is the bias, which L1 leaves alone."""
    for at in range(0, len(labels), batch):
        y = labels[at:at + batch]
        own = buckets[bounds[at]:bounds[at + len(y)]]
        row = np.repeat(np.arange(len(y)), np.diff(bounds[at:at + len(y) + 1]))
        touched, where = np.unique(own, return_inverse=True)
        w = truncated(z[touched], n[touched], alpha, beta, l1, l2)
        bias = truncated(z[-1:], n[-1:], alpha, beta, 0.0, l2)[0]
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[where], len(y)) + bias, -35, 35)))
        error = p - y
        touched = np.append(touched, len(z) - 1)
        w = np.append(w, bias)
        g = np.append(np.bincount(where, error[row], len(touched) - 1), error.sum())
        before = n[touched]
        after = before + g * g
        z[touched] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
        n[touched] = after


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int, shard_rows: int) -> DataFrame:
    """shard, place, y, features of the documents of a bounded hash sample of the labels, written once."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string")).alias("place"), (F.col(label) > 0).cast("int").alias("y"))
    count = rows.count()
    share = min(1.0, most / max(count, 1))
    shards = max(1, -(-min(count, most) // shard_rows))
    taken = cut_lineage(rows.where(F.col("place") < int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else rows)
    if taken.count() <= 2 * most:  # narrow rows, so few that no text has to be dealt for the join; one label's very many copies would not be
        taken = F.broadcast(taken)
    taken = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(taken, "key").select("place", "text", "y")

    def read(batches):
        for batch in slices(batches, most=PIECE):
            features, bounds = distinct_features(batch.column("text"))
            yield pa.record_batch([batch.column("place"), batch.column("y"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(features.view(np.int32)))],
                                  ["place", "y", "features"])

    dealt = taken.mapInArrow(read, "place long, y int, features array<int>").withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    path = f"{checkpoint_dir(docs.sparkSession)}/examples-{uuid.uuid4().hex}"
    # one row group a file, so that a shard is always read by one task and no round has to deal the rows again
    dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "place", "y", "features").write.option("parquet.block.size", str(1 << 30)).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _shards(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, labels, features, bounds): the rows of each shard as they stream by, a few thousand at a time."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
        for at, end in zip(cuts, [*cuts[1:], len(shard)]):
            part = batch.slice(at, end - at)
            lists = part.column("features")
            yield int(shard[at]), part.column("y").to_numpy(), lists.flatten().to_numpy().view(np.uint32), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))


def one_round(rows: DataFrame, z: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the states that the shards reach from (z, n)."""
    size, block = 1 << width, min(BLOCK, width)
    pack = lambda a: zstandard.ZstdCompressor(level=1).compress(a.astype(np.float32).tobytes())
    unpack = lambda b: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.float32).astype(np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((pack(z), pack(n)))

    def blocks(shard, z, n):
        for b in range(0, len(z), 1 << block):
            yield pa.record_batch([pa.array([b >> block], pa.int32()), pa.array([shard], pa.int32()), pa.array([pack(z[b:b + (1 << block)])], pa.binary()),
                                   pa.array([pack(n[b:b + (1 << block)])], pa.binary())], ["block", "shard", "z", "n"])

    def train(batches):
        last, state = None, None
        for shard, y, features, bounds in _shards(batches):
            if shard != last:
                if state:
                    yield from blocks(last, *state)
                last, state = shard, [unpack(a) for a in shared.value]
            learn(*state, y, (features >> np.uint32(32 - width)).astype(np.int64), bounds)
        if state:
            yield from blocks(last, *state)

    def merge(batches):
        last, sums, met = None, None, 0

        def out():
            return pa.record_batch([pa.array([last], pa.int32()), pa.array([met], pa.int32()), *(pa.array([pack(s / met)], pa.binary()) for s in sums)],
                                   ["block", "met", "z", "n"])

        for batch in batches:
            for b, z_b, n_b in zip(batch.column("block").to_pylist(), batch.column("z").to_pylist(), batch.column("n").to_pylist()):
                if b != last:
                    if met:
                        yield out()
                    last, sums, met = b, [0.0, 0.0], 0
                sums, met = [sums[0] + unpack(z_b), sums[1] + unpack(n_b)], met + 1
        if met:
            yield out()

    states = rows.mapInArrow(train, "block int, shard int, z binary, n binary")
    merged = states.repartition((size >> block) + 1, "block").sortWithinPartitions("block", "shard").mapInArrow(merge, "block int, met int, z binary, n binary")
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for b, _, z_b, n_b in merged.collect():  # 2**width buckets
        z[b << block:(b + 1) << block], n[b << block:(b + 1) << block] = unpack(z_b), unpack(n_b)
    shared.destroy()
    return z, n


@in_small_batches
def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_EXAMPLES, shard_rows: int = SHARD_ROWS, width: int = WIDTH,
        rounds: int = ROUNDS) -> Model:
    """Learns from the documents of at most about `most` labels (over 0: toxic), chosen by a hash of key; all of their text counts.

    A null text is an empty one; a null label or key is none. Rows that repeat a key are examples of their own. Without
    labelled documents the model has no features and scores 0.5.
    """
    dealt = examples(docs, labels, key, text, label, most, shard_rows)
    z, n = np.zeros((1 << width) + 1), np.zeros((1 << width) + 1)
    for _ in range(rounds):
        z, n = one_round(dealt, z, n, width)
    w = truncated(z[:-1], n[:-1], ALPHA, BETA, L1, L2)
    bias = float(truncated(z[-1:], n[-1:], ALPHA, BETA, 0.0, L2)[0])
    sign = dealt.sparkSession.sparkContext.broadcast(np.sign(w).astype(np.int8))

    def weighty(batches):
        for _, y, features, bounds in _shards(batches):
            side = sign.value[features >> np.uint32(32 - width)]
            row = np.repeat(y, np.diff(bounds))
            own, met = np.unique(features[(side != 0) & ((row > 0) == (side > 0))], return_counts=True)
            yield pa.record_batch([pa.array(own.astype(np.int64)), pa.array(met)], ["feature", "met"])

    counted = dealt.mapInArrow(weighty, "feature long, met long").groupBy("feature").agg(F.sum("met").alias("met"))
    best = F.max(F.struct("met", (-F.col("feature")).alias("less")))
    chosen = counted.groupBy(F.shiftright("feature", 32 - width).alias("bucket")).agg(best.alias("best")).select((-F.col("best.less")).alias("feature"))
    features = np.sort(np.array([r.feature for r in chosen.collect()], np.int64)).astype(np.uint32)  # one a weight that is not 0
    return Model(bias, features, w[features >> np.uint32(32 - width)])


def score(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of label 1 for each text; a null or empty text has that of the bias alone."""
    total = np.full(len(column), model.bias)
    if len(model.features):
        owner, feature = text_features(column)
        mark = np.zeros(1 << 16, bool)
        mark[model.features >> np.uint32(16)] = True
        maybe = np.flatnonzero(mark[feature >> np.uint32(16)])
        at = np.minimum(np.searchsorted(model.features, feature[maybe]), len(model.features) - 1)
        fine = model.features[at] == feature[maybe]
        pairs = np.unique(owner[maybe[fine]] * len(model.features) + at[fine])
        total += np.bincount(pairs // len(model.features), model.weights[pairs % len(model.features)], len(column))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """kept (struct of the columns in keep) and score (0 to 1, higher: likelier toxic) of every row. Only the whole text decides."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.features, model.weights))
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    rows = docs.select(kept.alias("kept"), F.col(text).alias("text"))

    def run(batches):
        model = Model(*shared.value)
        for batch in slices(batches, most=PIECE):
            yield pa.record_batch([batch.column("kept"), pa.array(score(batch.column("text"), model))], ["kept", "score"])

    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, score double")
