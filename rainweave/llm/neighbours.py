"""Nearest neighbours by inner product, by collision counting over single projections (query-aware hashing).

Vectors get one more component that makes all norms equal, so the largest inner product is the smallest distance. A block
of candidates keeps, for each of M random lines, its projections in sorted order. A query's windows are centred on its own
projections and widen level by level (virtual rehashing); a vector that lies in at least THRESHOLD of the M windows is a
candidate, and widening stops once VERIFY of the block are candidates. They are verified exactly. Blocks of queries meet
blocks of candidates; blocks are bounded, and only each block's nearest k go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES = 128
THRESHOLD = 0.6
VERIFY = 0.15
VERIFY_LEAST = 600
BLOCK = 8192
QUERY_BLOCK = 512
FIRST_WIDTH = 0.3
GROWTH = 1.04
K = 20


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (array of double), norm: vectors that are not null, zero or empty and whose components are all finite.

    Of rows repeating a vec_id the smallest vector in array order counts.
    """
    v = F.col("v")
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(fine)
    return (rows.groupBy("vec_id").agg(F.min("v").alias("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))


class Lines:
    """The sorted projections of one block of candidates."""

    def __init__(self, x: np.ndarray, longest: float, lines: int, seed: int = 7):
        scaled = x / longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        self.axes = np.random.default_rng([seed, x.shape[1]]).standard_normal((lines, x.shape[1] + 1))
        placed = self.axes @ np.column_stack((scaled, rest)).T
        order = np.argsort(placed, axis=1, kind="stable")
        self.sorted = np.take_along_axis(placed, order, axis=1)
        self.n = len(x)
        #: place of each vector in each line's sorted array
        self.place = np.empty(order.shape, np.uint16 if self.n < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(self.n, dtype=self.place.dtype)[None, :], axis=1)

    def candidates(self, queries: np.ndarray, least: int, threshold: int):
        """For each query, the positions that collide on at least `threshold` lines at the first level where `least` of them do.

        Windows only grow with the level, so that level is the same wherever the search for it begins: it begins at the
        level of the query before and goes down or up.
        """
        centre = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ self.axes[:, :-1].T
        out, level, enough = [], 0, min(least, self.n)
        for c in centre:
            here = self._colliding(c, level, threshold)
            while len(here) >= enough and level:
                below = self._colliding(c, level - 1, threshold)
                if len(below) < enough:
                    break
                here, level = below, level - 1
            while len(here) < enough:
                level += 1
                here = self._colliding(c, level, threshold)
            out.append(here)
        return out

    def _colliding(self, centre: np.ndarray, level: int, threshold: int) -> np.ndarray:
        half = FIRST_WIDTH * GROWTH ** level
        low = np.array([s.searchsorted(v) for s, v in zip(self.sorted, centre - half)])
        high = np.array([s.searchsorted(v, "right") for s, v in zip(self.sorted, centre + half)])
        kind = self.place.dtype
        inside = (self.place - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]  # unsigned: places under low wrap round
        counts = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if len(low) < 256 else np.uint32)
        return np.flatnonzero(counts >= threshold)


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, lines: int = LINES,
            threshold: float = THRESHOLD, verify: float = VERIFY, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, its own id left out; ties go to the smaller vec_id.

    Vectors that are null, zero, or hold a null or non-finite component take no part; a query meets candidates of its own
    dimension. score is the inner product of the original vectors in double precision.
    """
    rows = valid_vectors(vectors, vec_id, embedding)
    asked = valid_vectors(queries, vec_id, embedding)
    n, longest = rows.agg(F.count("*"), F.max("norm")).first()
    n_queries = asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = rows.select("vec_id", "v", F.size("v").alias("dim"), spread("vec_id", blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    right = asked.select("vec_id", "v", F.size("v").alias("dim"), spread("vec_id", query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("cb", pa.int32())])

    def search(key, candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = schema.empty_table()
        if not candidates.num_rows or not wanted.num_rows:
            return empty
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        ids, x = candidates.column("vec_id").to_numpy(), matrix(candidates)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        least = max(k + 1 + int(np.ceil(verify * len(x))), VERIFY_LEAST)
        out = []
        names, q = wanted.column("vec_id").to_numpy(), matrix(wanted)
        for name, vector, found in zip(names, q, Lines(x, longest, lines).candidates(q, least, int(np.ceil(threshold * lines)))):
            found = found[ids[found] != name]
            rough = x[found] @ vector
            if len(found) > k:  # all that may be among the nearest k, ties included, are scored again row by row
                found = found[rough >= np.partition(rough, -k)[-k] - 1e-9 * longest * np.linalg.norm(vector)]
            score = (x[found] * vector).sum(axis=1)
            best = np.lexsort((ids[found], -score))[:k]
            out.append((np.full(len(best), name), ids[found[best]], score[best]))
        parts = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(parts[0]), pa.array(parts[1]), pa.array(parts[2]), pa.array(np.full(len(parts[0]), key[0].as_py()), pa.int32())], schema=schema)

    keys = ("cb", "qb", "dim")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double, cb int")
    by = (F.col("score").desc(), F.col("vec_id"))
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id", F.pmod("cb", F.lit(64))).orderBy(*by))).where(F.col("rank") <= k)
    return (found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
