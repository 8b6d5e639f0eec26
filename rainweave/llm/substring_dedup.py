"""Remove passages that an earlier document holds already, by windows of consecutive words.

Three scans over the texts. The first merges a count-min sketch of all window hashes, built per task; it overestimates.
The second groups exactly (96-bit keys) only windows estimated repeated and keeps those of several documents with their
smallest doc_id; keys are combined before the shuffle. The third finds, by a bounded filter of these keys, each
document's confirmed windows and joins them to the smallest doc_id, a join the optimizer splits where one passage is in
very many documents. Exact copies of whole texts never enter the windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm import sketch
from rainweave.llm.packing import PACKED_BYTES, in_small_batches, pack_texts, small_batches, unpack
from rainweave.llm.shared_copies import split_copies
from rainweave.llm.shingles import Words, slices
from rainweave.session import cut_lineage

WINDOW = 13
WIDTH = 28
KEY = "h1 long, h2 int"


def _per_document(ids: np.ndarray, h1: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """One row per document and hash."""
    order = np.lexsort((h1, ids))
    ids, h1 = ids[order], h1[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (h1[1:] != h1[:-1])
    return [ids[keep], h1[keep], *(x[order][keep] for x in others)]


@in_small_batches
def earlier_windows(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1) of every window to remove, and (doc_id, first) of rows that copy a whole earlier text."""
    work, later = split_copies(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashes(batch):
        return Words(batch.column("text")).ngrams(window)[0]

    estimate = sketch.build(work, hashes, width)

    def suspects(bits):
        """(row of batch, h1, h2) of the windows that the bits hold, once per row."""
        def find(batch):
            words = Words(batch.column("text"), seeds=(1, 2))
            h1, at = words.ngrams(window)
            keep = sketch.holds(bits.value, h1, width)
            h2 = words.ngrams(window, 1)[0][keep].astype(np.uint32).view(np.int32)
            return _per_document(words.text[at[keep]], h1[keep], h2)
        return find

    def smallest(batches):
        find = suspects(estimate)
        for batch in batches:
            row, h1, h2 = find(batch)
            ids = batch.column("doc_id").to_numpy()[row]
            order = np.lexsort((ids, h2, h1))
            ids, h1, h2 = ids[order], h1[order], h2[order]
            start = np.ones(len(ids), bool)
            start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            begin = np.flatnonzero(start)
            end = np.append(begin[1:], len(ids)) - 1 if len(begin) else begin
            yield pa.record_batch([pa.array(h1[begin].view(np.int64)), pa.array(h2[begin]), pa.array(ids[begin]), pa.array(ids[end])],
                                  ["h1", "h2", "low", "high"])

    confirmed = cut_lineage(work.mapInArrow(smallest, f"{KEY}, low {kind}, high {kind}").groupBy("h1", "h2")
                            .agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").drop("high"))
    exact = sketch.build(confirmed.select("h1"), lambda b: b.column("h1").to_numpy().view(np.uint64), width, twice=False)

    def holders(batches):
        find = suspects(exact)
        for batch in batches:
            row, h1, h2 = find(batch)
            yield pa.record_batch([pa.array(h1.view(np.int64)), pa.array(h2), batch.column("doc_id").take(pa.array(row))], ["h1", "h2", "doc_id"])

    found = work.mapInArrow(holders, f"{KEY}, doc_id {kind}")
    return cut_lineage(found.join(confirmed, ["h1", "h2"]).where(F.col("doc_id") > F.col("low")).select("doc_id", "h1")), later


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed: one row per row of docs.

    A word goes if a window that covers it also starts in a document with a smaller doc_id; all windows are judged on the
    input. doc_id is an integer; rows of one doc_id never remove each other's words. A null text has no words; a row
    without doc_id keeps all its words and removes none; texts under one window are kept.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    windows, later = earlier_windows(rows, window, width)
    marks = (windows.select("doc_id", "h1", F.lit(None).cast("string").alias("digest"))
             .unionByName(later.select("doc_id", F.lit(None).cast("long").alias("h1"), "digest"))
             .groupBy("doc_id").agg(F.collect_list("h1").alias("gone"), F.collect_list("digest").alias("copies")))

    def cut(batches):
        for batch in slices(batches, "packed", PACKED_BYTES):
            yield _without(batch, [unpack(p) for p in batch.column("packed").to_pylist()], window)

    with small_batches(docs.sparkSession):
        packed = cut_lineage(pack_texts(rows, "doc_id", "text"))
    return (packed.join(marks, "doc_id", "left")
            .mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long"))


def _without(batch: pa.RecordBatch, texts: list[str | None], window: int) -> pa.RecordBatch:
    words = Words(pa.array(texts, pa.string()))
    h1, at = words.ngrams(window)
    gone = np.zeros(len(words.starts) + 1, np.int64)
    row = words.text[at]
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    for k, (marks, copies) in enumerate(zip(batch.column("gone"), batch.column("copies"))):
        lo, hi = cuts[k], cuts[k + 1]
        if lo == hi or not marks.is_valid:
            continue
        if len(copies.values) and hashlib.md5(texts[k].encode()).hexdigest() in copies.as_py():
            starts = at[lo:hi]
        else:
            starts = at[lo:hi][np.isin(h1[lo:hi], marks.values.to_numpy().view(np.uint64))]
        gone[starts] += 1
        gone[starts + window] -= 1
    removed = np.cumsum(gone)[:-1] > 0
    raw = words.raw.tobytes()
    kept = []
    for k in range(len(texts)):
        own = np.flatnonzero(~removed[words.first[k]:words.first[k + 1]]) + words.first[k]
        kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist())]))
    dropped = np.add.reduceat(np.append(removed, False).astype(np.int64), words.first[:-1]) * (words.counts > 0) if len(texts) else np.zeros(0, np.int64)
    return pa.record_batch([batch.column("doc_id"), pc.cast(pa.array(kept, pa.binary()), pa.string()), pa.array(words.counts.astype(np.int64)),
                            pa.array(dropped.astype(np.int64))], ["doc_id", "text", "n_words", "n_removed"])
