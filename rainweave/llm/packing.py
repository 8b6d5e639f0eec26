"""Texts compressed before a shuffle, and small batches for the jobs that an operator runs itself."""

from __future__ import annotations

import functools
import threading
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.llm.shingles import slices

PACKED_BYTES = 1 << 20  # of packed texts unpacked at a time
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCK, _ENTERED = threading.Lock(), {}


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run inside hand documents to Python BATCH_ROWS at a time; the session's setting is as before afterwards.

    Nested and concurrent uses of one session share the change; the last one to leave takes it back.
    """
    with _LOCK:
        depth, before = _ENTERED.get(id(spark), (0, spark.conf.get(BATCH_SETTING)))
        _ENTERED[id(spark)] = depth + 1, before
        if not depth:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        with _LOCK:
            depth, before = _ENTERED.pop(id(spark))
            if depth > 1:
                _ENTERED[id(spark)] = depth - 1, before
            else:
                spark.conf.set(BATCH_SETTING, before)


def in_small_batches(operator):
    """For operators that run jobs over the texts of their first argument while the plan is built."""
    @functools.wraps(operator)
    def run(docs, *args, **options):
        with small_batches(docs.sparkSession):
            return operator(docs, *args, **options)
    return run


def pack_texts(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, packed (the compressed text; null for a null text) and kept, a struct of the columns in keep."""
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), kept.alias("kept"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            packed = [None if t is None else press(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(packed, pa.binary()), batch.column("kept")], ["doc_id", "packed", "kept"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(pack, f"doc_id {kind('doc_id')}, packed binary, kept {kind('kept')}")


def unpack(packed: bytes | None) -> str | None:
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode()
