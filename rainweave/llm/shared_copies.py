"""Documents whose whole text is an exact copy of an earlier one, set aside before costly per-document work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm import sketch
from rainweave.llm.packing import in_small_batches
from rainweave.llm.shingles import mix, slices
from rainweave.session import cut_lineage

WIDTH = 26


class Originals:
    """Frames of (doc_id, text, key) scanned with a function of record batches, cut to a few megabytes of text each."""

    def __init__(self, parts: list[tuple[DataFrame, object]]):
        self.parts = parts
        self.sparkSession = parts[0][0].sparkSession

    def mapInArrow(self, run, schema: str) -> DataFrame:
        def after(choose):
            return lambda batches: run(slices(choose(batches) if choose else batches))

        out = None
        for df, choose in self.parts:
            part = df.mapInArrow(after(choose), schema)
            out = part if out is None else out.unionByName(part)
        return out


def text_digest(text: str = "text"):
    return F.md5(F.col(text).cast("binary"))


def row_key(doc_id: str = "doc_id", digest: str = "digest"):
    """Tells apart the rows of one doc_id that have different texts."""
    return F.xxhash64(doc_id, digest).alias("key")


@in_small_batches
def split_copies(docs: DataFrame, width: int = WIDTH) -> tuple[Originals, DataFrame]:
    """docs (doc_id, text) into the rows (doc_id, text, key) with the smallest doc_id of their text, and (doc_id, digest, first) of all other rows.

    Rows without doc_id or text are in neither. Only (doc_id, digest) is shuffled. Each scan of the first frame leaves the
    later copies out by a bounded filter; the few other rows which that filter takes along are found exactly, once, and
    added from a written table.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id", text_digest().alias("digest"))
    # written, so that the join meets two plain exchanges and a large group of copies can be split between tasks
    first = cut_lineage(ids.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    later = cut_lineage(ids.join(first, "digest").where(F.col("doc_id") > F.col("first")).select("doc_id", "digest", "first"))
    key = row_key()

    def keys(batch):
        return mix(batch.column("key").to_numpy().astype(np.uint64))

    bits = sketch.build(later.select(key), keys, width, twice=False)

    def kept(wanted: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(sketch.holds(bits.value, keys(batch), width) == wanted))
        return run

    doubtful = ids.select("doc_id", "digest", key).mapInArrow(kept(True), f"doc_id {kind}, digest string, key long").drop("key").distinct()
    spared = cut_lineage(doubtful.join(later, ["doc_id", "digest"], "left_anti"))
    texts = docs.withColumn("digest", text_digest())
    flagged = texts.select("doc_id", "text", "digest", key).mapInArrow(kept(True), f"doc_id {kind}, text string, digest string, key long")
    extra = cut_lineage(flagged.join(spared, ["doc_id", "digest"], "left_semi").select("doc_id", "text", "key"))
    return Originals([(texts.select("doc_id", "text", key), kept(False)), (extra, None)]), later
