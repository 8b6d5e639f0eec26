"""Drop lines that many documents share, keeping them in one document.

Pass 1 merges two Bloom filters over all line hashes: seen once, seen twice or more. In pass 2 only lines whose hash the
second filter holds are shuffled, as (key digest, document), for the exact count of documents and the choice of the
document that keeps them. The filters' size is a parameter; they overestimate and lose no repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm import sketch
from rainweave.llm.packing import PACKED_BYTES, in_small_batches, pack_texts, unpack
from rainweave.llm.shared_copies import Originals
from rainweave.llm.shingles import slices
from rainweave.session import cut_lineage

WHITE = b" \t\n\r\x0b\x0c"
WIDTH = 26
MIN_CHARS = 20
MIN_DOCS = 3


def line_keys(text: str | None) -> list[tuple[bytes, bytes]]:
    """(line, key) of every line; a null or empty text has one empty line."""
    return [(line, line.strip(WHITE).lower()) for line in (text or "").encode().split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _digests(text: str | None, least: int) -> set[bytes]:
    return {hashlib.blake2b(k, digest_size=16).digest() for _, k in line_keys(text) if _long(k, least)}


@in_small_batches
def shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 width: int = WIDTH) -> DataFrame:
    """(doc_id, key) for every line key that the document has to lose. Rows of one doc_id count as one document."""
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def digests(batch):
        per_row = [_digests(t, min_chars) for t in batch.column("text").to_pylist()]
        flat = b"".join(d for s in per_row for d in s)
        return per_row, np.frombuffer(flat, np.uint64)[::2]

    def hashes(batch):
        return digests(batch)[1]

    work = Originals([(rows, None)])
    twice = sketch.build(work, hashes, width)

    def suspects(batches):
        for batch in batches:
            per_row, h = digests(batch)
            keep = sketch.holds(twice.value, h, width)
            ids = np.repeat(np.arange(len(per_row)), [len(s) for s in per_row])[keep]
            keys = [d for s in per_row for d in s]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(ids)), pa.array([keys[i] for i in np.flatnonzero(keep)], pa.binary())],
                                  ["doc_id", "key"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = cut_lineage(work.mapInArrow(suspects, f"doc_id {kind}, key binary").distinct())
    # written, so that the documents of a very common line can be split between tasks
    confirmed = cut_lineage(found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
                            .where(F.col("n") >= min_docs).select("key", "keeper"))
    return found.join(confirmed, "key").where(F.col("doc_id") != F.col("keeper")).select("doc_id", "key")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept (struct of the columns in keep): every row of docs without the lines that at least min_docs documents share.

    A key is the line, white space stripped at both ends, A-Z lowered; keys under min_chars code points stay. The largest
    doc_id holding a key keeps all its lines. A null text is one empty line and comes back as an empty text. Rows without
    doc_id are returned as they are and count for nothing. Rows of one doc_id are one document.
    """
    drops = (shared_lines(docs, doc_id, text, min_chars, min_docs, width).groupBy("doc_id")
             .agg(F.collect_list("key").alias("drops")))
    rows = pack_texts(docs, doc_id, text, keep).join(drops, "doc_id", "left")

    def rewrite(batches):
        for batch in slices(batches, "packed", PACKED_BYTES):
            texts, before, dropped = [], [], []
            for packed, drop in zip(batch.column("packed"), batch.column("drops")):
                body = unpack(packed.as_py())
                drop = set(drop.as_py() or ())
                lines = line_keys(body)
                kept = [line for line, key in lines if not (drop and _long(key, min_chars)
                                                            and hashlib.blake2b(key, digest_size=16).digest() in drop)]
                texts.append(b"\n".join(kept))
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.record_batch([batch.column("doc_id"), pc.cast(pa.array(texts, pa.binary()), pa.string()), pa.array(before, pa.int64()),
                                   pa.array(dropped, pa.int64()), batch.column("kept")], ["doc_id", "text", "n_lines", "n_dropped", "kept"])

    kind = docs.schema[doc_id].dataType.simpleString()
    fields = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(rewrite, f"doc_id {kind}, text string, n_lines long, n_dropped long, kept {fields}")
