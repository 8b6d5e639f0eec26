"""Find short benchmark items inside long documents: size-partitioned MinHash containment search.

Fixed-length signatures cannot show a 20-shingle item in a 20,000-shingle document: their Jaccard similarity is 0.001. So
items are partitioned by size, and an item of q shingles keeps its k = q - ceil(t q) + 1 smallest hashes, which is what
its containment threshold t needs: a document that holds t of the item holds one of them. Documents probe the items'
minima, classes of sizes they cannot hold left out, and candidates are verified by their exact shingle containment.

Documents are scanned once. Which shingles may belong to items is told by bounded bit filters, so neither items nor
documents are broadcast; only documents with a hit are shuffled, with the shingles they may share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm import sketch
from rainweave.llm.packing import in_small_batches
from rainweave.llm.ngram_join import ngram_sets
from rainweave.llm.shingles import mix, slices
from rainweave.session import cut_lineage

N = 5
PERCENT = 80
WIDTH = 24


def _item_sketches(items: DataFrame, n: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            row, h = ngram_sets(batch.column("text"), n)
            order = np.lexsort((mix(h), row))
            row, h = row[order], h[order].view(np.int64)
            size = np.bincount(row, minlength=batch.num_rows)
            begin = np.concatenate(([0], np.cumsum(size)))
            k = np.where(size > 0, size + (-percent * size // 100) + 1, 0)
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("item_id"), pa.array(size.astype(np.int64)), pa.array([h[b:b + c] for b, c in zip(begin, k)], kind),
                                   pa.array([h[b:e] for b, e in zip(begin, begin[1:])], kind)], ["item_id", "n_item", "minima", "shingles"])

    return items.mapInArrow(run, "item_id long, n_item long, minima array<long>, shingles array<long>")


@in_small_batches
def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", n: int = N, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for each item of which a document holds at least percent.

    Shingles are n words, A-Z lowered; an item with fewer words is one shingle, its whole sequence, held by documents of
    exactly these words. Items or documents without words or id match nothing. Rows repeating an id are judged each by
    its own text; the pair is reported once with the largest overlap.
    """
    items = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    docs = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = cut_lineage(_item_sketches(items, n, percent))
    values = lambda name: lambda batch: batch.column(name).flatten().to_numpy().view(np.uint64)
    probes = sketch.build(sketches.select("minima"), values("minima"), width, twice=False)
    held = sketch.build(sketches.select("shingles"), values("shingles"), width, twice=False)

    def scan(batches):
        for batch in slices(batches):
            row, h = ngram_sets(batch.column("text"), n)
            size = np.bincount(row, minlength=batch.num_rows)
            hit = sketch.holds(probes.value, h, width)
            some = np.unique(row[hit])
            both = np.isin(row, some)
            row, h, hit = row[both], h[both], hit[both]
            known = sketch.holds(held.value, h, width)
            take = lambda mask: [h[mask][a:b].view(np.int64) for a, b in zip(np.searchsorted(row[mask], some), np.searchsorted(row[mask], some, "right"))]
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(some)), pa.array(size[some].astype(np.int64)), pa.array(take(hit), kind),
                                   pa.array(take(known), kind)], ["doc_id", "n", "probes", "known"])

    hits = cut_lineage(docs.mapInArrow(scan, "doc_id long, n long, probes array<long>, known array<long>"))
    least = F.ceil(F.col("n_item") * percent / 100)
    classed = sketches.select("item_id", least.alias("least"), F.explode("minima").alias("h"))
    pairs = (hits.select("doc_id", "n", F.explode("probes").alias("h")).join(classed, "h").where("n >= least").select("doc_id", "item_id").distinct())
    both = pairs.join(hits.select("doc_id", "known"), "doc_id").join(sketches.select("item_id", "n_item", "shingles"), "item_id")
    return (both.select("doc_id", "item_id", F.size(F.array_intersect("known", "shingles")).cast("long").alias("n_shared"), "n_item")
            .where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
            .groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id of every document that holds an item."""
    return contained_items(docs, items, **options).select("doc_id").distinct()
