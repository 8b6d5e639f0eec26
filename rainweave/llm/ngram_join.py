"""Documents whose n-gram sets are similar, by a blocked sparse product of the document by n-gram incidence.

Columns (n-grams) are ordered rare first, by a count-min estimate of their count and then by hash. A document's first
block holds its n - ceil(t n) + 1 rarest columns: two documents with Jaccard similarity t share a column there. The product
over the first block accumulates overlaps per pair; a pair goes on only if its overlap so far plus the largest rest that
the sizes allow reaches the least overlap that t asks of both sizes. The second block is multiplied for those pairs
alone, as sparse dot products of the two rows.

A column shared by many documents is never paired all with all. First each of its documents is paired with two hubs of the
column, and accepted links merge documents into components; then only documents outside the column's largest component
are paired, with documents of other components. So every link between two components is found, and none inside one is
needed. Columns met in one document only are left out of the product by a count-min sketch that misses no repeated one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm import graph, sketch
from rainweave.llm.packing import in_small_batches
from rainweave.llm.shared_copies import Originals, row_key, split_copies, text_digest
from rainweave.llm.shingles import Words, mix, slices
from rainweave.session import cut_lineage

N = 5
PERCENT = 80
WIDTH = 28
LEVEL_WIDTH = 24
COLUMN_PART = 4096


def ngram_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct n-grams, ascending; the whole sequence of a text with fewer words."""
    words = Words(column, lower=True)
    h, at = words.ngrams(n)
    row = words.text[at]
    whole, texts = words.whole()
    short = words.counts[texts] < n
    h, row = np.concatenate((h, whole[short])), np.concatenate((row, texts[short]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def _index(work: Originals, n: int, percent: int, width: int, level_width: int) -> DataFrame:
    """doc_id, key, n, and for documents that can have a partner: first (columns of the first block) and rest (the others)."""
    repeated = sketch.build(work, lambda b: ngram_sets(b.column("text"), n)[1], width)

    def common(batch):
        h = ngram_sets(batch.column("text"), n)[1]
        return h[sketch.holds(repeated.value, h, width)]

    levels = sketch.count_levels(work, common, level_width)

    def rows(batches):
        for batch in batches:
            row, h = ngram_sets(batch.column("text"), n)
            size = np.bincount(row, minlength=batch.num_rows)
            known = sketch.holds(repeated.value, h, width)
            least = -(-percent * size // 100)
            able = (np.bincount(row[known], minlength=batch.num_rows) >= least) & (size > 0)
            mine = known & able[row]
            row, h = row[mine], h[mine]
            order = np.lexsort((mix(h), levels.value[sketch.cells(h, 0, level_width)], row))
            row, h = row[order], h[order].view(np.int64)
            have = np.bincount(row, minlength=batch.num_rows)
            begin = np.concatenate(([0], np.cumsum(have)))
            first, rest = [], []
            for k in range(batch.num_rows):
                if not able[k]:
                    first.append(None)
                    rest.append(None)
                    continue
                alone = size[k] - have[k]  # columns of this document alone come first in the order and meet nothing
                cut = begin[k] + size[k] - least[k] + 1 - alone
                first.append(h[begin[k]:cut])
                rest.append(h[cut:begin[k + 1]])
            kind = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(size.astype(np.int64)), pa.array(first, kind), pa.array(rest, kind)],
                                  ["doc_id", "key", "n", "first", "rest"])

    return cut_lineage(work.mapInArrow(rows, "doc_id long, key long, n long, first array<long>, rest array<long>"))


def _links(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches percent, by the product over both blocks."""
    row = lambda side: index.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.concat("first", "rest").alias(f"x{side}"))
    both = pairs.join(row("a"), "a").join(row("b"), "b")

    def multiply(batches):
        for batch in batches:
            keep = []
            for na, nb, xa, xb in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("xa"), batch.column("xb")):
                overlap = len(np.intersect1d(xa.values.to_numpy(), xb.values.to_numpy(), assume_unique=True))
                keep.append(100 * overlap >= percent * (na + nb - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(multiply, "a long, b long")


@in_small_batches
def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, width: int = WIDTH,
                       level_width: int = LEVEL_WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    Documents link when 100 * intersection >= percent * union of their sets of n lowered words (A-Z); component_id is the
    smallest doc_id reachable. A text with fewer words has one shingle, its whole sequence; one without words, or null, has
    none and links with nothing. doc_id is an integer; rows without it form no links and have a null component; rows of
    one doc_id count as linked to each other.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    work, later = split_copies(rows.where(wordy))
    index = _index(work, n, percent, width, level_width)
    wordless = rows.where(F.col("doc_id").isNotNull() & ~wordy).select("doc_id", F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("n"))  # copies, too, link with nothing
    # a copy has its first's component; where its doc_id stands in other rows as well, that is a link between the two
    elsewhere = (index.select("doc_id").unionByName(wordless.select("doc_id"))
                 .unionByName(later.groupBy("doc_id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("doc_id")))
    twice = later.join(elsewhere, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = graph.components(_all_links(index.where("first is not null"), percent).unionByName(twice))

    own = index.select("doc_id", "key", "n").unionByName(wordless).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    copies = rows.where("doc_id is not null").select("doc_id", text_digest().alias("digest")).join(later.distinct(), ["doc_id", "digest"]).select("doc_id", "first", row_key("first"))
    # written, so that a large group of copies can be split between tasks
    firsts = cut_lineage(own.join(later.select(F.col("first").alias("doc_id"), row_key("first")).distinct(), ["doc_id", "key"], "left_semi").groupBy(F.col("doc_id").alias("first"), "key")
                         .agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")))
    nameless = rows.where("doc_id is null").select("doc_id", "text")

    def count(batches):
        for batch in slices(batches):
            row, _ = ngram_sets(batch.column("text"), n)
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)), batch.column("doc_id")],
                                  ["doc_id", "n_shingles", "component_id"])

    columns = ["doc_id", "n_shingles", "component_id"]
    return (own.select(*columns).unionByName(copies.join(firsts, ["first", "key"]).select(*columns))
            .unionByName(nameless.mapInArrow(count, "doc_id long, n_shingles long, component_id long")))


def _all_links(able: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect whatever the links between all documents connect."""
    cells = able.select(F.explode("first").alias("h"), "doc_id", "n")

    # each document with two hubs of each of its columns
    hubs = (cells.groupBy("h").agg(F.min(F.struct("doc_id", "n")).alias("u"), F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "n")).alias("v"),
                                   F.count("*").alias("k")).where("k > 1"))
    hubs = hubs.select("h", F.explode(F.array(F.col("u"), F.struct("v.doc_id", "v.n"))).alias("hub"))
    star = (cells.join(hubs, "h").where(F.col("doc_id") != F.col("hub.doc_id"))
            .select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"),
                    F.least("n", "hub.n").alias("low"), F.greatest("n", "hub.n").alias("high"))
            .where(F.col("low") * 100 >= F.col("high") * percent).select("a", "b").distinct())
    links = cut_lineage(_links(star, able, percent))

    # documents of a column outside its largest component, with those of other components
    merged = graph.components(links).withColumnRenamed("node", "doc_id")
    placed = cells.join(merged, "doc_id", "left").select("h", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    counts = placed.groupBy("h", "c").agg(F.count("*").alias("k"))
    main = counts.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("h", "main")
    placed = cut_lineage(placed.join(main, "h"))
    largest = placed.groupBy("h").count().agg(F.max("count")).first()[0] or 1
    part = F.pmod(F.xxhash64("doc_id"), F.lit(-(-largest // COLUMN_PART)))  # all of a document's columns lie in one part
    columns = placed.groupBy("h", part.alias("part")).agg(F.collect_list(F.struct("doc_id", "n", "c")).alias("members"))
    inside = placed.groupBy(F.col("doc_id").alias("x")).agg(F.count_if(F.col("c") == F.col("main")).alias("elsewhere"))
    rows = (placed.where("c <> main").select("h", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), "main")
            .join(inside, "x").join(columns, "h").groupBy("x", "nx", "part"))  # rows of one doc_id differ in size, or count together
    met = (rows.applyInArrow(lambda table: _product(table, percent), "a long, b long, total long, high long, met long")
           .groupBy("a", "b", "total", "high").agg(F.sum("met").alias("met")))
    return links.unionByName(cut_lineage(_links(_bounded(met, percent), able, percent)))


def _product(table: pa.Table, percent: int) -> pa.Table:
    """One document's row times its columns' members in one part: overlap with each member of another component.

    A column with both outside the main component is emitted by the row of the smaller id only, but counts in the bounds of
    both rows: what a row has not counted are columns with x in the main component (elsewhere). Pairs that stay under the
    least overlap even if they share all of these are discarded here.
    """
    lists = table.column("members").combine_chunks()
    which = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    y, ny, cy = (lists.flatten().field(k).to_numpy() for k in range(3))
    x, nx, cx, main = (table.column(k).to_numpy() for k in ("x", "nx", "cx", "main"))
    x, nx, cx = x[0], nx[0], cx[0]
    keep = (cy != cx) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent)
    mine = ((cy == main[which]) | (x < y))[keep]
    y, ny = y[keep], ny[keep]
    number = np.unique(y, return_inverse=True)[1] * (int(ny.max(initial=0)) + 1) + ny  # a member is a doc_id and a size
    _, at, back, shared = np.unique(number, return_index=True, return_inverse=True, return_counts=True)
    y, ny = y[at], ny[at]
    met = np.bincount(back[mine], minlength=len(y))
    most = shared + table.column("elsewhere")[0].as_py() + -(-percent * np.maximum(nx, ny) // 100) - 1
    able = (met > 0) & (most >= -(-percent * (nx + ny) // (100 + percent)))
    y, ny, met = y[able], ny[able], met[able]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "total": nx + ny, "high": np.maximum(nx, ny), "met": met.astype(np.int64)})


def _bounded(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, total: sum of sizes, high: larger size, met: overlap in the first block) that may still reach the least overlap.

    What the first block has not counted lies in the rest of the row whose first block ends earlier in the column order.
    """
    need = F.ceil(F.col("total") * percent / (100 + percent))
    rest = F.ceil(F.col("high") * percent / 100) - 1
    return met.where(F.col("met") + rest >= need).select("a", "b")
