"""Ranked lexical search: exact top documents by best-first document intervals over range-maximum tables.

The terms of a block of items are few; one scan of the texts keeps only how often each document holds them. Document
frequencies and lengths are counted over all documents before anything is scored. A task then gathers documents into
shards of a bounded number of postings. Each term's posting list in a shard gets a sparse table of range maxima, so the
largest impact in any interval of documents is two look-ups. An item's search starts from the whole shard: the interval
whose summed maxima are largest is taken first, its document of largest impact is scored exactly, and the intervals left
and right of it go back with their own sums. It ends when no interval can enter the best k, ties included.

Shards meet no other shard: each gives at most k documents an item. A hashed sixteenth of the documents is searched first;
its k-th scores are a floor for all other shards, so what goes to the final ranking does not grow with the corpus.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainweave.llm.packing import in_small_batches
from rainweave.llm.shingles import PIECE, Terms, slices
from rainweave.session import cut_lineage

K = 50
ITEM_BLOCK = 1024
MOST_POSTINGS = 1 << 19
MOST_DOCUMENTS = 1 << 16
SEED_SHARE = 16
POPS = 16


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): hashes of the distinct terms of each item; rows of one item_id are one item. Items without id or term are left out."""
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def split(batches):
        for batch in slices(batches, most=PIECE):
            found = Terms(batch.column("text"), lower=True)
            terms = [np.unique(found.hashes[0][a:b]).view(np.int64) for a, b in zip(found.first, found.first[1:])]
            yield pa.record_batch([batch.column("item_id"), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    return (rows.mapInArrow(split, f"item_id {kind}, terms array<long>").where(F.size("terms") > 0)
            .groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")))


def held_terms(docs: DataFrame, wanted: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms in the text), terms (places in wanted, ascending) and counts, for each document with a term.

    Terms are compared by 64-bit hashes; wanted is sorted and bounded by the block of items.
    """
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches):
        wanted = shared.value
        for batch in slices(batches, most=PIECE):
            found = Terms(batch.column("text"), lower=True)
            at = np.searchsorted(wanted, found.hashes[0])
            at[at == len(wanted)] = 0
            hit = np.flatnonzero(wanted[at] == found.hashes[0])
            pairs, counts = np.unique(found.text[hit] * len(wanted) + at[hit], return_counts=True)
            bounds = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(wanted)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32))) for v in (pairs % len(wanted), counts)]
            out = pa.record_batch([batch.column("doc_id"), pa.array(found.counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(found.counts > 0))

    return rows.mapInArrow(scan, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def frequencies(held: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents, and terms of all documents with their repeats."""

    def count(batches):
        total = np.zeros(terms + 2, np.int64)
        for batch in batches:
            total[:terms] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
            total[terms] += batch.num_rows
            total[terms + 1] += batch.column("n").to_numpy().sum()
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(terms + 2, np.int64)
    for term, n in held.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a block's terms
        out[term] = n
    return out[:terms], int(out[terms]), int(out[terms + 1])


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


class Shard:
    """Posting lists of some documents: term by term, documents in the order given, with the impact of each posting."""

    def __init__(self, ids: np.ndarray, n_terms: int, owner: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((owner, term))
        self.ids, self.size = ids, len(ids)
        self.at, term, self.impact = owner[order], term[order], impact[order]
        self.key = term * self.size + self.at
        self.begin = np.searchsorted(term, np.arange(n_terms + 1))
        self.least_id = self._table(-ids)[0]
        longest = int(np.diff(self.begin).max(initial=0))
        self.top, self.log = self._table(self.impact, longest)

    @staticmethod
    def _table(values: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Level j, place i: where the largest of the values i .. i + 2**j - 1 stands, the first of equal ones."""
        n = len(values)
        longest = n if longest is None else longest
        levels = max(1, int(longest).bit_length())
        table = np.zeros((levels, max(n, 1)), np.int32)
        table[0, :n] = np.arange(n)
        for j in range(1, levels):
            step, count = 1 << (j - 1), n - (1 << j) + 1
            a, b = table[j - 1, :count], table[j - 1, step:step + count]
            table[j, :count] = np.where(values[a] >= values[b], a, b)
        return table, np.array([max(0, k.bit_length() - 1) for k in range(longest + 1)], np.int64)

    def smallest_id(self, lo: int, hi: int) -> int:
        j = (hi - lo).bit_length() - 1
        return min(self.ids[self.least_id[j, lo]], self.ids[self.least_id[j, hi - (1 << j)]])

    def bounds(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the sum of the terms' largest impacts among postings left .. right - 1, and the document of the largest one."""
        length = right - left
        level = self.log[length]
        some = length > 0
        a = self.top[level, np.where(some, left, 0)]
        b = self.top[level, np.where(some, right - (1 << level), 0)]
        first, second = self.impact[a], self.impact[b]
        best = np.where(some, np.maximum(first, second), 0)
        column = best.argmax(axis=1)
        rows = np.arange(len(best))
        place = np.where(first[rows, column] >= second[rows, column], a[rows, column], b[rows, column])
        return best.sum(axis=1), self.at[place]

    def best(self, terms: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, id) of the k largest scores above 0 and not under floor; of equal scores those of smaller id."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        if not len(terms):
            return []
        left, right = self.begin[terms][None, :], self.begin[terms + 1][None, :]
        total, split = self.bounds(left, right)
        heap = [(-int(total[0]), self.smallest_id(0, self.size), 0, 0, self.size, int(split[0]), left[0], right[0])] if total[0] >= max(floor, 1) else []
        held: list[tuple[int, int]] = []  # (score, -id), the worst first
        serial = 0
        while heap:
            popped = []
            while heap and len(popped) < POPS:
                entry = heapq.heappop(heap)
                if len(held) == k and (-entry[0], -entry[1]) < held[0]:
                    heap.clear()
                    break
                popped.append(entry)
            if not popped:
                break
            doc = np.array([e[5] for e in popped])
            left, right = np.stack([e[6] for e in popped]), np.stack([e[7] for e in popped])
            place = np.searchsorted(self.key, terms[None, :] * self.size + doc[:, None])
            hit = (place < right) & (self.at[np.minimum(place, len(self.at) - 1)] == doc[:, None])
            scores = (self.impact[np.minimum(place, len(self.at) - 1)] * hit).sum(axis=1)
            for score, d in zip(scores.tolist(), doc.tolist()):
                entry = (score, -int(self.ids[d]))
                if score >= max(floor, 1):
                    if len(held) < k:
                        heapq.heappush(held, entry)
                    elif entry > held[0]:
                        heapq.heapreplace(held, entry)
            least = max(floor, 1, held[0][0] if len(held) == k else 1)
            lefts, rights = np.concatenate((left, place + hit)), np.concatenate((place, right))
            total, split = self.bounds(lefts, rights)
            spans = [(e[3], d) for e, d in zip(popped, doc.tolist())] + [(d + 1, e[4]) for e, d in zip(popped, doc.tolist())]
            for i in np.flatnonzero(total >= least).tolist():
                lo, hi = spans[i]
                serial += 1
                heapq.heappush(heap, (-int(total[i]), self.smallest_id(lo, hi), serial, lo, hi, int(split[i]), lefts[i], rights[i]))
        return sorted(((s, -d) for s, d in held), key=lambda x: (-x[0], x[1]))


def search(held: DataFrame, items: list[tuple], weight: np.ndarray, documents: int, length: int, k: int, floors: np.ndarray | None = None) -> DataFrame:
    """item (its place in items), doc_id, score: of every shard the k best for each item, not under the item's floor.

    items are (item_id, places of its terms); they, the weights and the floors are bounded by the block of items.
    """
    floors = np.zeros(len(items), np.int64) if floors is None else floors
    shared = held.sparkSession.sparkContext.broadcast(([t for _, t in items], weight, floors))
    kind = held.schema["doc_id"].dataType.simpleString()

    def shards(batches):
        parts, postings, rows = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                parts.append(part)
                postings += len(part.column("terms").flatten())
                rows += part.num_rows
                if postings >= MOST_POSTINGS or rows >= MOST_DOCUMENTS:
                    yield pa.Table.from_batches(parts)
                    parts, postings, rows = [], 0, 0
        if parts:
            yield pa.Table.from_batches(parts)

    def run(batches):
        terms_of, weight, floors = shared.value
        for table in shards(batches):
            table = table.combine_chunks().sort_by([("n", "ascending"), ("doc_id", "ascending")])  # like lengths bound each other best
            ids = table.column("doc_id").to_numpy()
            lists = table.column("terms").combine_chunks()
            owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 100 - 50 + (50 * table.column("n").to_numpy() * documents) // length
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
            shard = Shard(ids, len(weight), owner, term, impact)
            out = [(i, d, s) for i, terms in enumerate(terms_of) for s, d in shard.best(terms, k, int(floors[i]))]
            if out:
                item, doc, score = zip(*out)
                yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, table.schema.field("doc_id").type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return held.mapInArrow(run, f"item int, doc_id {kind}, score long")


def top(rows: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id"))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


@in_small_batches
def rank_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the k documents of largest score above 0, equal scores by ascending doc_id.

    Terms are maximal runs of ASCII letters, digits and code points above 0x7F, A-Z lowered. A term's weight is
    floor(1000 ln((2N + 2) / (2df + 1))) and a document's score the sum over the item's terms, once each, of
    weight * (10**9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L). Rows without doc_id or text count for nothing; rows
    that repeat a doc_id (an integer) are documents of their own; rows that repeat an item_id are one item. Empty tables and
    items without terms give no rows.
    """
    spark = docs.sparkSession
    asked = cut_lineage(item_terms(items, item_id, item_text))
    blocks = max(1, -(-asked.count() // ITEM_BLOCK))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()  # about ITEM_BLOCK items
        wanted = np.unique(np.concatenate([np.array(r.terms, np.int64) for r in rows])).view(np.uint64) if rows else np.zeros(0, np.uint64)
        wanted = np.sort(wanted)
        if not len(wanted):
            continue
        held = cut_lineage(held_terms(docs, wanted, doc_id, text))
        df, documents, length = frequencies(held, len(wanted))
        if not documents:
            continue
        weight = weights(df, documents)
        listed = [(r.item_id, np.searchsorted(wanted, np.sort(np.array(r.terms, np.int64).view(np.uint64)))) for r in rows]
        seed = F.pmod(F.xxhash64("doc_id"), F.lit(SEED_SHARE)) == 0
        early = cut_lineage(top(search(held.where(seed), listed, weight, documents, length, k), k))
        floors = np.zeros(len(listed), np.int64)
        for r in early.where(F.col("rank") == k).collect():  # one row an item of the block
            floors[r["item"]] = r["score"]
        late = search(held.where(~seed), listed, weight, documents, length, k, floors)
        found = top(early.drop("rank").unionByName(late), k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(listed)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        part = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    return spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long")
