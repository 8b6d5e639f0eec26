"""SentencePiece encoding and decoding by a forward pass shared between words with a common prefix.

White space is marked, and as no piece has a mark behind another character, marked words are encoded on their own. A batch's
distinct words are sorted, which is the depth-first order of their trie: a word starts from the forward states that its
common prefix with the word before has left on the stack. Unigram models keep the best score and last piece of each prefix
(Viterbi). For BPE models the best-scoring path is not their encoding; there the state is the last piece of the
prefix's own encoding, which is the one piece ending there that is compatible with the state it starts from: encoding
both pieces together gives these two again.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainweave.llm.shingles import slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
PAIRS = 400_000
SPINES = 40_000
KEPT_WORDS = 250_000
KEPT_LENGTH = 64      # longer words are encoded anew in every batch
NEVER = -1e30


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("models with a normalizer of their own are not supported")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self.prefix = norm.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        self.names = [p.piece for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        normal = {p.piece: (k, p.score) for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces span words")
        self.ids = {p: k for p, (k, _) in normal.items()}
        self.scores = {p: s for p, (_, s) in normal.items()}
        self.lowest = min(self.scores.values(), default=0.0) - 10.0
        self.control = {k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.spines = lru_cache(SPINES)(self._spines)
        self.pairs: dict[int, bool] = {}
        self.strange: dict[str, int] = {}
        self.pieces = list(self.names)
        self.trie: dict = {}
        for piece in normal:
            if self.kind == BPE and len(piece) > 1 and not piece.startswith(MARK + MARK) and self.merged(piece) != [piece]:
                continue  # merging never makes this piece
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = self.ids[piece]
        self.output = [n.encode() for n in self.names]
        for k, b in self.byte_of.items():
            self.output[k] = bytes([b])
        for k in self.control:
            self.output[k] = b""
        self.output[self.unknown] = " \u2047 ".encode()
        self.words: dict[str, bytes] = {}  # ids of words met, as 4-byte integers

    def merged(self, text: str, least: int = 1) -> list[str]:
        """BPE by its definition: merge the best-scoring neighbours, the leftmost of equals, until none is a piece (or `least` are left)."""
        parts = list(text)
        scores = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
        while len(parts) > least:
            best, at = None, 0
            for k, score in enumerate(scores):
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = self.scores.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = self.scores.get(parts[at] + parts[at + 1])
        return parts

    def _merged_run(self, text: str) -> list[str]:
        """merged() for texts of any length: a heap of neighbours, best score first, then the leftmost."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap = [(-score, k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (score := self.scores.get(a + b)) is not None]
        heapify(heap)
        while heap:
            _, k, whole = heappop(heap)
            after = right[k]
            if parts[k] is None or after >= len(parts) or parts[k] + parts[after] != whole:
                continue  # one of the two has merged otherwise since
            parts[k], parts[after], right[k] = whole, None, right[after]
            if right[k] < len(parts):
                left[right[k]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < len(parts) and (score := self.scores.get(parts[a] + parts[b])) is not None:
                    heappush(heap, (-score, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def _spines(self, piece: str) -> tuple[list, list]:
        """The parts at a piece's left and right edge while it is merged, each with the score at which it goes up in the next."""
        edges = []
        for side in (0, 1):
            part, until, edge = piece, NEVER, []
            while True:
                edge.append((part, until))
                if len(part) == 1:
                    break
                until, part = self.scores[part], self.merged(part, 2)[side]
            edges.append(edge)
        return edges[0], edges[1]

    def _joins(self, left: str, right: str) -> bool:
        """Whether encoding both together gives both again: no parts at their border merge before they are merged inwards."""
        for a, a_until in self.spines(left)[1]:
            for b, b_until in self.spines(right)[0]:
                score = self.scores.get(a + b)
                if score is not None and score > a_until and score >= b_until:
                    return False
        return True

    def _piece_id(self, c: str) -> int:
        """A number for a character that is no piece."""
        k = self.strange.get(c)
        if k is None:
            k = self.strange[c] = len(self.pieces)
            self.pieces.append(c)
        return k

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 24 | right] = self._joins(self.pieces[left], self.pieces[right])
        return known

    def _merge_states(self, word: str, states: list) -> None:
        """BPE: for each further prefix (start and id of its encoding's last piece, pieces still open as (start, trie node))."""
        root, pairs = self.trie, self.pairs
        for end in range(len(states) - 1, len(word)):
            c, start, last, alive = word[end], -1, -1, []
            for begin, node in states[end][2]:
                node = node.get(c)
                if node is not None:
                    alive.append((begin, node))
                    if start < 0:
                        piece = node.get("")
                        if piece is not None:
                            if begin:
                                left = states[begin][1]
                                known = pairs.get(left << 24 | piece)
                                if known is None:
                                    known = self._compatible(left, piece)
                                if not known:
                                    continue
                            start, last = begin, piece
            node = root.get(c)
            if node is not None:
                alive.append((end, node))
            if start < 0:
                piece = node.get("") if node else None
                start, last = end, self._piece_id(c) if piece is None else piece
            states.append((start, last, alive))

    def _best_states(self, word: str, states: list) -> None:
        """Unigram: for each further prefix (start of the best path's last piece, its score, pieces still open)."""
        for end in range(len(states) - 1, len(word)):
            c, start, best, alive = word[end], end, NEVER, []
            for begin, node in (*states[end][2], (end, self.trie)):
                node = node.get(c)
                if node is None:
                    continue
                alive.append((begin, node))
                if "" in node:
                    total = states[begin][1] + self.scores[self.pieces[node[""]]]
                    if total > best:
                        start, best = begin, total
            if best == NEVER:  # a character that is no piece
                best = states[end][1] + self.lowest
            states.append((start, best, alive))

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct marked words, walked in sorted order along their trie."""
        out, before, states = {}, "", [(0, 0.0 if self.kind == UNIGRAM else -1, ())]
        strange = len(self.names)
        walk = self._best_states if self.kind == UNIGRAM else self._merge_states
        for word in sorted(words):
            if self.kind == BPE and word.startswith(MARK + MARK):  # runs of marks tie in score
                out[word] = self._ids(self._merged_run(word))
                continue
            shared, least = 0, min(len(before), len(word))
            while shared < least and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            walk(word, states)
            ids, at = [], len(word)
            if self.kind == BPE:
                while at:
                    at, piece, _ = states[at]
                    if piece < strange:
                        ids.append(piece)
                    else:
                        ids.extend(reversed(self._ids([self.pieces[piece]])))
                ids.reverse()
            else:
                cuts = []
                while at:
                    start = states[at][0]
                    cuts.append(word[start:at])
                    at = start
                ids = self._ids(cuts[::-1])
            out[word] = ids
            before = word
        return out

    def split(self, text: str) -> list[str]:
        """Marked words: a run of marks with what follows it."""
        if not text:
            return []
        parts = ((" " if self.prefix else "") + text).replace(" ", MARK).split(MARK)
        out, marks = [], ""
        if parts[0]:
            out.append(parts[0])
        for part in parts[1:]:
            marks += MARK
            if part:
                out.append(marks + part)
                marks = ""
        if marks:
            out.append(marks)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else self.split(t) for t in texts]
        new = {w for words in split if words for w in words if w not in self.words}
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words = {}
            new = {w for words in split if words for w in words}
        for word, ids in self.encode_words(list(new)).items():
            self.words[word] = array("i", ids).tobytes()
        table = self.words
        out = [None if words is None else np.frombuffer(b"".join(map(table.__getitem__, words)), np.int32) for words in split]
        for word in new:
            if len(word) > KEPT_LENGTH:
                del table[word]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _kept(rows: DataFrame, keep: tuple[str, ...], value: str, name: str) -> DataFrame:
    """kept, a struct of the columns in keep, whatever their names, and the value."""
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    return rows.select(kept.alias("kept"), F.col(value).alias(name))


def encode_texts(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, token_ids (array<int>) and round_trip: whether decoding gives the text again.

    A null text has null ids and a null round_trip, an empty one no ids. A text holding the mark character itself decodes
    to a space there, so its round_trip is false. Names in keep must not be token_ids or round_trip; any other may stand in
    docs. The model travels as its file's bytes, a few hundred kilobytes whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _kept(docs, keep, text, "text")

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            for part in slices([batch]):
                texts = part.column("text").to_pylist()
                ids = codec.encode(texts)
                same = [None if t is None else codec.decode(i.tolist()) == t for t, i in zip(texts, ids)]
                yield pa.record_batch([part.column("kept"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["kept", "token_ids", "round_trip"])

    encoded = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, token_ids array<int>, round_trip boolean")
    return encoded.select(*(F.col("kept")[c].alias(c) for c in keep), "token_ids", "round_trip")


def decode_tokens(rows: DataFrame, model: bytes, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and text, the decoded ids; null for null ids. Names in keep must not be text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = _kept(rows, keep, ids, "ids")

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("kept"), pa.array(texts, pa.string())], ["kept", "text"])

    decoded = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, text string")
    return decoded.select(*(F.col("kept")[c].alias(c) for c in keep), "text")
