"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The tree's leaves are the byte positions of a piece; leaf i holds the rank of the pair that starts there, joined with i,
so that the root is the leftmost pair of least rank. A merge changes three leaves (the merged pair, the one before it
and the one that vanished), each with a logarithmic number of point updates, and live neighbours are linked lists.
Short pieces are merged side by side: rows of one array, one tree each; every step merges one pair in each unfinished
row. Long pieces have a tree of their own, so a text without any space costs n log n as well.

Pieces repeat, so a worker keeps those of its recent texts, those of the last two generations; forgetting costs time and
changes no result.

Null and empty texts have no ids and decode to nothing. Strings that look like special tokens are ordinary text. Rows
come out one for one, whatever their key; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit

#: Pieces longer than this have a tree of their own.
SHORT = 64
#: Pieces of a generation; a worker keeps those of the running and of the last one.
KEPT = 300_000
NONE = int(np.iinfo(np.int32).max)
#: Above rank * width + place of any piece; a tree of its own has Python's numbers.
BEYOND = 1 << 62
#: \\p{L} and \\p{N} up to U+02AF; texts without later characters are split by the faster of the two engines.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
NUMBERS = "0-9²³¹¼-¾"
BEYOND_LATIN = re.compile("[\u02b0-\U0010ffff]")
#: \\s of the pattern as Unicode's White_Space, which is what the reference tokeniser takes it for.
SPACE = r"\t-\r \x85\xa0  -     　"


class Ranks:
    """A vocabulary of byte strings and the ranks of the pairs that merge into them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            fields = (line.split() for line in lines if line.strip())
            self.rank = {base64.b64decode(a): int(b) for a, b in fields}
        self.bytes = {b: a for a, b in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.width = max(self.bytes) + 1
        pairs = {}
        for whole, r in self.rank.items():
            for cut in range(1, len(whole)):
                left, right = self.rank.get(whole[:cut]), self.rank.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = r
        self.pair_rank = pairs
        self._hash_pairs()
        exact = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", "[^" + SPACE + "]").replace(r"\s", "[" + SPACE + "]")
        self.pattern = regex.compile(exact)
        latin = exact.replace(r"[^" + SPACE + r"\p{L}\p{N}]", "[^" + SPACE + LETTERS + NUMBERS + "]")
        self.latin_pattern = re.compile(latin.replace(r"\p{L}", "[" + LETTERS + "]").replace(r"\p{N}", "[" + NUMBERS + "]"))
        self.store: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        return (self.pattern if BEYOND_LATIN.search(text) else self.latin_pattern).findall(text)

    def _hash_pairs(self) -> None:
        """The pairs in an open-addressed table, filled a probe at a time."""
        keys = np.array(list(self.pair_rank), np.int64)
        values = np.array(list(self.pair_rank.values()), np.int32)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.slot_key = np.full(self.mask + 1, -1, np.int64)
        self.slot_value = np.full(self.mask + 1, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slot_key[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.slot_key[slot[put]], self.slot_value[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(textkit.BASE)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE if they don't merge."""
        key = left.astype(np.int64) * self.width + right
        slot = self._slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_value[slot], np.int32(NONE))
        open_ = np.nonzero((found != key) & (found >= 0))
        while len(open_[0]):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.slot_key[slot[open_]]
            hit = found == key[open_]
            done = tuple(o[hit] for o in open_)
            out[done] = self.slot_value[slot[done]]
            open_ = tuple(o[~hit & (found >= 0)] for o in open_)
        return out

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian 32-bit) of pieces of at most `width` bytes; width is a power of two."""
        n = np.array([len(p) for p in pieces], np.int32)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        place = np.arange(width, dtype=np.int32)
        token = np.where(place < n[:, None], self.single[raw], np.int32(-1))
        after = np.where(place + 1 < n[:, None], place + 1, np.int32(width))
        before = np.broadcast_to(place - 1, token.shape).copy()
        tree = np.full((len(pieces), 2 * width), NONE, np.int32)
        rank = self.pairs(token[:, :-1], token[:, 1:])
        tree[:, width:-1] = np.where((rank != NONE) & (place[1:] < n[:, None]), rank * width + place[:-1], np.int32(NONE))
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        # NONE is no product of a rank and a width, so masked lanes may overflow before they are replaced
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            best = tree[row, 1]
            at, made = best % width, best // width
            gone = after[row, at]
            then = after[row, gone]
            token[row, at] = made
            token[row, gone] = -1
            after[row, at] = then
            has_next = then < width
            before[row[has_next], then[has_next]] = at[has_next]
            prior = before[row, at]
            has_prior = prior >= 0
            ahead = np.where(has_next, self.pairs(made, token[row, np.minimum(then, width - 1)]), NONE)
            behind = np.where(has_prior, self.pairs(token[row, np.maximum(prior, 0)], made), NONE)
            self._set(tree, row, width + at, np.where(ahead != NONE, ahead * width + at, NONE))
            self._set(tree, row, width + gone, np.full(len(row), NONE))
            self._set(tree, row[has_prior], width + prior[has_prior], np.where(behind != NONE, behind * width + prior, NONE)[has_prior])
            row = row[tree[row, 1] != NONE]
        live = token >= 0
        ids, ends = token[live].astype("<i4"), np.cumsum(live.sum(axis=1)).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _set(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point update of one leaf in each of the rows' trees."""
        tree[row, leaf] = value
        while len(leaf) and leaf[0] > 1:
            leaf = leaf >> 1
            tree[row, leaf] = np.minimum(tree[row, 2 * leaf], tree[row, 2 * leaf + 1])

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one piece of any length."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        token = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, none = self.pair_rank, BEYOND
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank.get(token[i] * self.width + token[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while (best := tree[1]) != none:
            made, at = divmod(best, width)
            gone = after[at]
            then = after[gone]
            token[at], token[gone], after[at] = made, -1, then
            put(gone, none)
            r = rank.get(made * self.width + token[then]) if then < n else None
            put(at, none if r is None else r * width + at)
            if then < n:
                before[then] = at
            if (prior := before[at]) >= 0:
                r = rank.get(token[prior] * self.width + made)
                put(prior, none if r is None else r * width + prior)
        return np.array([t for t in token if t >= 0], "<i4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of these pieces into the store."""
        if self.past:
            pieces = list(pieces)
            self.store.update([(p, ids) for p in pieces if (ids := self.past.get(p)) is not None])
            pieces = [p for p in pieces if p not in self.past]
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if raw in self.rank:
                self.store[piece] = np.array([self.rank[raw]], "<i4").tobytes()
            elif len(raw) > SHORT:
                self.store[piece] = self.merge_one(raw)
            else:
                names, raws = by_width.setdefault(1 << (len(raw) - 1).bit_length(), ([], []))
                names.append(piece)
                raws.append(raw)
        for width, (names, raws) in by_width.items():
            step = 16_000
            for i in range(0, len(raws), step):
                self.store.update(zip(names[i : i + step], self.merge_many(raws[i : i + step], width), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian 32-bit."""
        out: list[bytes] = []
        group: list[tuple[list[str], list[bytes | None]]] = []
        size = 0
        for k, text in enumerate(texts):
            pieces = self.split(text)
            group.append((pieces, list(map(self.store.get, pieces))))
            size += len(text)
            if size >= textkit.STEP_BYTES or k == len(texts) - 1:
                gaps = [[i for i, ids in enumerate(known) if ids is None] for _, known in group]
                self.learn({pieces[i] for (pieces, _), at in zip(group, gaps, strict=True) for i in at})
                for (pieces, known), at in zip(group, gaps, strict=True):
                    for i in at:
                        known[i] = self.store[pieces[i]]
                    out.append(b"".join(known))
                group, size = [], 0
                if len(self.store) > KEPT:
                    self.past, self.store = self.store, {}
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: each match of the pattern merged by the ranks in the file, without special tokens."""
    textkit.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks(path, pattern)
        for batch in batches:
            parts = model.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return made.select(F.col("id").alias(key), "ids")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, ids, decoded binary: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ranks(path, pattern)
        for batch in batches:
            decoded = [model.decode(ids) for ids in map(lambda x: x.as_py() or (), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    rows = encoded.select(F.col(key).alias("id"), "ids")
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
    return made.select(F.col("id").alias(key), "ids", "decoded")
