"""Order-preserving packing of token streams into sequences by dynamic programming.

The documents of a partition stand one after another in their order. Cuts may stand at ends of documents (free), at ends
of sentences inside a document (`truncation` each) and, where a sentence is longer than a sequence, inside it
(`broken` each). A sequence costs its padding, and nothing if its length is a power of two; short ones cost `short` so
that the stream isn't cut up for their sake. The least total is found by one pass over the cuts: padding is linear in
the start of the sequence, so the best start among those in reach is at the head of a monotone queue, and starts at a
power of two before a cut are looked up.

A partition is worked on in stretches of about `stretch` tokens, so a worker's memory doesn't grow with it. Sequences
don't cross partitions and their ids hold the partition's number, so nothing is shuffled.

Null and empty texts are their end token alone. Every row of the input is packed once, repeated rows and rows with a
null key too. An empty table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit

#: Words of a generation, about 30 bytes each; a worker keeps those of the running and of the last one.
KEPT = 1_000_000
#: Bytes of text whose words are looked for at once.
STEP_BYTES = 1_000_000
LEAST_SHORT = 64
#: Marks that end a sentence before a space.
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
#: A run of letters that neither composition nor lower case changes, and a mark that the tokenizer keeps apart from it.
PLAIN = re.compile("^(?:([a-zß-öø-ÿ]+)([.,]?)|.*)$", re.MULTILINE)


class Table:
    """Ids of words, found by the words' hashes: sorted hashes, and where each word's ids stand in one array."""

    def __init__(self):
        self.hashes, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        row = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return row, self.hashes[row] == hashes

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids the words in these rows have, and the ids one after another."""
        return self.size[rows], self.ids[spread(self.start[rows], self.size[rows])]

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Words by ascending hashes that aren't in the table yet."""
        where = np.searchsorted(self.hashes, hashes)
        start = len(self.ids) + np.cumsum(size) - size
        self.hashes, self.start, self.size = np.insert(self.hashes, where, hashes), np.insert(self.start, where, start), np.insert(self.size, where, size)
        self.ids = np.concatenate((self.ids, ids))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each run."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that drops white space: each word is tokenised once and kept.

    Words are told apart by a 64-bit hash of their bytes and length. When KEPT words are kept, they become the last
    generation, from which words that still occur are taken over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words, self.past = Table(), Table()

    def tokenise(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        # most words are one run of letters, perhaps with a mark after it: the model alone does for these
        parts = PLAIN.findall(b"\n".join(words).decode().lower())
        merge = self.model.model.tokenize
        plain = {core: [t.id for t in merge(core)] for core in {core for core, _ in parts} if core}
        marks = {m: self.whole([m])[0] for m in {m for _, m in parts} if m}
        marks[""] = []
        odd = iter(self.whole([w.decode() for w, (core, _) in zip(words, parts, strict=True) if not core]))
        return [plain[core] + marks[m] if core else next(odd) for core, m in parts]

    def whole(self, words: list[str]) -> list[list[int]]:
        """Ids of words by the whole tokenizer."""
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, raw: bytes, first: np.ndarray, last: np.ndarray) -> None:
        """Put words, by ascending hashes, into the table."""
        row, old = self.past.find(hashes)
        fresh = np.flatnonzero(~old)
        made = self.tokenise([raw[i:j] for i, j in zip(first[fresh].tolist(), last[fresh].tolist(), strict=True)])
        size = np.zeros(len(hashes), np.int32)
        size[fresh] = np.fromiter(map(len, made), np.int32, len(made))
        size[old] = self.past.size[row[old]]
        start = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.uint32)
        ids[spread(start[fresh], size[fresh])] = np.fromiter(chain.from_iterable(made), np.uint32, int(size[fresh].sum()))
        ids[spread(start[old], size[old])] = self.past.of(row[old])[1]
        self.words.add(hashes, size, ids)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts one after another; where each text's ids begin; and how many ids stand before the end of each
        sentence: a line's end, or a stop, exclamation or question mark before a space."""
        if len(self.words.hashes) > KEPT:
            self.past, self.words = self.words, Table()
        spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for lo, hi in pieces_of(data, at):
            edges = at[(at >= lo) & (at <= hi)] - lo
            first, last, _ = textkit.word_spans(data[lo:hi], np.unique(np.concatenate(([0], edges, [hi - lo]))))
            spans.append((first + lo, last + lo, textkit.span_hashes(data[lo:hi], first, last)))
        first, last, hashes = (np.concatenate(c) for c in zip(*spans, strict=True))
        del spans
        word, different = pd.factorize(hashes)
        sample = np.zeros(len(different), np.int64)
        sample[word[::-1]] = np.arange(len(hashes))[::-1]  # where each word stands first
        up = np.argsort(different)
        missing = up[~self.words.find(different[up])[1]]
        if len(missing):
            self.learn(different[missing], data.tobytes(), first[sample[missing]], last[sample[missing]])
        row = np.empty(len(different), np.int64)
        row[up] = self.words.find(different[up])[0]
        size, ids = self.words.of(row[word])
        before = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        stop = np.zeros(len(data), bool)
        stop[1:] = (data[1:] == 32) & STOPS[data[:-1]]
        stop |= data == 10
        return ids, before[np.searchsorted(first, at)], before[np.searchsorted(first, np.flatnonzero(stop))]


def pieces_of(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about STEP_BYTES that end with a text, or, in longer ones, at white space; a word that is longer
    yet has a range of its own."""
    for i, j in textkit.steps(at, STEP_BYTES):
        lo, end = int(at[i]), int(at[j])
        while end - lo > 2 * STEP_BYTES:
            gaps = np.flatnonzero(textkit.WHITE[data[lo + STEP_BYTES : lo + 2 * STEP_BYTES]])
            if len(gaps):
                hi = lo + STEP_BYTES + int(gaps[0])
            else:
                rest = np.flatnonzero(textkit.WHITE[data[lo + 2 * STEP_BYTES : end]])
                hi = lo + 2 * STEP_BYTES + int(rest[0]) if len(rest) else end
            yield lo, hi
            lo = hi
        if end > lo:
            yield lo, end


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_cuts(place: list[int], price: list[int], size: int, short: int) -> list[int]:
    """Indices of the chosen cuts, first and last included. place: token positions, ascending from 0; price: of a cut
    there. Neighbouring positions are at most `size` apart."""
    total = [0] * len(place)
    come = [0] * len(place)
    at = np.array(place, np.int64)
    links: dict[int, list[int]] = {}  # of a cut, those that stand a power of two before it
    power = LEAST_SHORT
    while power < size:
        where = np.searchsorted(at, at - power)
        here = np.flatnonzero((at >= power) & (at[where] == at - power))
        for j, k in zip(here.tolist(), where[here].tolist(), strict=True):
            links.setdefault(j, []).append(k)
        power *= 2
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # key total + place, place, index; keys ascending
    for j in range(1, len(place)):
        here = place[j]
        while here - queue[0][1] > size:
            queue.popleft()
        key, _, i = queue[0]
        best = key + size - here
        if j in links:
            for k in links[j]:
                if total[k] + short < best:
                    best, i = total[k] + short, k
        total[j] = best = best + price[j]
        come[j] = i
        key = best + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    cuts = [len(place) - 1]
    while cuts[-1]:
        cuts.append(come[cuts[-1]])
    return cuts[::-1]


def pack(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int = 2, size: int = 4096,
    truncation: int = 8, broken: int = 256, short: int = 32, stretch: int = 1_000_000,
) -> DataFrame:
    """A row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    textkit.bounded_batches(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def pieces(held: list[tuple[object, bytes, np.ndarray]], sequence: int) -> tuple[pa.RecordBatch, int]:
        place, price, begins, ids = [0], [0], [], []
        at = 0
        for _, own, stops in held:
            begins.append(at)
            ids.append(own)
            cost = np.full(len(stops), truncation)
            wide = np.flatnonzero(np.diff(stops) > size)
            if len(wide):
                inside = np.concatenate([np.arange(stops[k] + size, stops[k + 1], size) for k in wide])
                where = np.searchsorted(stops, inside)
                stops, cost = np.insert(stops, where, inside), np.insert(cost, where, broken)
            cost[-1] = 0
            place += (at + stops[1:]).tolist()
            price += cost[1:].tolist()
            at += len(own) // 4
        cuts = [place[c] for c in best_cuts(place, price, size, short)]
        columns: dict[str, list] = {c: [] for c in ("id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        ends = [*begins[1:], at]
        d = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            while ends[d] <= a:
                d += 1
            k = d
            while k < len(ends) and begins[k] < b:
                lo, hi = max(a, begins[k]), min(b, ends[k])
                row = (held[k][0], lo - begins[k], hi - lo, ids[k][4 * (lo - begins[k]) : 4 * (hi - begins[k])], ends[k] - begins[k], sequence, lo - a)
                for c, v in zip(columns.values(), row, strict=True):
                    c.append(v)
                k += 1
            sequence += 1
        kinds = (key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], names=list(columns)), sequence

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    key_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.release()
        model = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[object, bytes, np.ndarray]] = []
        tokens = 0
        for batch in batches:
            ids, begin, stops = model.encode(*textkit.flat(batch.column(1)))
            raw = ids.astype("<u4").tobytes()
            cut = np.searchsorted(stops, begin)
            texts = zip(batch.column(0).to_pylist(), begin.tolist(), begin[1:].tolist(), cut.tolist(), cut[1:].tolist(), strict=False)
            for name, a, b, i, j in texts:
                n = b - a + 1
                own = stops[i:j] - a
                # the end token stands with the last sentence
                own = own[(own > 0) & (own < n - 1)]
                inner = own[np.concatenate((own[1:] > own[:-1], [True]))] if len(own) else own
                held.append((name, raw[4 * a : 4 * b] + last, np.concatenate(([0], inner, [n]))))
                tokens += n
                if tokens >= stretch:
                    out, sequence = pieces(held, sequence)
                    yield out
                    held, tokens = [], 0
        if held:
            yield pieces(held, sequence)[0]

    made = rows.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return made.withColumnRenamed("id", key)
