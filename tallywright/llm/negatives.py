"""Hard negatives by exact integer inner products, many candidates in one multiplication.

Components become whole numbers (floor of `scale` times each). For one component, the biased values of all candidates of a
block are laid side by side as the fields of one wide integer (Kronecker's substitution). An anchor's component times that
integer multiplies every field at once; the products of all components add up to one integer whose fields are the biased
scores. A start value lifts every field above zero, so that negative factors borrow nothing from the next field, and the
field is as wide as the block's greatest possible sum asks. Scores are therefore exact, for any number of bits.

Two passes go over all pairs of an anchor and a row, in blocks. The first keeps each anchor's best rows of its own label;
these fix the window for the second, which keeps, for each of them, the best rows of other labels within it. Rows stand in
blocks of `rows`; blocks are dealt to lanes, and every group of anchors goes to all lanes by an equi join on the lane, so
that a task reads its lane's blocks for one group of anchors after another and sends on at most a few rows per anchor.

Rows with a null key, label or vector, or with a component that is null, not finite, or beyond 2**24 after scaling, take no
part. Of rows with one key, the one with the least label and then the least vector counts. Vectors of different lengths
aren't compared; empty ones all score 0. Ties go to the smaller key. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import textkit
from tallywright.session import materialise

LIMIT = 1 << 24
#: Fills up the scores of an anchor with fewer positives.
NONE = -(1 << 63)
#: Candidates in a block, anchors in a group, and how many lanes a shuffle partition has.
ROWS, ANCHORS, LANES = 2048, 512, 2


class Packed:
    """A block of candidates as one wide integer per component."""

    def __init__(self, vectors: np.ndarray):
        self.n, self.dims = vectors.shape
        self.bias = -int(vectors.min(initial=0))
        self.fields = vectors + self.bias
        self.most = int(self.fields.max(initial=0))
        self.width = 0
        self.wide: list[int] = []

    def widen(self, bits: int) -> None:
        """Fields of so many bits at least, in whole bytes."""
        width = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        if width <= self.width:
            return
        self.width = width
        if width <= 8:
            rows = np.ascontiguousarray(self.fields.T.astype(f"<u{width}"))
            self.wide = [int.from_bytes(r.tobytes(), "little") for r in rows]
            self.ones = int.from_bytes(np.ones(self.n, f"<u{width}").tobytes(), "little")
        else:
            self.wide = [int.from_bytes(b"".join(int(v).to_bytes(width, "little") for v in r), "little") for r in self.fields.T]
            self.ones = int.from_bytes(b"\1".ljust(width, b"\0") * self.n, "little")

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of one anchor with all candidates."""
        parts = anchor.tolist()
        lift = sum(map(abs, parts)) * self.most  # no field falls below zero
        self.widen((2 * lift).bit_length())
        total = lift * self.ones
        for a, fields in zip(parts, self.wide, strict=True):
            if a:
                total += a * fields
        raw = total.to_bytes(self.n * self.width, "little")
        back = lift + self.bias * sum(parts)
        if self.width <= 8:
            return np.frombuffer(raw, f"<u{self.width}").astype(np.int64) - back
        return np.array([int.from_bytes(raw[k : k + self.width], "little") - back for k in range(0, len(raw), self.width)], np.int64)


def eligible(vectors: DataFrame, key: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(key, label, parts): the rows that take part, one per key."""
    parts = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LIMIT))
    sound = vectors.where(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & fit)
    rows = sound.select(F.col(key).cast("long").alias("key"), F.struct(label.cast("long").alias("label"), parts.alias("parts")).alias("row"))
    one = rows.groupBy("key").agg(F.min("row").alias("row"))
    return one.select("key", "row.label", F.transform("row.parts", lambda x: x.cast("int")).alias("parts"))


BLOCK = {"lane": pa.int32(), "dims": pa.int32(), "block": pa.int64(), "keys": pa.binary(), "labels": pa.binary(), "parts": pa.binary(), "bars": pa.binary()}
BLOCK_DDL = "lane int, dims int, block long, keys binary, labels binary, parts binary, bars binary"
FOUND = {"anchor": pa.int64(), "slot": pa.int32(), "score": pa.int64(), "key": pa.int64()}


def rows_of(lists: pa.ListArray, kind: str, of: np.ndarray, width: int) -> np.ndarray:
    """The lists at these places, all of one length, as a matrix."""
    if not width:
        return np.zeros((len(of), 0), kind)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    return flat[begins[of][:, None] + np.arange(width)]


def blocked(rows: DataFrame, size: int, lanes: int) -> DataFrame:
    """(key, label, parts, bars) of one length of parts packed by `size` as bytes of numbers, dealt to lanes in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        part = TaskContext.get().partitionId()
        made = 0

        def out(dims: int, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            whole = [np.concatenate(c) for c in zip(*held[dims], strict=True)]
            at, n = 0, len(whole[0])
            while n - at >= size or (last and at < n):
                row = [(part + made) % lanes, dims, (part << 32) + made, *[c[at : at + size].tobytes() for c in whole]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK.values(), strict=True)], names=list(BLOCK))
                made += 1
                at += size
            held[dims] = [[c[at:] for c in whole]]

        for batch in batches:
            parts, bars = batch.column(2), batch.column(3)
            sizes = np.diff(parts.offsets.to_numpy())
            width = len(bars[0]) if len(bars) else 0
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                keys, labels = (batch.column(c).to_numpy().astype("<i8")[own] for c in (0, 1))
                held.setdefault(dims, []).append([keys, labels, rows_of(parts, "<i4", own, dims), rows_of(bars, "<i8", own, width)])
                if sum(len(h[0]) for h in held[dims]) >= size:
                    yield from out(dims, False)
        for dims in list(held):
            yield from out(dims, True)

    return rows.select("key", "label", "parts", "bars").mapInArrow(run, BLOCK_DDL)


def meet(blocks: DataFrame, anchors: DataFrame, lanes: int) -> DataFrame:
    """Every group of anchors beside every block of vectors of its length, lane by lane."""
    groups = anchors.select("dims", F.struct("block", "keys", "labels", "parts", "bars").alias("anchors"))
    everywhere = groups.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # the number of partitions is named, since little data is much work here
    left = everywhere.repartition(lanes, "lane", "dims")
    right = blocks.select("lane", "dims", F.struct("keys", "labels", "parts").alias("rows")).repartition(lanes, "lane", "dims")
    return left.join(right.hint("merge"), ["lane", "dims"]).select("anchors", "rows")


def first_of(score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by descending score and ascending key."""
    if len(score) > 4 * k:  # those that can't be among the first are left out before sorting
        bar = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= bar)
        return near[np.lexsort((key[near], -score[near]))[:k]]
    return np.lexsort((key, -score))[:k]


class Group:
    """Anchors of one block."""

    def __init__(self, raw: dict):
        self.keys, self.labels = (np.frombuffer(raw[c], "<i8") for c in ("keys", "labels"))
        self.parts = np.frombuffer(raw["parts"], "<i4").astype(np.int64).reshape(len(self.keys), -1)
        self.bars = [[b for b in row if b != NONE] for row in np.frombuffer(raw["bars"], "<i8").reshape(len(self.keys), -1).tolist()]


Pick = Callable[[int, Group, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]


def own_label(a: int, group: Group, score: np.ndarray, labels: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, np.flatnonzero((labels == group.labels[a]) & (keys != group.keys[a]))


def windows(low: int) -> Pick:
    def pick(a: int, group: Group, score: np.ndarray, labels: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        bars = group.bars[a]
        if not bars:
            return
        least = [-(-low * bar // 100) for bar in bars]  # above the bar if that is negative: then nothing is in the window
        able = np.flatnonzero((score <= max(bars)) & (score >= min(least)) & (labels != group.labels[a]))
        near = score[able]
        for slot, (bar, lo) in enumerate(zip(bars, least, strict=True)):
            yield slot, able[(near <= bar) & (near >= lo)]

    return pick


def passed(met: DataFrame, pick: Pick, k: int) -> DataFrame:
    """(anchor, slot, score, key): the first k of the rows that `pick` finds for each slot of an anchor, over the blocks
    of a lane. They are sent on when the next group of anchors begins, so a task holds those of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        running, group = None, None

        def send() -> Iterator[pa.RecordBatch]:
            if best:
                counts = [len(keys) for _, keys in best.values()]
                names = np.repeat(np.array(list(best), np.int64).reshape(-1, 2), counts, axis=0)
                columns = [names[:, 0], names[:, 1], np.concatenate([s for s, _ in best.values()]), np.concatenate([n for _, n in best.values()])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND.values(), strict=True)], names=list(FOUND))
                best.clear()

        for batch in batches:
            for pair in batch.to_pylist():
                if pair["anchors"]["block"] != running:
                    yield from send()
                    running, group = pair["anchors"]["block"], Group(pair["anchors"])
                keys, labels = (np.frombuffer(pair["rows"][c], "<i8") for c in ("keys", "labels"))
                packed = Packed(np.frombuffer(pair["rows"]["parts"], "<i4").astype(np.int64).reshape(len(keys), -1))
                for a, name in enumerate(group.keys.tolist()):
                    scores = packed.scores(group.parts[a])
                    for slot, own in pick(a, group, scores, labels, keys):
                        if not len(own):
                            continue
                        score, key = scores[own], keys[own]
                        if (name, slot) in best:
                            score, key = (np.concatenate(c) for c in zip(best[name, slot], (score, key), strict=True))
                        chosen = first_of(score, key, k)
                        best[name, slot] = score[chosen], key[chosen]
        yield from send()

    return met.mapInArrow(run, "anchor long, slot int, score long, key long")


def top(found: DataFrame, k: int) -> DataFrame:
    """The first k per anchor and slot over all lanes, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", label: Column | None = None, vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 5, low: int = 80, rows: int = ROWS, group: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors: which keys are anchors, a condition on column `key`. An anchor's positives are its first rows of the same
    label; each positive's negatives are the first rows of other labels that score at least `low` hundredths of it and no
    more than it.
    """
    spark = vectors.sparkSession
    textkit.bounded_batches(spark)
    lanes = LANES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = materialise(eligible(vectors, key, F.col("label") if label is None else label, vector, scale), "vectors")
    none = F.array().cast("array<long>").alias("bars")
    blocks = materialise(blocked(fit.select("*", none), rows, lanes), "blocks")
    chosen = materialise(fit.withColumnRenamed("key", key).where(anchors).withColumnRenamed(key, "key"), "anchors")
    first = materialise(top(passed(meet(blocks, blocked(chosen.select("*", none), group, lanes), lanes), own_label, positives), positives), "positives")
    scores = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])  # a few per anchor
    filled = F.concat(scores, F.array_repeat(F.lit(NONE).cast("long"), F.lit(positives) - F.size(scores)))
    barred = chosen.join(first.groupBy(F.col("anchor").alias("key")).agg(filled.alias("bars")), "key")
    found = top(passed(meet(blocks, blocked(barred, group, lanes), lanes), windows(low), negatives), negatives)
    own = first.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(own, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
