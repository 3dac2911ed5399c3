"""Document fingerprints: digests of the quartiles of hashed byte triplets.

Every window of five bytes gives six triplets that hold its last byte; each is hashed into one of 256 buckets. A
bucket's digit is the quartile its count falls in. The digest is a length code, the two quartile ratios and the 256
digits of two bits, in hexadecimal. The difference of two digests is the sum of the digits' differences (where digits
are two or more apart, three for each further one), of the codes' and of the ratios', none of which can exceed a bound;
likeness is 1 less the share of the greatest possible difference.

`with_next` pairs each document with its successor in descending order of the key, a number or a text. The order is cut
into ranges at boundaries drawn from the rows themselves, a few for each range, so that ranges are even; a row finds its
range by a search in two steps. Each range is sorted in one task and also gets the document that follows its last, so one
shuffle of texts is enough and no range has to see another. Rows with equal keys follow one another in the order of a hash
of their texts, by which ranges cut them too. What is held as a whole is a boundary and a head per range.

Null texts are empty. Texts with fewer than five bytes have no triplets and a digest of zeros. Rows with a null key come
after all others. An empty table gives an empty result; a single document follows itself. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywright.llm import textkit
from tallywright.operators.ranking import range_bucket

BUCKETS = 256
#: Offsets, from a window's last byte, of the other two bytes of each triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: Greatest length code, and its weight at a difference of one.
LENGTHS, LENGTH_BOUND, RATIO_BOUND = 255, 12, 12
MOST = BUCKETS * 6 + LENGTH_BOUND + 2 * RATIO_BOUND
#: Boundaries drawn for each range; the ranges' sizes spread by about one part in the square root of it.
DRAWS = 8


def bucket_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    if len(data) < 5:
        return out.reshape(n, BUCKETS)
    doc = np.repeat(np.arange(n), np.diff(at))
    inside = np.flatnonzero(doc[4:] == doc[:-4])
    x = data.astype(np.uint32)
    row = (doc[4:] * BUCKETS)[inside]
    for salt, (a, b) in enumerate(TRIPLETS):
        code = x[4:] << np.uint32(16) | x[4 - a : len(x) - a] << np.uint32(8) | x[4 - b : len(x) - b]
        code = (code + np.uint32(salt << 24)) * np.uint32(2654435761)
        slot = ((code ^ (code >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64)
        out += np.bincount(row + slot[inside], minlength=len(out))
    return out.reshape(n, BUCKETS)


def digests(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per text: length code, two ratio codes and the digits of the buckets."""
    counts = bucket_counts(data, at)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, k * BUCKETS // 4 - 1][:, None] for k in (1, 2, 3))
    digits = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    size = np.diff(at)
    length = np.minimum(LENGTHS, np.round(8 * np.log2(1 + size))).astype(np.uint8)
    low = np.where(q3 > 0, 15 * q1 // np.maximum(1, q3), 0).astype(np.uint8)
    middle = np.where(q3 > 0, 15 * q2 // np.maximum(1, q3), 0).astype(np.uint8)
    return np.concatenate((length[:, None], low, middle, digits.astype(np.uint8)), axis=1)


def written(digest: np.ndarray) -> list[str]:
    """Digests as text: two digits of length, one of each ratio, and two bits a bucket."""
    body = digest[:, 3:].reshape(len(digest), -1, 4)
    packed = body[:, :, 0] << 6 | body[:, :, 1] << 4 | body[:, :, 2] << 2 | body[:, :, 3]
    return [f"{h[0]:02x}{h[1]:x}{h[2]:x}{p.tobytes().hex()}" for h, p in zip(digest.tolist(), packed, strict=True)]


def read(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)
    body = np.stack([packed >> 6 & 3, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()
    return np.concatenate(([int(fingerprint[:2], 16), int(fingerprint[2], 16), int(fingerprint[3], 16)], body)).astype(np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 less the bounded difference of digests, row by row."""
    gap = np.abs(x.astype(np.int32) - y)
    digits = np.array([0, 1, 3, 6])[gap[:, 3:]].sum(axis=1)
    length = np.minimum(LENGTH_BOUND, gap[:, 0] // 2)
    ratios = np.minimum(RATIO_BOUND, gap[:, 1:3]).sum(axis=1)
    return 1 - (digits + length + ratios) / MOST


def flat_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of every row."""
    textkit.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = textkit.flat(batch.column(1))
            out = []
            for i, j in textkit.steps(at):
                out += written(digests(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", key)


def with_next(docs: DataFrame, key: str, text: str, range_bytes: int) -> DataFrame:
    """id, text, range, guest: rows in ranges of descending key, each range with the row after its last as a guest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // range_bytes))
    side = math.isqrt(DRAWS * parts - 1) + 1
    placed = range_bucket(rows, ["id", "tie"], side * side, "bucket").withColumn("range", F.expr(f"int(bucket * {parts} div {side * side})")).drop("bucket")
    # the head of each range is the guest of the range before it in this order; that of the first is the guest of the last
    heads = placed.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head"))  # a row per range
    seat = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy()))
    seats = heads.select(seat.alias("seat"), F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"))
    met = placed.join(F.broadcast(seats), F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    guest = met.groupBy("seat").agg(F.max(F.struct("id", "tie", "text")).alias("g"))  # repeated rows are one guest
    both = placed.select("id", "tie", "text", "range", F.lit(0).alias("guest")).union(guest.select("g.id", "g.tie", "g.text", "seat", F.lit(1)))
    dealt = both.repartitionById(parts, F.col("range"))
    return dealt.sortWithinPartitions("range", "guest", F.col("id").desc_nulls_last(), F.desc("tie"), F.desc("text")).drop("tie")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = 128 << 20) -> DataFrame:
    """For every row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The edited
    text has the start of the next document in place of its last third."""
    textkit.bounded_batches(docs.sparkSession)
    names = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    id_type = docs.schema[key].dataType
    types = (to_arrow_type(id_type), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    Row = tuple[int, str, int, int]

    def compared(pairs: list[tuple[Row, Row]]) -> pa.RecordBatch:
        own = [x[1] for x, _ in pairs]
        edited = [t[: len(t) - len(t) // 3] + y[1][: len(t) // 3] for t, (_, y) in zip(own, pairs, strict=True)]
        raw = [t.encode("utf-8", "replace") for t in edited]
        a, b = digests(*flat_texts([t.encode("utf-8", "replace") for t in own])), digests(*flat_texts(raw))
        # a row's successor is mostly the next row here
        follows = [k for k in range(len(pairs) - 1) if pairs[k][1] is pairs[k + 1][0]]
        rest = sorted(set(range(len(pairs))).difference(follows))
        c = np.empty_like(a)
        c[follows] = a[np.array(follows, int) + 1]
        c[rest] = digests(*flat_texts([pairs[k][1][1].encode("utf-8", "replace") for k in rest]))
        columns = ([x[0] for x, _ in pairs], [len(t) for t in own], [hashlib.sha256(t).hexdigest() for t in raw], written(a), written(b), likeness(a, b), likeness(a, c))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Row | None = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            chain = [last, *rows] if last is not None else rows
            last = chain[-1]
            pairs = [(x, y if y[2] == x[2] else x) for x, y in zip(chain, chain[1:]) if not x[3]]
            size, held = 0, []
            for pair in pairs:
                held.append(pair)
                size += len(pair[0][1])
                if size >= textkit.STEP_BYTES:
                    yield compared(held)
                    size, held = 0, []
            if held:
                yield compared(held)
        if last is not None and not last[3]:
            yield compared([(last, last)])

    made = with_next(docs, key, text, range_bytes).mapInArrow(
        run, f"id {id_type.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return made.withColumnRenamed("id", key)
