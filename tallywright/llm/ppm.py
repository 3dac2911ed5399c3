"""Language-model scores by prediction by partial matching over bytes, with a word-count baseline beside it.

The model is a trie of byte contexts up to `order`, counted over all training texts (lower-cased A-Z, one end symbol
per text). Escape estimation is method D (a context that has seen d different symbols in t places leaves d / 2t to the
escape and (2c - 1) / 2t to a symbol seen c times) with symbol exclusion: what a longer context has already offered is
taken out of the shorter one. Every symbol that a longer context has seen, the shorter one has seen too, so the excluded
count is a sum per node that one join of the strings with themselves yields; no text is walked for it.

The trie grows with the corpus, so nobody holds all of it. Texts are dealt into blocks by their key; a block asks for
the longest strings that occur in it, and gets one number back for each. In between, the different strings and the nodes
of the trie meet in buckets by the last symbols of their contexts, which all nodes that a string needs have in common, but
for those of at most two symbols; these are few whatever the corpus holds, and go to every bucket. A block of
`block_bytes` of text has a bounded number of strings. Words of the baseline travel the same way under a 63-bit hash.

Null and empty texts hold the end symbol alone and are scored as that. Rows with a null key are scored, and count as
training rows. Repeated rows count as often as they stand. With no training rows every symbol has the same
probability. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit
from tallywright.session import materialise

#: Symbols: 0 stands before a text, 1 to 256 are bytes, 257 ends a text. Nine bits each.
END = 257
ALPHABET = 257
BITS = 9
#: The end token of the baseline; words have other negative codes.
END_TOKEN = -1
#: The columns of a node.
VALUES = ("cnt", "t", "d", "x")
#: Parts of a bucket's contexts by the third symbol from the end; a power of two.
PARTS = 8
#: Bytes of text whose symbols are held as numbers at once.
STEP_BYTES = 1 << 18


def tag(length: int) -> int:
    return 1 << (BITS * length)


def gram_codes(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the `order` symbols before and of the symbol at each position, text by text, and the texts' offsets."""
    n = np.diff(at)
    size = n + order + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    symbols = np.zeros(begin[-1], np.int64)
    place = np.arange(len(data)) + np.repeat(begin[:-1] + order - at[:-1], n)
    symbols[place] = data.astype(np.int64) + 1
    symbols[begin[1:] - 1] = END
    codes = np.zeros(len(symbols), np.int64)
    for k in range(order + 1):
        codes[k:] += symbols[: len(symbols) - k] << (BITS * k)
    real = np.ones(len(symbols), bool)
    for k in range(order):
        real[begin[:-1] + k] = False
    return codes[real], np.concatenate(([0], np.cumsum(n + 1)))


def word_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A negative code for each word and the text it stands in."""
    first, last, doc = textkit.word_spans(data, at)
    hashes = textkit.span_hashes(data, first, last)
    return (hashes | np.uint64(1 << 63)).astype(np.int64), doc


def different(codes: np.ndarray) -> np.ndarray:
    """The distinct codes in ascending order; sorting numbers costs less than hashing them."""
    codes = np.sort(codes)
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the codes, the distinct ones, and which of them stands at each place of the order."""
    order = np.argsort(codes)
    codes = codes[order]
    new = np.concatenate(([True], codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, bool)
    return order, codes[new], np.cumsum(new) - 1


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in ascending order, which takes less room in a shuffle, and how often each stands there."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes))) if counts is None else np.add.reduceat(counts, at)


def lowered(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    data, at = textkit.flat(column)
    for i, j in textkit.steps(at, STEP_BYTES):
        yield textkit.LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i], i, j


def corpus_counts(docs: DataFrame, text: str, order: int) -> DataFrame:
    """code, len, cnt: how often each string of at most order + 1 symbols and each word (len 0) stands in docs."""

    def emit(parts: list[tuple[np.ndarray, np.ndarray]], words: bool) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        codes, counts = tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        parts.clear()
        groups = [(0, codes, counts)]
        if not words:
            groups = []
            for k in range(order + 1, 0, -1):
                codes, counts = tally(codes & (tag(k) - 1) | tag(k), counts)
                groups.append((k, codes, counts))
        for k, c, m in groups:
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.full(len(c), k, np.int32)), pa.array(m)], names=["code", "len", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for data, at, _, _ in lowered(batch.column(0)):
                grams.append(tally(gram_codes(data, at, order)[0]))
                words.append(tally(np.concatenate((word_codes(data, at)[0], np.full(len(at) - 1, END_TOKEN)))))
            if sum(len(p[0]) for p in grams + words) > 2_000_000:
                yield from emit(grams, False)
                yield from emit(words, True)
        yield from emit(grams, False)
        yield from emit(words, True)

    made = docs.select(F.col(text).alias("text")).mapInArrow(run, "code long, len int, cnt long")
    return made.groupBy("code", "len").agg(F.sum("cnt").alias("cnt"))


def shorter(code: Column, length: Column) -> Column:
    """The string without its first symbol."""
    return F.expr(f"(code & (shiftleft(1L, {BITS} * (len - 1)) - 1)) | shiftleft(1L, {BITS} * (len - 1))")


def trie(counts: DataFrame, order: int) -> DataFrame:
    """A row per string or word: its count, and as a context, the count of all that follows (t), of the different
    symbols that follow (d), and of these symbols after the next shorter context (x, the part that exclusion takes)."""
    strings = counts.where("len > 0")
    # every string has at most one row per first symbol here, so no key has more than 257 rows
    ends = strings.where(F.col("len") <= order).select(F.col("code").alias("end_code"), F.col("cnt").alias("end_cnt"))
    linked = strings.withColumn("end_code", F.when(F.col("len") > 1, shorter(F.col("code"), F.col("len")))).join(ends, "end_code", "left")
    contexts = linked.groupBy(F.shiftright("code", BITS).alias("code")).agg(
        F.sum("cnt").alias("t"), F.count("*").alias("d"), F.coalesce(F.sum("end_cnt"), F.lit(0)).alias("x")
    )
    zero = [F.lit(0).cast("long").alias(c) for c in ("t", "d", "x")]
    longest = (F.col("len") == 0) | (F.col("len") > order)  # words and the longest strings are no context of anything
    inner = strings.where(~longest).select("code", "cnt", *zero).union(contexts.select("code", F.lit(0).cast("long"), "t", "d", "x"))
    inner = inner.groupBy("code").agg(*(F.sum(c).alias(c) for c in VALUES))
    return counts.where(longest).select("code", "cnt", *zero).union(inner)


def length_of(code: Column, order: int) -> Column:
    """Symbols of a string, from where its tag stands."""
    return sum(((code >= F.lit(tag(k))).cast("int") for k in range(1, order + 2)), F.lit(0))


def small_nodes(nodes: DataFrame) -> pa.Table:
    """The strings of at most two symbols, 66,823 at most whatever the corpus holds: every bucket needs them."""
    return nodes.where((F.col("code") >= 1) & (F.col("code") < tag(3))).toArrow()


def bucket_of(context: Column, buckets: int, third: Column | None = None) -> Column:
    """Bucket of a context by its last two symbols and, in PARTS parts, by the one before them."""
    part = F.shiftright(context, 2 * BITS).bitwiseAND(PARTS - 1) if third is None else third
    return F.pmod(F.xxhash64(context.bitwiseAND((1 << 2 * BITS) - 1), part.cast("long")), F.lit(buckets)).cast("int")


def dealt_nodes(nodes: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, code, cnt, t, d, x): a string of three symbols or more goes, for its count, where its context is asked
    for, and as a context of two or more where it is asked for itself. Those that end before the third symbol from the
    context's end go to all parts."""
    sized = nodes.where(F.col("code") >= tag(2)).withColumn("len", length_of(F.col("code"), order))
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))

    def placed(context: Column, whole: Column) -> Column:
        parts = F.transform(every, lambda p: bucket_of(context, buckets, p))
        return F.array_distinct(F.when(whole, F.array(bucket_of(context, buckets))).otherwise(parts))

    before = F.shiftright("code", BITS)
    zero = [F.lit(0).cast("long").alias(c) for c in ("t", "d", "x")]
    strings = sized.where("len >= 3 and cnt > 0").select(F.explode(placed(before, F.col("len") >= 4)).alias("bucket"), "code", "cnt", *zero)
    contexts = sized.where("len >= 2 and t > 0").select(
        F.explode(placed(F.col("code"), F.col("len") >= 3)).alias("bucket"), "code", F.lit(0).cast("long").alias("cnt"), "t", "d", "x"
    )
    return strings.union(contexts)


class Part:
    """The nodes that the strings of one bucket need: strings with their counts, contexts with t, d and x."""

    def __init__(self, *tables: pa.Table):
        columns = {c: np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("code", *VALUES)}
        self.strings = self.sorted(columns, columns["cnt"] > 0, ("cnt",))
        self.contexts = self.sorted(columns, columns["t"] > 0, ("t", "d", "x"))

    @staticmethod
    def sorted(columns: dict[str, np.ndarray], which: np.ndarray, values: tuple[str, ...]) -> dict[str, np.ndarray]:
        at = np.flatnonzero(which)
        at = at[np.argsort(columns["code"][at])]
        return {c: columns[c][at] for c in ("code", *values)}

    @staticmethod
    def find(table: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each code, and whether it is there."""
        if not len(table["code"]):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        row = np.minimum(np.searchsorted(table["code"], codes), len(table["code"]) - 1)
        return row, table["code"][row] == codes

    def counts(self, codes: np.ndarray) -> np.ndarray:
        """How often the strings were counted; 0 if never."""
        row, known = self.find(self.strings, codes)
        return np.where(known, self.strings["cnt"][row], 0) if len(self.strings["code"]) else np.zeros(len(codes), np.int64)

    def log_prob(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Natural log of the probability of each gram's last symbol after its others."""
        out = np.zeros(len(grams))
        above_d = np.zeros(len(grams), np.int64)  # of the context one symbol longer; 0 until one is known
        above_x = np.zeros(len(grams), np.int64)
        open_ = np.arange(len(grams))  # grams whose symbol no context has offered yet
        for k in range(order, -1, -1):
            g = grams[open_]
            row, known = self.find(self.contexts, (g >> BITS) & (tag(k) - 1) | tag(k))
            t, d, x = (np.where(known, self.contexts[c][row], 0) if len(self.contexts["code"]) else np.zeros(len(g), np.int64) for c in ("t", "d", "x"))
            known &= t > 0
            seen = np.where(known, self.counts(g & (tag(k + 1) - 1) | tag(k + 1)), 0)
            hit = seen > 0
            mass = 2 * (t - above_x[open_])
            escape = d - above_d[open_]
            out[open_[hit]] += np.log((2 * seen[hit] - 1) / mass[hit])
            # where the longer context has offered all there is, the shorter one is left without a cost
            leave = known & ~hit & (mass > 0)
            out[open_[leave]] += np.log(escape[leave] / mass[leave])
            above_d[open_], above_x[open_] = np.where(known, d, 0), np.where(known, x, 0)
            open_ = open_[~hit]
        out[open_] -= np.log(np.maximum(1, ALPHABET - above_d[open_]))
        return out


def scores(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", order: int = 5, block_bytes: int = 16 << 20,
    bucket_bytes: int = 4 << 20,
) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability of each whole text)."""
    if not 1 <= order <= 5:
        raise ValueError("order is 1 to 5: a string and its length have to fit into 63 bits")
    spark = docs.sparkSession
    textkit.bounded_batches(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(True)).alias("train"))
    counts = materialise(corpus_counts(rows.where("train"), "text", order), "counts")
    total = counts.where("code < 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = int(total["n"]), int(total["v"])
    nodes = materialise(trie(counts, order), "trie")
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-amount // block_bytes))  # the size of a block counts, not the number of partitions: each asks anew
    dealt = rows.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    # both readers of what was asked take it from this one shuffle: a code that can't be null needs no filter before the join
    asked = asked_codes(dealt, order).select("block", F.coalesce("code", F.lit(0)).alias("code")).repartition("code")
    values = string_values(asked, nodes, order, max(1, amount // bucket_bytes)).union(nodes.where("code < 0").select("code", F.col("cnt").cast("double").alias("value")))
    parts = asked.join(values, "code").select("block", "code", "value")

    def answer(texts: pa.Table, known_codes: pa.Table) -> pa.Table:
        code, value = known_codes.column("code").to_numpy(), known_codes.column("value").to_numpy()
        at = np.argsort(code)
        code, value = code[at], value[at]
        del at, known_codes
        pa.default_memory_pool().release_unused()

        def of(codes: np.ndarray) -> np.ndarray:
            """The value of each code; 0 of words that no training text has."""
            if not len(code):
                return np.zeros(len(codes))
            row = np.minimum(np.searchsorted(code, codes), len(code) - 1)
            return np.where(code[row] == codes, value[row], 0.0)

        floor = math.log10(0.5 / (n_train + 0.5 * (v_train + 1)))
        n_tokens, n_known, base, score = [], [], [], []
        for data, at, _, _ in lowered(texts.column("text")):
            n = len(at) - 1
            grams, begin = gram_codes(data, at, order)
            places, asked_for, which = grouped(grams)
            logs = np.empty(len(grams))
            logs[places] = of(asked_for | tag(order + 1))[which]
            score.append(np.add.reduceat(logs, begin[:-1]) / math.log(10))
            codes, doc = word_codes(data, at)
            codes, doc = np.concatenate((codes, np.full(n, END_TOKEN))), np.concatenate((doc, np.arange(n)))
            places, asked_for, which = grouped(codes)
            c = of(asked_for)
            known = c > 0
            worth = np.where(known, np.log10((c + 0.5) / (n_train + 0.5 * (v_train + 1))), floor)
            doc = doc[places]
            base.append(np.bincount(doc, weights=worth[which], minlength=n))
            n_tokens.append(np.bincount(doc, minlength=n))
            n_known.append(np.bincount(doc, weights=known[which], minlength=n).astype(np.int64))
        return pa.table({
            "id": texts.column("id"), "n_tokens": pa.array(np.concatenate(n_tokens)), "n_known": pa.array(np.concatenate(n_known)),
            "base_score": pa.array(np.concatenate(base)), "score": pa.array(np.concatenate(score)),
        })

    id_type = rows.schema["id"].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(
        answer, f"id {id_type}, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def asked_codes(dealt: DataFrame, order: int) -> DataFrame:
    """(block, code): the longest strings and the words that occur in a block's texts, each once."""

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts: list[np.ndarray] = [np.array([END_TOKEN])]
        for data, at, _, _ in lowered(table.column("text")):
            parts.append(different(gram_codes(data, at, order)[0]) | tag(order + 1))
            parts.append(different(word_codes(data, at)[0]))
        code = different(np.concatenate(parts))
        parts.clear()
        pa.default_memory_pool().release_unused()
        return pa.table({"block": pa.array(np.full(len(code), block, np.int32)), "code": pa.array(code)})

    return dealt.groupBy("block").applyInArrow(ask, "block int, code long")


def string_values(asked: DataFrame, nodes: DataFrame, order: int, buckets: int) -> DataFrame:
    """(code, value): the natural log of the probability of each asked string's last symbol after its others.

    A string needs the nodes of all lengths that end like its context, so strings and nodes are dealt by the context's
    last symbols. Different blocks ask for the same strings; each is answered once.
    """
    buckets = max(buckets, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # conditions on aggregates of both columns: neither a filter nor a projection is pushed below the shuffle that the other reader shares
    strings = asked.groupBy("code").agg(F.min("block").alias("block"), F.max("code").alias("top")).where("top >= 0 and block >= 0")
    small = small_nodes(nodes)
    longest = tag(order + 1)

    def solve(strings: pa.Table, near: pa.Table) -> pa.Table:
        code = strings.column("code").to_numpy()
        value = Part(small, near).log_prob(code & (longest - 1), order)
        return pa.table({"code": pa.array(code), "value": pa.array(value)})

    grams = strings.select(bucket_of(F.shiftright(F.col("code").bitwiseAND(longest - 1), BITS), buckets).alias("bucket"), "code")
    return grams.groupBy("bucket").cogroup(dealt_nodes(nodes, order, buckets).groupBy("bucket")).applyInArrow(solve, "code long, value double")
