"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests doesn't tell from random ones.

Candidates are long runs of encoding characters, also right after a sign of equality. An encoding is inferred (hex, base
32, base 36 in either case, base 64, one case with hyphens and underscores); letters or digits alone have none. Of a run
without an encoding, as a path that ends in a key, the parts between separators are tested. Under the hypothesis that a string is random in its encoding, three tests
give p-values: chi-squared uniformity over the alphabet, the number of runs above and below its middle, and the
correlation of neighbours; Fisher's rule combines them. Ordinary text gathers at p near 0 and random strings are spread
evenly, so the share of random strings above any p is known from the upper half of the p-values. For each encoding and
length class the bar is the lowest p above which at most `rate` of the strings are expected to be ordinary: long strings,
which the tests tell apart well, have a low bar, short ones a high bar. The p-values of all documents count for this,
each different string once, however many copies it has; the driver sees one histogram per class, whose size is fixed.

A class with fewer than `ENOUGH` different strings takes in the next shorter and longer classes of its encoding, step by
step, until they have as many; if the whole encoding hasn't, it takes in all strings of the table. If these are too few
as well, there is nothing to estimate from, and each string is tested alone: the bar is `rate`, which a random string
misses with that probability.

Null and empty texts have no spans. Spans are in code points, end exclusive. A span found by the tests is left out where
a pattern's span already covers part of it. Every row has one result, repeated rows and rows with a null key too. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit
from tallywright.session import materialise

# The patterns of the task, with the least length of what they have to match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

LEAST = 20
#: A sign of equality ends a run as padding, or else stands between a name and the next run.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Parts of a run, from coarse to fine, that are tried if the whole has no encoding.
PARTS = tuple(re.compile(p) for p in ("[^/]+", "[^_-]+", "[^/_-]+", "[^+/_-]+"))
#: Alphabets in the order of their values; the first that holds all characters is inferred. Those with separators have no
#: such order: their letters stand by frequency, so that words joined by hyphens are far from uniform.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "BASE36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base38": "etaoinsrhldcumfpgwybvkxjqz0123456789-_",
    "BASE38": "ETAOINSRHLDCUMFPGWYBVKXJQZ0123456789-_",
}
VALUES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
LENGTHS = (20, 32, 48, 64, 128)
BINS = 100
#: Different strings that an estimate needs.
ENOUGH = 100
SPAN = "struct<kind:string,start:int,end:int>"


def encoding(run: str) -> str | None:
    """The inferred encoding of a run of characters; None for words, numbers and identifiers of one kind of letter."""
    body = run.rstrip("=")
    if not any(c.isdigit() for c in body) or not any(c.isalpha() for c in body):
        return None
    for name, values in VALUES.items():
        if all(c in values for c in body):
            mixed = any(c.islower() for c in body) and any(c.isupper() for c in body)
            if mixed or not name.startswith("base64"):
                return name
    return None


def tested(run: str) -> list[tuple[int, int, str]]:
    """Start, end and encoding of what is tested of a run: the whole, or else its longest parts that have an encoding."""
    if name := encoding(run):
        return [(0, len(run), name)]
    parts = {m.span() for cut in PARTS for m in cut.finditer(run) if len(m[0].rstrip("=")) >= LEAST}
    covered, out = bytearray(len(run)), []
    for a, b in sorted(parts, key=lambda s: (s[0] - s[1], s[0])):
        if covered.find(1, a, b) < 0 and (name := encoding(run[a:b])):
            covered[a:b] = b"\1" * (b - a)
            out.append((a, b, name))
    return sorted(out)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: np.ndarray, size: int) -> float:
    """p of Pearson's chi-squared, over as many equal cells as give each about five values (two at least)."""
    cells = max(2, min(size, len(values) // 5))
    share = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    seen = np.bincount(values * cells // size, minlength=cells)
    wanted = share * len(values)
    x, df = float(((seen - wanted) ** 2 / wanted).sum()), cells - 1
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson and Hilferty
    return max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))


def runs(values: np.ndarray, size: int) -> float:
    """p of the number of runs of values in the lower and the upper half of the alphabet."""
    high = values >= size // 2
    n, up = len(values), int(high.sum())
    down = n - up
    if not up or not down:
        return max(1e-12, 2.0 ** (1 - n))
    seen = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * up * down / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    return max(1e-12, normal_tail((seen - mean) / spread))


def serial(values: np.ndarray) -> float:
    """p of the correlation of each value with the next."""
    x = values - values.mean()
    power = float((x * x).sum())
    if power == 0:
        return 1e-12
    return max(1e-12, normal_tail(float((x[1:] * x[:-1]).sum()) / power * math.sqrt(len(values))))


def random_p(run: str, name: str) -> float:
    """Fisher's combination of the three tests: small if the string is unlike a random one."""
    body = run.rstrip("=")
    values = np.array([VALUES[name][c] for c in body])
    size = len(ALPHABETS[name])
    half = -sum(map(math.log, (uniformity(values, size), runs(values, size), serial(values))))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def stratum(name: str, length: int) -> str:
    return f"{name}:{max(n for n in LENGTHS if n <= max(length, LENGTHS[0]))}"


def signature(string: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(string.encode()) - (1 << 63)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """Start, end, stratum and p of the runs that no pattern has found; taken: the patterns' spans, by their starts."""
    out = []
    starts, upto = [s for s, _, _ in taken], list(accumulate((e for _, e, _ in taken), max))
    for m in CANDIDATE.finditer(text):
        for i, j, name in tested(m[0]):
            a, b = m.start() + i, m.start() + j
            before = bisect_left(starts, b)  # of those that begin before b, does one end after a?
            if not before or upto[before - 1] <= a:
                out.append((a, b, stratum(name, b - a), random_p(text[a:b], name)))
    return out


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, found: spans of the patterns; tried: candidates with stratum, p and hash."""
    textkit.bounded_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    tried_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("p", pa.float64()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, tried = [], []
            for t in batch.column(1).to_pylist():
                spans = pattern_spans(t or "")
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                tried.append([{"start": a, "end": b, "stratum": s, "p": p, "hash": signature(t[a:b])} for a, b, s, p in candidates(t or "", spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span), pa.array(tried, tried_type)], names=["id", "found", "tried"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        run, f"id {rows.schema['id'].dataType.simpleString()}, found array<{SPAN}>, tried array<struct<start:int,end:int,stratum:string,p:double,hash:long>>"
    )


def pooled(counts: dict[str, np.ndarray], name: str) -> np.ndarray:
    """The histogram that the bar of a stratum comes from: its own, or with its neighbours if it has too few strings."""
    code, length = name.split(":")
    at = LENGTHS.index(int(length))
    for reach in range(len(LENGTHS)):
        near = LENGTHS[max(0, at - reach) : at + reach + 1]
        seen = sum(counts[n] for n in (f"{code}:{k}" for k in near) if n in counts)
        if seen.sum() >= ENOUGH:
            return seen
    return sum(counts.values())


def bars(scanned: DataFrame, rate: float) -> dict[str, float]:
    """The lowest p of each stratum above which at most `rate` of the different strings are expected to be ordinary."""
    tried = scanned.select(F.explode("tried").alias("t")).select("t.stratum", "t.hash", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict[str, np.ndarray] = {}
    for row in tried.distinct().groupBy("stratum", "bin").count().collect():  # strata times bins rows at most
        counts.setdefault(row["stratum"], np.zeros(BINS, np.int64))[row["bin"]] = row["count"]
    out = {}
    for name in counts:
        seen = pooled(counts, name)
        if seen.sum() < ENOUGH:
            out[name] = rate
            continue
        above = seen[::-1].cumsum()[::-1]
        random = 2.0 * above[BINS // 2]  # strings that are random, of which half have p above one half
        false = np.maximum(0.0, above - random * (1 - np.arange(BINS) / BINS))
        # a bin of many p-values near 0 must not be let in by an estimate that few strings have made
        good = np.flatnonzero((false <= rate * above) & (above > 0))
        out[name] = max(0.01, int(good[0]) / BINS) if len(good) else 1.0
    return out


def verdict(found: Column, tried: Column, limits: dict[str, float]) -> Column:
    """All spans in the order of their starts."""
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.lit(None).cast("map<string,double>")
    kept = F.filter(tried, lambda t: t["p"] >= F.coalesce(F.element_at(limit, t["stratum"]), F.lit(2.0)))
    added = F.transform(kept, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    rank = F.transform(
        F.concat(found, added),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "random"))), s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.transform(F.array_sort(rank), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.05) -> DataFrame:
    """key, spans array<struct<kind, start, end>> of every row."""
    scanned = materialise(scan(docs, key, text), "scanned")
    limits = bars(scanned, rate)
    return scanned.select(F.col("id").alias(key), verdict(F.col("found"), F.col("tried"), limits).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.05) -> DataFrame:
    """docs with every span replaced by its kind in brackets. The texts are read twice rather than shuffled to meet
    their spans: once for the bars, once to be changed."""
    limits = bars(scan(docs, key, text).select("tried"), rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.release()
        for batch in batches:
            out = []
            for t in batch.column(text).to_pylist():
                if t:
                    spans = pattern_spans(t)
                    spans += [(a, b, "random") for a, b, s, p in candidates(t, spans) if p >= limits.get(s, 2.0)]
                    parts, at = [], 0
                    for a, b, kind in sorted(spans):
                        if b > at:
                            parts += [t[at : max(a, at)], f"[{kind}]"] if a >= at else []
                            at = b
                    t = "".join(parts) + t[at:] if spans else t
                out.append(t)
            place = batch.schema.get_field_index(text)
            yield batch.set_column(place, text, pa.array(out, batch.schema.field(text).type))

    return docs.mapInArrow(run, docs.schema)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
