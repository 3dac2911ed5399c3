"""Language of a text by nearest centroid: TF-IDF vectors of hashed byte n-grams, several centroids per language.

Document frequencies come from every training text. Centroids come from a bounded sample of them: at most
`per_language` different texts of a language in expectation and `most` in all, picked by a hash of the text, grouped by
spherical k-means. A text has the language of the centroid with the greatest cosine. Each centroid has a floor for each
class of length, and a text below it is rejected: `slack` times the `low` quantile of the cosines that the sample's texts
of this centroid have, whole and cut to lengths of the class. A class with fewer than FEW of them has the floor of all
centroids of the language, and if these have too few as well, that of the next shorter class; the shortest then has none.
A few short, noisy or mislabelled texts thus move no floor.

Null texts and texts without a letter are `und`, with score 0, and rejected. Rows with a null language are not learned
from. With no training row every text is `und` and rejected. Every row has one result, repeated rows and rows with a null
key too; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit

SIZE = 4096
#: ASCII characters other than letters count as spaces: what a text is about differs less than how it is written.
LETTER = np.arange(256, dtype=np.uint8)
LETTER[[b for b in range(128) if not chr(b).isalpha()]] = 32
UNKNOWN = "und"
#: Classes of length by the number of n-grams: under 32, then doubling; and the lengths to which texts are cut for them.
CLASSES = 9
CUTS = [1 << k for k in range(3, 12)]
#: Cosines that a floor needs.
FEW = 20


def gram_counts(column: pa.Array) -> np.ndarray:
    """How often each hashed 2-, 3- and 4-byte run of the lower-cased text stands in it; a row per text. Runs hold one
    space at most."""
    data, at = textkit.flat(pc.utf8_lower(column))
    data = LETTER[data]
    out = np.zeros((len(at) - 1, SIZE), np.float32)
    for i, j in textkit.steps(at):
        part, rel = data[at[i] : at[j]].astype(np.uint32), at[i : j + 1] - at[i]
        doc = np.repeat(np.arange(j - i), np.diff(rel))
        total = np.zeros((j - i) * SIZE, np.int64)
        code, blank = part, (part == 32).astype(np.int8)
        blanks = blank
        for n in (2, 3, 4):
            if len(part) < n:
                break
            code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
            slot = ((code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(20)).astype(np.int64)
            blanks = blanks[:-1] + blank[n - 1 :]
            inside = (doc[: len(code)] == doc[n - 1 :]) & (blanks < 2)
            total += np.bincount((doc[: len(code)] * SIZE + slot)[inside], minlength=len(total))
        out[i:j] = total.reshape(j - i, SIZE)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(1e-12, np.sqrt((x * x).sum(axis=1, keepdims=True)))


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(1, counts.sum(axis=1))).astype(int) - 4, 0, CLASSES - 1)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each slot stands, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            seen[:SIZE] += (gram_counts(batch.column(0)) > 0).sum(axis=0)
            seen[SIZE] += batch.num_rows
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(seen)], names=["slot", "n"])

    rows = docs.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SIZE + 1 rows
    out = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        out[r["slot"]] = r["n"]
    return out[:SIZE], int(out[SIZE])


def sample(docs: DataFrame, per_language: int, most: int) -> DataFrame:
    """The rows of the sample."""
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row per language
    each = max(1, min(per_language, most // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    drawn = docs.where((F.xxhash64("text").bitwiseAND(0x7FFFFFFF) / float(1 << 31)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    return drawn.distinct()  # copies of a drawn text count once, or one text might be a third of the corpus


def sample_counts(drawn: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Languages and counts of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.astype(np.float32).tobytes() for r in gram_counts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "counts"])

    picked = drawn.mapInArrow(run, "lang string, counts binary").collect()
    # in the order of their bytes, whatever the partitioning
    return [(lang, np.frombuffer(c, np.float32)) for lang, c in sorted((r["lang"], bytes(r["counts"])) for r in picked)]


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at rows spread evenly from the least to the most typical."""
    k = min(k, len(x))
    ranked = np.argsort(x @ x.mean(axis=0), kind="stable")
    centre = x[ranked[((np.arange(k) + 0.5) * len(x) / k).astype(int)]]
    for _ in range(rounds):
        member = np.argmax(x @ centre.T, axis=1)
        total = np.stack([x[member == c].sum(axis=0) if (member == c).any() else centre[c] for c in range(len(centre))])
        centre = total / np.maximum(1e-12, np.linalg.norm(total, axis=1, keepdims=True))
    return centre


def measured(drawn: DataFrame, model: Model) -> list[tuple[int, int, float]]:
    """Centroid, class of length and cosine of the sample's texts, whole and cut, each with the nearest of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.names)
        for batch in batches:
            for cut in [*CUTS, None]:
                some = batch if cut is None else batch.filter(pc.greater(pc.utf8_length(batch.column(1)), cut))
                texts = some.column(1) if cut is None else pc.utf8_slice_codeunits(some.column(1), 0, cut)
                counts = gram_counts(texts)
                cosine = weighted(counts, model.idf) @ model.centres.T
                cosine[np.array(some.column(0).to_pylist(), object)[:, None] != names] = -1
                best = np.argmax(cosine, axis=1)
                good = counts.any(axis=1) & (cosine.max(axis=1) >= 0)
                out = best, length_class(counts), cosine.max(axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in out], names=["centre", "size", "cosine"])

    rows = drawn.mapInArrow(run, "centre long, size long, cosine double").collect()  # the sample's size times the cuts
    return [(r["centre"], r["size"], r["cosine"]) for r in rows]


def floors_of(names: list[str], seen: list[tuple[int, int, float]], slack: float, low: float) -> np.ndarray:
    """The floor of each centroid and class of length."""
    centre, size, cosine = (np.array(x) for x in zip(*seen, strict=True)) if seen else (np.zeros(0),) * 3
    out = np.zeros((len(names), CLASSES))
    for c, name in enumerate(names):
        kin = np.isin(centre, [k for k, other in enumerate(names) if other == name])
        for n in range(CLASSES):
            own, all_ = cosine[(centre == c) & (size == n)], cosine[kin & (size == n)]
            some = own if len(own) >= FEW else all_
            out[c, n] = slack * np.quantile(some, low) if len(some) >= FEW else out[c, n - 1] if n else 0.0
    return out


class Model:
    def __init__(self, idf: np.ndarray, names: list[str], centres: np.ndarray, floors: np.ndarray):
        self.idf, self.names, self.centres, self.floors = idf, names, centres, floors

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, list[bool]]:
        """Language, cosine and whether it is rejected, of each text."""
        if not self.names:
            return [UNKNOWN] * len(column), np.zeros(len(column)), [True] * len(column)
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        counts = gram_counts(column)
        cosine = weighted(counts, self.idf) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
        rejected = ~lettered | (score < self.floors[best, length_class(counts)])
        lang = [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return lang, np.where(lettered, score, 0.0), rejected.tolist()


def fit(
    docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", per_language: int = 500, most: int = 4000,
    centroids: int = 4, slack: float = 0.7, low: float = 0.1,
) -> Model:
    """training: which rows may be learned from."""
    textkit.bounded_batches(docs.sparkSession)
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    seen, n = document_frequency(rows.select("text"))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    names: list[str] = []
    centres = []
    drawn = sample(rows, per_language, most) if n else None
    picked = sample_counts(drawn) if n else []
    for name in sorted({l for l, _ in picked}):
        counts = np.stack([c for l, c in picked if l == name])
        counts = counts[counts.any(axis=1)]
        if not len(counts):
            continue
        own = clusters(weighted(counts, idf), centroids)
        names += [name] * len(own)
        centres += list(own)
    model = Model(idf, names, np.array(centres, np.float32), np.zeros((len(names), CLASSES)))
    if names:
        model.floors = floors_of(names, measured(drawn, model), slack, low)
    return model


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (cosine), rejected; one row per row of docs."""
    textkit.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
    return made.withColumnRenamed("id", key)


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose language isn't rejected."""
    textkit.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not r for r in model.predict(batch.column(text))[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
