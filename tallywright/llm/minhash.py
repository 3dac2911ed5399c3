"""Near-duplicate groups: b-bit MinHash with band candidates, corrected estimates and exact confirmation.

Texts become sets of word shingles (64-bit hashes of the lower-cased words). Equal sets are folded to one
representative first, so copies never meet each other. A representative has `bands * rows` minima: each band of `rows`
minima is a bucket key, and the lowest `bits` bits of every minimum make a packed signature.

Buckets are never expanded into pairs. First every member of a bucket is compared with the bucket's least key; the
confirmed links make components, and a bucket whose members are one component is done. In the others, the members
outside the bucket's largest component are compared with it and with one another in tiles: both sides are dealt into
chunks of about `TILE` documents, two chunks meet in one task, and only links that join components leave it. So a bucket
costs rows by its members times the chunks of its odd ones, not by its pairs, and no task has more than two chunks. A
pair is first estimated from the packed signatures (corrected for chance agreement of the low bits) and dropped when the
estimate is `slack` below the threshold; the rest is decided on the full sets. Nothing is capped: every two members of a
bucket are in one component or have been compared in the end.

With 32 bands of 4 minima a pair at similarity 0.8 shares no bucket with probability 5e-8.

Null, empty and blank texts have an empty set and are linked with nothing. A text with fewer words than a shingle is
one shingle of its own. Repeated rows are copies like any other; the
key is expected to name one text. A null key is its own group and kept. An empty table gives an empty result. Columns other
than the key and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import textkit
from tallywright.session import materialise

#: Documents in a chunk of a bucket's members.
TILE = 256
#: Columns of a tile's matrix that are held at once.
COLUMNS = 8192


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = textkit.flat(column)
    for i, j in textkit.steps(at):
        part, rel = textkit.LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]
        first, last, doc = textkit.word_spans(part, rel)
        hashes = textkit.span_hashes(part, first, last)
        edges = np.searchsorted(doc, np.arange(j - i + 1))
        joined = hashes.copy()
        for k in range(1, words):
            joined = textkit.mix(joined[:-1] * np.uint64(textkit.BASE) + hashes[k:]) if len(joined) > 1 else joined[:0]
        for d in range(j - i):
            a, b = edges[d], edges[d + 1]
            if b - a >= words:
                yield np.unique(joined[a : b - words + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    whole = textkit.mix(whole * np.uint64(textkit.BASE) + h + np.uint64(1))
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, in steps that stay in the processor's cache."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 512):
        np.minimum(least, (values[k : k + 512, None] * a + b).min(axis=0), out=least)
    return least


def pack(least: np.ndarray, bits: int) -> bytes:
    """The low bits of the mixed minima (products mod 2^64 have weak low bits), packed."""
    low = (textkit.mix(least) & np.uint64((1 << bits) - 1)).astype(np.uint16)
    return np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint16)) & 1).astype(np.uint8)).tobytes()


def estimate(x: bytes, y: bytes, bits: int) -> float:
    """Similarity from two packed signatures: share of equal b-bit fields, corrected for fields equal by chance."""
    differ = np.unpackbits(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).reshape(-1, bits).any(axis=1)
    chance = 0.5**bits
    return float((1 - differ.mean() - chance) / (1 - chance))


def signatures(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int, bits: int) -> DataFrame:
    """id, n, d1, d2 (digest of the set), sig (packed bits), bands (bucket keys); one row per document."""
    a, b = seeds(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, sig, keys = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(textkit.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                if len(s):
                    least = minima(s, a, b)
                    grid = least.reshape(bands, rows)
                    bucket = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        bucket = textkit.mix(bucket * np.uint64(textkit.BASE) + grid[:, r])
                    sig.append(pack(least, bits))
                    keys.append(bucket.astype(np.int64).tolist())
                else:
                    sig.append(b"")
                    keys.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "d1", "d2", "sig", "bands"],
            )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n long, d1 long, d2 long, sig binary, bands array<long>"
    )


def stored_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id, grams (sorted shingle hashes as bytes) of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [s.tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["id", "grams"])

    chosen = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    return chosen.mapInArrow(run, "id long, grams binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, bits: int, percent: int, slack: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; the signatures sort out hopeless ones before."""
    floor = percent / 100 - slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sx, gx, sy, gy in zip(*(batch.column(c).to_pylist() for c in ("sx", "gx", "sy", "gy")), strict=True):
                small, large = sorted((len(gx), len(gy)))
                if 100 * small < percent * large or estimate(sx, sy, bits) < floor:
                    keep.append(False)
                    continue
                both = np.concatenate((np.frombuffer(gx, np.uint64), np.frombuffer(gy, np.uint64)))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("sig").alias("sx"), F.col("grams").alias("gx"))
    y = sets.select(F.col("id").alias("b"), F.col("sig").alias("sy"), F.col("grams").alias("gy"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sx", "gx", "sy", "gy").mapInArrow(run, "a long, b long")


def contract(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (id, comp) after merging the components that links (a, b between comps) connect; labels are least ids."""
    edges = materialise(links.distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("from"), F.least("a", "to").alias("to"))
        jump = materialise(
            up.join(up.select(F.col("from").alias("to"), F.col("to").alias("next")), "to", "left").select("from", F.coalesce("next", "to").alias("to")), "hops"
        )
        comps = materialise(
            comps.join(jump, F.col("comp") == F.col("from"), "left").select("id", F.coalesce("to", "comp").alias("comp")), "components"
        )
        a = jump.select(F.col("from").alias("a"), F.col("to").alias("x"))
        b = jump.select(F.col("from").alias("b"), F.col("to").alias("y"))
        edges = materialise(
            edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    return comps


def overlaps(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the intersections of the first `rows` sets with all sets; a matrix product over the shared elements."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.cumsum((new & shared)[shared]) - 1
    out = np.zeros((rows, len(sets)), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (start, start + COLUMNS))
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[owner[i:j], column[i:j] - start] = 1
        out += block[:rows] @ block.T
    return out


def tile_links(table: pa.Table, bits: int, percent: int, floor: float) -> list[tuple[int, int]]:
    """Links (ids) that join components of a tile's rows; rows that are not odd are compared with the odd ones only."""
    table = table.sort_by([("odd", "descending"), ("id", "ascending")])
    ids, comp, n_odd = table.column("id").to_pylist(), table.column("comp").to_pylist(), sum(table.column("odd").to_pylist())
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    sigs = np.stack([np.frombuffer(x, np.uint8) for x in table.column("sig").to_pylist()])
    fields = np.unpackbits(sigs, axis=1).reshape(len(ids), -1, bits) @ (1 << np.arange(bits))
    chance = 0.5**bits
    close = np.stack([((fields[k] == fields).mean(axis=1) - chance) / (1 - chance) >= floor for k in range(n_odd)])
    close &= np.array(comp[:n_odd])[:, None] != np.array(comp)
    if not close.any():
        return []
    use = np.flatnonzero(close.any(axis=1))
    rest = np.setdiff1d(np.flatnonzero(close.any(axis=0)), use)
    at = np.concatenate((use, rest))
    size = np.array([len(sets[k]) for k in at])
    common = overlaps([sets[k] for k in at], len(use))
    linked = (100 * common >= percent * (size[: len(use), None] + size - common)) & close[use][:, at]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    out = []
    for x, y in np.argwhere(linked).tolist():
        a, b = root(comp[at[x]]), root(comp[at[y]])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((comp[at[x]], comp[at[y]]))
    return out


def tiled(members: DataFrame, comps: DataFrame, sets: DataFrame, bits: int, percent: int, slack: float) -> DataFrame:
    """Links (a, b between components) among the members of buckets that hold several components."""
    placed = members.join(comps, "id")
    main = (
        placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
        .groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("kinds"))
        .where("kinds > 1").select("bucket", "main")
    )
    mixed = placed.join(materialise(main, "main"), "bucket").select("main", "id", "comp", (F.col("comp") != F.col("main")).alias("odd"))
    mixed = materialise(mixed.distinct(), "mixed")
    size = F.ceil(F.count(F.when(F.col("odd"), 1)) / TILE).cast("int"), F.ceil(F.count(F.when(~F.col("odd"), 1)) / TILE).cast("int")
    chunks = materialise(mixed.groupBy("main").agg(size[0].alias("odds"), size[1].alias("mains")), "chunks")
    dealt = mixed.join(chunks, "main").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("odd"), F.col("odds")).otherwise(F.col("mains"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("odds") - 1)
    with_odd = F.transform(others, lambda k: F.struct(F.lit(True).alias("inner"), F.least("own", k).alias("x"), F.greatest("own", k).alias("y")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda k: F.struct(F.lit(False).alias("inner"), F.col("own").alias("x"), k.alias("y")))
    as_main = F.transform(others, lambda k: F.struct(F.lit(False).alias("inner"), k.alias("x"), F.col("own").alias("y")))
    tiles = F.when(F.col("odd"), F.concat(with_odd, with_main)).otherwise(as_main)
    seated = dealt.select("id", "comp", "odd", F.col("main").alias("cluster"), F.explode(tiles).alias("tile")).select("id", "comp", "odd", F.struct("cluster", "tile").alias("tile"))
    seated = seated.select("id", "comp", "odd", F.xxhash64("tile").alias("tile"))
    floor = percent / 100 - slack

    def run(table: pa.Table) -> pa.Table:
        found = tile_links(table, bits, percent, floor)
        return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return seated.join(sets, "id").groupBy("tile").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80,
    bands: int = 32, rows: int = 4, bits: int = 8, slack: float = 0.2,
) -> DataFrame:
    """key, n_shingles, component_id (least key of the group), kept; one row per row of docs."""
    textkit.bounded_batches(docs.sparkSession)
    made = materialise(signatures(docs, key, text, words, bands, rows, bits), "signatures")
    full = made.where("n > 0 and id is not null")
    # sets are folded on the digest; the signature of a set is the same for each of its copies
    reps = materialise(full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")), "representatives")
    owner = materialise(full.select("id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"]).select("id", "n", "rep"), "owners")
    chosen = full.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])
    rows_of = chosen.select("id", F.explode("bands").alias("bucket"))
    shared = rows_of.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("bucket")
    members = materialise(rows_of.join(materialise(shared, "shared"), "bucket"), "buckets")
    ids = members.select("id").distinct()
    sets = materialise(stored_sets(docs, ids, key, text, words).join(chosen.select("id", "sig"), "id"), "sets")
    comps = materialise(ids.select("id", F.col("id").alias("comp")), "components")
    hubs = materialise(members.groupBy("bucket").agg(F.min("id").alias("hub")), "hubs")
    pairs = members.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    comps = contract(comps, materialise(confirmed(pairs, sets, bits, percent, slack), "links"))
    comps = contract(comps, materialise(tiled(members, comps, sets, bits, percent, slack), "links"))
    grouped = owner.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", "n", F.coalesce("comp", "rep").alias("component_id"))
    alone = made.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    out = grouped.union(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay: one document of each near-duplicate group."""
    kept = near_duplicates(docs, key=key, **options).where("kept").select(F.col(key).alias("kept_key")).distinct()
    return docs.join(kept, docs[key].cast("long").eqNullSafe(kept["kept_key"]), "left_semi")
