"""The registered queries of the training-data operators: thin layers that give the operators' results their digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm import (
    block_labeller,
    byte_bpe,
    centroid_language,
    line_frequency,
    merkle,
    minhash,
    negatives,
    packing,
    ppm,
    pu_quality,
    quartile_digest,
    secret_tests,
    warc,
)
from tallywright.llm.textkit import documents, fold
from tallywright.session import scratch_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(documents(spark, sf_dir))


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.compare_with_next(documents(spark, sf_dir))


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = pu_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    scored = pu_quality.score(docs, net)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = centroid_language.fit(docs, fold(F.col("doc_id"), 4) != 2)
    found = centroid_language.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_secret_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_tests.find(documents(spark, sf_dir))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in secret_tests.KINDS]
    base = secret_tests.listed(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *count, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_tests.listed(F.col("spans")).alias("spans"))


def op6_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    net = block_labeller.fit(pages)
    # the address takes part in the key, so that no join has to bring it back
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    text = block_labeller.extract(keyed, net, key="page")
    return text.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, BYTE_RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op9_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = fold(F.col("doc_id"), 5)
    scored = ppm.scores(documents(spark, sf_dir), remainder != 1)
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = [F.translate(c, merkle.UPPER, merkle.UPPER.lower()) if c == "text" else F.col(c) for c in fields]
    forged = F.when(fold(F.col("doc_id"), 3) == 0, merkle.leaf(tampered)).alias("forged")
    proofs = merkle.prove(documents(spark, sf_dir), merkle.leaf([F.col(c) for c in fields]), carry=[forged])
    checked = merkle.folded(proofs.withColumn("start", F.coalesce("forged", "digest")), "start")
    text = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "root", "folded")}
    return checked.select(
        "doc_id", text["digest"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
        F.sha2(F.lower(F.hex("others")), 256).alias("proof_sha256"), text["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op11_oracle() -> str:
    """DuckDB SQL: runs of eight become digests level by level; a path is folded upwards one run at a time."""

    def item(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(item(text if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

    def levels(source: str) -> str:
        return f"""SELECT 0 AS l, lang, i, h, n FROM {source} UNION ALL
  SELECT any_value(l) + 1, lang, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM {{0}} WHERE n > 1 GROUP BY lang, i // 8"""

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_prepend(4294967295, [CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT) FOR k IN range(1, length(CAST(doc_id AS VARCHAR)) + 1)]), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(x AS BIGINT) FOR x IN range(8)]), lambda c, d: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, lang, {digest('text')} AS h, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {digest(lower)} END AS forged,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
low AS ({levels('leaves').format('low')}),
sub AS MATERIALIZED (SELECT lang AS own, h, 0 AS lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS ({levels('sub').format('high')}),
nodes AS MATERIALIZED (SELECT 0 AS side, l, lang, i, h, n FROM low UNION ALL SELECT 1, l, NULL, i, h, n FROM high),
steps AS MATERIALIZED (SELECT lang, i AS leaf_i, 0 AS side, i, n FROM leaves),
climb AS (SELECT doc_id, d.lang, d.h AS leaf, coalesce(forged, d.h) AS cur, 0 AS side, 0 AS l, d.i, d.n, '' AS proof, s.i AS si, s.n AS sn, s.h AS subroot
  FROM leaves d JOIN sub s ON s.own IS NOT DISTINCT FROM d.lang
  UNION ALL
  SELECT doc_id, lang, leaf, CASE WHEN n > 1 THEN sha256(coalesce(lft, '') || cur || coalesce(rgt, '')) ELSE cur END, CASE WHEN n > 1 THEN side ELSE 1 END, CASE WHEN n > 1 THEN l + 1 ELSE 0 END,
    CASE WHEN n > 1 THEN i // 8 ELSE si END, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE sn END, CASE WHEN n > 1 THEN proof || coalesce(lft, '') || coalesce(rgt, '') ELSE proof END, si, sn, subroot
  FROM (SELECT c.*, string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < c.i) AS lft, string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > c.i) AS rgt
    FROM climb c LEFT JOIN nodes x ON x.side = c.side AND x.l = c.l AND x.lang IS NOT DISTINCT FROM CASE WHEN c.side = 0 THEN c.lang END AND x.i // 8 = c.i // 8 AND c.n > 1
    WHERE NOT (c.side = 1 AND c.n = 1) GROUP BY ALL))
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
FROM climb, (SELECT h FROM high WHERE n = 1) r WHERE side = 1 AND climb.n = 1"""


def op12_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    warc.write(pages, path)
    back = warc.records(spark, path)
    key = pages.schema["page_id"].dataType
    return back.select(F.col("key").cast(key).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key).alias("refers_to"), "intact")


def op13_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table, F.col("vec_id") % 100 == 0, label=label)


OP13_ORACLE = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS MATERIALIZED (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


#: A payload's digest and length decide which records are equal.
OP12_ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to, TRUE AS intact FROM m"""


def op8_oracle(percent: int = 80) -> str:
    """DuckDB SQL for the groups: exact links between different sets of word pairs, then least reachable keys."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) > 1 THEN list_sort(list_distinct([words[i] || ' ' || words[i + 1] FOR i IN generate_series(1, len(words) - 1)])) ELSE words END AS grams FROM w),
own AS (SELECT doc_id, len(grams) AS n, min(doc_id) OVER (PARTITION BY grams) AS rep, grams FROM s WHERE len(grams) > 0),
g AS MATERIALIZED (SELECT rep, n, unnest(grams) AS gram FROM own WHERE doc_id = rep),
shared AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM g a JOIN g b ON a.gram = b.gram AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS MATERIALIZED (SELECT x, y FROM shared WHERE 100 * c >= {percent} * (nx + ny - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS a, x AS b FROM edges UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(comp.component, own.rep, s.doc_id) AS component_id,
       coalesce(comp.component, own.rep, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN own ON own.doc_id = s.doc_id LEFT JOIN comp ON comp.a = own.rep"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_frequency": op1_line_frequency,
    "op2_quartile_digest": op2_quartile_digest,
    "op3_pu_quality": op3_pu_quality,
    "op4_centroid_language": op4_centroid_language,
    "op5_secret_tests": op5_secret_tests,
    "op6_block_labeller": op6_block_labeller,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op9_dp_packing": op9_dp_packing,
    "op10_ppm": op10_ppm,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_zip_warc": op12_zip_warc,
    "op13_kronecker_negatives": op13_kronecker_negatives,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op1_line_frequency": line_frequency.oracle(), "op8_bbit_minhash": op8_oracle(), "op11_merkle_manifest": op11_oracle(), "op12_zip_warc": OP12_ORACLE, "op13_kronecker_negatives": OP13_ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
