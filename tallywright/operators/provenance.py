"""Fingerprints, build checks and table upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import hash_number
from tallywright.functions.text import MISSING, blank_to_empty
from tallywright.operators.ranking import join_null_safe


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ingest_new_only(incoming: DataFrame, archive: DataFrame, content: str) -> DataFrame:
    """Incoming rows whose content is not archived; names play no part."""
    known = archive.select(content_hash(F.col(content)).alias("__sha")).distinct()
    return (
        incoming.withColumn("__sha", content_hash(F.col(content))).join(known, "__sha", "left_anti").drop("__sha")
    )


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 over the named columns, each with its length, NULL apart from ''."""
    texts = [F.col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(label, n_rows, digests): independent of row order and partitioning. An xor and four sums of 32-bit words."""
    h = row_hash(columns)
    # xor cancels a pair of equal rows, the sum does not
    return df.select(h.alias("h")).agg(
        F.lit(label).alias("label"),
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(hash_number(F.col("h"))).alias("xor_digest"),
        *[F.sum(hash_number(F.substring("h", 1 + 8 * k, 8))).alias(f"sum_digest_{k}") for k in range(1, 5)],
    )


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest rows of both, the new row where both hold the key."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def build_status(headers: DataFrame, manifest: DataFrame, missing_is_fatal: bool) -> DataFrame:
    """Status of each prediction file against the current question sets.

    headers: file, question_file, sha; manifest: question_file, sha.
    """
    current = manifest.select("question_file", F.col("sha").alias("current_sha"))
    blank = F.coalesce(F.col("sha"), F.lit("")) == ""
    status = (
        F.when(blank, F.lit("refused: no hash") if missing_is_fatal else F.lit("allowed: no hash"))
        .when(F.col("sha").eqNullSafe(F.col("current_sha")), F.lit("ok"))
        .otherwise(F.lit("refused: other build"))
    )
    return join_null_safe(headers, current, ["question_file"], "left").withColumn("status", status)


def require_same_build(headers: DataFrame, manifest: DataFrame, missing_is_fatal: bool) -> DataFrame:
    """Raises inside the job when any prediction file answers another build."""
    status = build_status(headers, manifest, missing_is_fatal)
    return status.withColumn(
        "status",
        F.when(
            F.startswith("status", F.lit("refused")), F.raise_error(F.concat_ws(" ", F.col("file"), F.col("status")))
        ).otherwise(F.col("status")),
    )


def merge_keep_extra_columns(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rebuilt rows plus the columns only the old table had, blank for new ids."""
    extra = [c for c in old.columns if c not in new.columns]
    joined = join_null_safe(new, old.select(key, *extra), [key], "left")
    return joined.select(*new.columns, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in extra])


def fill_if_blank(
    table: DataFrame, source: DataFrame, key: str, columns: Sequence[str], overwrite: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(filled table, counters): a column is filled only where it is blank.

    Counters per column: filled, source_blank, kept_different.
    """
    src = source.select(key, *[F.col(c).alias(f"__s_{c}") for c in columns])
    joined = join_null_safe(table, src, [key], "left")
    old = {c: blank_to_empty(F.col(c), MISSING) for c in columns}
    new = {c: blank_to_empty(F.col(f"__s_{c}"), MISSING) for c in columns}

    def take(c: str) -> Column:
        wanted = (new[c] != "") & (old[c] != new[c])
        return wanted if overwrite else wanted & (old[c] == "")

    filled = joined.select(
        *[
            (F.when(take(c), new[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c))
            for c in table.columns
        ]
    )
    counts = joined.agg(
        *[
            f
            for c in columns
            for f in (
                F.count_if(take(c)).alias(f"{c}__filled"),
                F.count_if(new[c] == "").alias(f"{c}__source_blank"),
                F.count_if((new[c] != "") & (old[c] != "") & (old[c] != new[c]) & ~take(c)).alias(
                    f"{c}__kept_different"
                ),
            )
        ]
    )
    report = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"{c}__filled").alias("filled"),
                        F.col(f"{c}__source_blank").alias("source_blank"),
                        F.col(f"{c}__kept_different").alias("kept_different"),
                    )
                    for c in columns
                ]
            )
        ).alias("r")
    ).select("r.*")
    return filled, report


def restore_prior_version(df: DataFrame, canonical: str, printed: str) -> DataFrame:
    """The older table: the printed value back in the canonical column."""
    return df.withColumn(canonical, F.col(printed)).drop(printed)
