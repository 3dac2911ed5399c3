"""Tables that change by publication: staged beside the current version, compared with it, then named by a marker.

A table's folder holds `versions/<name>`, each a complete write that is never changed, and `published`, a folder of
markers, one line each: (number, version, base, rows). The current version is that of the highest number. Readers only
follow markers, so an interrupted write, or a preview, changes nothing for them; publishing is the writing of one small
file. A publisher names the number it has compared with; if another has published since, it is refused, and if two
publish at once the lesser version name holds for that number, for all readers alike, and the other is told.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.provenance import row_hash
from tallywright.operators.ranking import join_null_safe

MARKER = "number bigint, version string, base bigint, rows bigint"


class Outdated(RuntimeError):
    """Somebody else has published in the meantime."""


def markers(spark: SparkSession, root: str) -> DataFrame:
    """(number, version, base, rows) of every publication that holds; none for a new table."""
    try:
        found = spark.read.schema(MARKER).json(os.path.join(root, "published"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKER)
    return found.groupBy("number").agg(F.min_by(F.struct("version", "base", "rows"), "version").alias("m")).select("number", "m.*")


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Number and version of the last publication; (0, None) for a new table."""
    last = markers(spark, root).orderBy(F.desc("number")).limit(1).collect()
    return (last[0]["number"], last[0]["version"]) if last else (0, None)


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, "versions", version))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current(spark, root)[1]
    if version is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return read_version(spark, root, version)


def stage(df: DataFrame, root: str) -> str:
    """Write df as a new version that no marker names yet."""
    version = uuid.uuid4().hex
    df.write.parquet(os.path.join(root, "versions", version))
    return version


def _digests(df: DataFrame, key: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    """(key, n, sums): rows of a key and sums over their digests, which no order of rows changes."""
    h = df.select(*key, row_hash(columns).alias("__h"))
    word = lambda k: F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("bigint")
    return h.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{side}_rows"), F.array(*[F.sum(word(k)) for k in range(4)]).alias(f"__{side}"))


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, change, old_rows, new_rows) of the keys whose rows differ: added, removed or changed.

    Digests of rows meet by key, and a key's rows are summed up before they meet, so neither a wide row nor a key with
    many rows travels. A column that only one side has makes every shared key changed.
    """
    kept = [c for c in new.columns if c in old.columns]
    same_columns = F.lit(set(old.columns) == set(new.columns))
    a, b = _digests(old, key, sorted(kept), "old"), _digests(new, key, sorted(kept), "new").withColumnsRenamed({k: f"__n_{k}" for k in key})
    on: Column = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__n_{k}"))
    both = a.join(b, on, "full").select(
        *[F.when(F.col("new_rows").isNull(), F.col(k)).otherwise(F.col(f"__n_{k}")).alias(k) for k in key], "old_rows", "new_rows", "__old", "__new"
    )
    change = (
        F.when(F.col("old_rows").isNull(), F.lit("added"))
        .when(F.col("new_rows").isNull(), F.lit("removed"))
        .when((F.col("old_rows") != F.col("new_rows")) | (F.col("__old") != F.col("__new")) | ~same_columns, F.lit("changed"))
    )
    return both.select(*key, change.alias("change"), F.coalesce("old_rows", F.lit(0)).alias("old_rows"), F.coalesce("new_rows", F.lit(0)).alias("new_rows")).where("change is not null")


def preview(df: DataFrame, root: str, key: Sequence[str]) -> DataFrame:
    """What publishing df would change; nothing is written."""
    spark = df.sparkSession
    version = current(spark, root)[1]
    old = df.where(F.lit(False)) if version is None else read_version(spark, root, version)
    return changes(old, df, key)


def publish(df: DataFrame, root: str, key: Sequence[str], base: int | None = None, least_kept: float = 0.0) -> int:
    """Stage df, compare it with the current version, and name it by a marker; returns its number.

    base: the number that the caller's preview was made against. least_kept: the share of the current keys that must be
    left, so that a broken build doesn't replace a table; nothing is published below it.
    """
    spark = df.sparkSession
    number, version = current(spark, root)
    if base is not None and base != number:
        raise Outdated(f"{root} is at {number}, the preview was made at {base}")
    staged = stage(df, root)
    written = read_version(spark, root, staged)
    if version is not None and least_kept > 0:
        old = read_version(spark, root, version).select(*key).distinct()
        kept = join_null_safe(old, written.select(*key).distinct(), list(key), "left_semi")
        if kept.count() < least_kept * old.count():
            raise ValueError(f"fewer than {least_kept} of the keys of {root} would be left")
    rows = written.count()
    line = spark.createDataFrame([(number + 1, staged, number, rows)], MARKER)
    line.coalesce(1).write.mode("append").json(os.path.join(root, "published"))
    if current(spark, root)[1] != staged:
        raise Outdated(f"another version was published in {root} as {number + 1}")
    return number + 1
