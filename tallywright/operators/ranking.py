"""Exact ranks and running sums that never sort a whole group in one task.

A window over a hot group would put that group into one task. Here every group
is cut into ordered buckets: bucket totals give each bucket its offset, and only
the rows of one bucket are sorted together. The result equals the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import seeded_key
from tallywright.functions.text import let


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys meet, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def merged(df: DataFrame) -> DataFrame:
    """A side of a join in which both sides are shuffled, sorted and merged, never broadcast.

    Spark takes rows exploded from a file, or computed from it, for as large as that compressed file. Without this a side
    of millions of rows passes for a few MB and is broadcast through the driver.
    """
    return df.hint("merge")


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key before they are cut into many more.

    The session's number of shuffle partitions is named, since adaptive execution, which sees only the size before the
    cut, would merge partitions whose number isn't.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running_sum(
    df: DataFrame,
    strata: Sequence[str],
    bucket: str,
    order: Sequence[str],
    weight: Column | None = None,
    out: str = "before",
    total: str | None = None,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """Sum of `weight` over the earlier rows of the stratum.

    counts_from: the same rows before other columns were added, so that bucket
    totals do not repeat that work.

    `bucket` must not decrease along `order`. The window over bucket totals
    holds one row per bucket and stratum; keep buckets to a few thousand.
    """
    weighted = df.withColumn("__w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint"))
    source = weighted if counts_from is None else counts_from.withColumn(
        "__w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    )
    totals = source.groupBy(*strata, bucket).agg(F.sum("__w").alias("__sum"))
    per_stratum = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    ahead = per_stratum.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *strata,
        bucket,
        F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"),
        *([F.sum("__sum").over(per_stratum).alias(total)] if total else []),
    )
    inside = (
        Window.partitionBy(*strata, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = weighted.withColumn("__local", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    joined = join_null_safe(local, offsets, [*strata, bucket])
    return joined.withColumn(out, F.col("__offset") + F.col("__local")).drop("__w", "__offset", "__local")


def seeded_rank(
    df: DataFrame,
    strata: Sequence[str],
    key: Sequence[str],
    seed: int | str,
    out: str = "rn",
    total: str | None = None,
    digits: int = 3,
    counts_from: DataFrame | None = None,
) -> DataFrame:
    """1-based rank in each stratum by md5(seed|key), then key.

    Hash order is uniform, so the leading hex digits are even, ordered buckets
    (16 ** digits of them) whatever the size of the stratum.
    """

    def hashed(frame: DataFrame) -> DataFrame:
        digest = frame.withColumn("__h", seeded_key(seed, *[F.col(k) for k in key]))
        return digest.withColumn("__b", F.substring("__h", 1, digits))

    source = None if counts_from is None else hashed(counts_from)
    ranked = running_sum(hashed(df), strata, "__b", ["__h", *key], out=out, total=total, counts_from=source)
    return ranked.withColumn(out, F.col(out) + 1).drop("__h", "__b")


def seeded_top(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int | str, k: int) -> DataFrame:
    """First k rows of each stratum in seeded order, for a constant k.

    Spark keeps k rows per stratum and task before it shuffles, so a hot
    stratum arrives as k rows per map task.
    """
    window = Window.partitionBy(*strata).orderBy(seeded_key(seed, *[F.col(c) for c in key]), *key)
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") <= k).drop("__rn")


def quantile_cuts(df: DataFrame, order: Sequence[str], buckets: int = 4096) -> DataFrame:
    """One row: boundaries that cut the rows in the order of these columns, numbers or texts, into even ranges.

    The distinct rows are dealt into slots by a hash of the columns, and the one with the least hash stays of each, which
    is an even draw of as many rows as there are slots. Only hashes are aggregated; the rows are picked by a broadcast of
    one hash per slot. The boundaries come in sqrt(buckets) groups, for a search in two steps.
    """
    side = math.isqrt(buckets)
    hashed = df.select(*order, F.xxhash64(*order).alias("__h"))
    least = hashed.groupBy(F.pmod("__h", F.lit(side * side)).alias("__slot")).agg(F.min("__h").alias("__h")).select("__h")
    picked = hashed.join(F.broadcast(least), "__h", "left_semi").select(F.struct(*order).alias("k")).distinct()
    cuts = picked.agg(F.array_sort(F.collect_list("k")).alias("a"))
    return cuts.select(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.slice("a", i * side + 1, F.lit(side))).alias("groups"))


def range_bucket(df: DataFrame, order: Sequence[str], buckets: int = 4096, out: str = "__b") -> DataFrame:
    """Adds a bucket that never decreases along `order`: the number of boundaries that are not above the row.

    One outlier or a long common prefix changes nothing, since boundaries are drawn from the rows themselves. Columns
    after the first deal out its equal values.
    """
    side = math.isqrt(buckets)
    groups, row = F.col("__cuts"), F.struct(*order)
    ahead = F.size(F.filter(groups, lambda g: F.get(g, F.lit(0)) <= row))

    def within(i: Column) -> Column:
        return (i - 1) * side + F.size(F.filter(F.get(groups, i - 1), lambda cut: cut <= row))

    place = let(ahead, lambda i: F.when(i > 0, within(i)).otherwise(F.lit(0))).cast("bigint")
    cuts = quantile_cuts(df, order, buckets).scalar()  # a column first: functions over arrays take no subquery
    return df.withColumn("__cuts", cuts).withColumn(out, place).drop("__cuts")


def ordered_rank(
    df: DataFrame, strata: Sequence[str], key: str, out: str = "rn", total: str | None = None, buckets: int = 4096
) -> DataFrame:
    """1-based rank by a unique key, number or text, whole or within strata."""
    bucketed = range_bucket(df, [key], buckets)
    ranked = running_sum(bucketed, strata, "__b", [key], out=out, total=total)
    return ranked.withColumn(out, F.col(out) + 1).drop("__b")


def previous_row(
    df: DataFrame, strata: Sequence[str], key: str, carry: Sequence[str], buckets: int = 4096
) -> DataFrame:
    """Adds prev_<c> from the row before in key order.

    lag() runs inside one bucket; the first row of a bucket takes the last row
    of the nearest earlier bucket, from a table of one row per bucket.
    """
    bucketed = range_bucket(df, [key], buckets)
    inside = Window.partitionBy(*strata, "__b").orderBy(key)
    row = F.struct(*[F.col(c).alias(c) for c in carry])
    lagged = bucketed.withColumn("__prev", F.lag(row).over(inside))
    last = bucketed.groupBy(*strata, "__b").agg(F.max_by(row, F.col(key)).alias("__last"))
    across = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))).orderBy("__b")
    edges = last.select(*strata, "__b", F.lag("__last").over(across).alias("__edge"))
    joined = join_null_safe(lagged, edges, [*strata, "__b"])
    prev = F.coalesce(F.col("__prev"), F.col("__edge"))
    return joined.select(*df.columns, *[prev.getField(c).alias(f"prev_{c}") for c in carry])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group figures put back on the rows: partial aggregates and a join whose
    row side AQE may split, in place of a window that would gather each group."""
    return join_null_safe(df, stats, keys, "left")
