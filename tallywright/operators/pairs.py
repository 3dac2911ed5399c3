"""Measures between two texts of a row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.functions.reply import PASS_RATIO, tokens
from tallywright.functions.text import slugify


def token_f1_pairs(pairs: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """(key, f1) for long texts: token counts meet in a shuffle on (key, token).

    Linear in the number of tokens, and one long text is spread over tasks.
    """
    sides = pairs.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("p"), F.lit(0).alias("g"), tokens(F.col(pred)).alias("ts")),
                F.struct(F.lit(0).alias("p"), F.lit(1).alias("g"), tokens(F.col(gold)).alias("ts")),
            )
        ).alias("s"),
    ).select(key, "s.*")
    counted = (
        sides.select(key, "p", "g", F.explode_outer("ts").alias("t"))
        .groupBy(key, "t")
        .agg(
            F.sum(F.when(F.col("t").isNull(), 0).otherwise(F.col("p"))).alias("n_p"),
            F.sum(F.when(F.col("t").isNull(), 0).otherwise(F.col("g"))).alias("n_g"),
        )
    )
    totals = counted.groupBy(key).agg(
        F.sum("n_p").alias("n_p"), F.sum("n_g").alias("n_g"), F.sum(F.least("n_p", "n_g")).alias("common")
    )
    f1 = (
        F.when(F.col("n_p") + F.col("n_g") == 0, F.lit(1.0))
        .when(F.col("common") == 0, F.lit(0.0))
        .otherwise(2.0 * F.col("common") / (F.col("n_p") + F.col("n_g")))
    )
    return totals.select(key, f1.alias("f1"))


def sequence_ratio_column(a: Column, b: Column) -> Column:
    """Matching-block ratio 2M/T of two token arrays (Ratcliff-Obershelp).

    No native expression has this measure; Arrow batches carry the two arrays.
    """
    @F.pandas_udf(T.DoubleType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, list(p), list(g)).ratio() for p, g in zip(x, y)])

    return ratio(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the two lengths, to skip hopeless pairs."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(F.size(a), F.size(b)) / total)


def sequence_pass(df: DataFrame, a: str, b: str, out: str, level: float = PASS_RATIO) -> DataFrame:
    """Boolean column `out`: ratio reaches the level. Only pairs whose lengths
    allow it cross to Python."""
    # a missing side is never near
    possible = F.coalesce(ratio_bound(F.col(a), F.col(b)) >= level, F.lit(False))
    near = df.where(possible).withColumn(out, sequence_ratio_column(F.col(a), F.col(b)) >= level)
    far = df.where(~possible).withColumn(out, F.lit(False))
    return near.unionByName(far)


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio over slugs; different digits mean different titles."""
    sa, sb = slugify(a), slugify(b)
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    ratio = sequence_ratio_column(F.split(sa, ""), F.split(sb, ""))
    return F.when(digits(sa) != digits(sb), F.lit(0.0)).otherwise(ratio)
