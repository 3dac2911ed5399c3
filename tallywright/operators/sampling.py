"""Splits and samples that repeat exactly, on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import gram_key, seeded_key
from tallywright.operators.ranking import join_null_safe, range_bucket, running_sum, seeded_rank, seeded_top
from tallywright.session import materialise


def stratified_split(
    df: DataFrame, strata: Sequence[str], key: Sequence[str], target: int, out_of: int, seed: int | str
) -> DataFrame:
    """Adds `side`: per stratum, round-half-even(n * target / out_of) rows train.

    The total is not corrected, so it may miss the target by a few rows.
    """
    ranked = seeded_rank(df, strata, key, seed, out="__rn", total="__n")
    quota = F.bround(F.col("__n") * target / F.lit(out_of))
    side = F.when(F.col("__rn") <= quota, F.lit("train")).otherwise(F.lit("test"))
    return ranked.withColumn("side", side).drop("__rn", "__n")


def split_report(split: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Counts and train share per stratum; the total row has NULL strata."""
    counts = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("side") == "train").alias("n_train"),
        F.count_if(F.col("side") == "test").alias("n_test"),
    ]
    rolled = split.groupingSets([[F.col(c) for c in strata], []], *[F.col(c) for c in strata]).agg(*counts)
    return rolled.withColumn("train_share", F.round(F.col("n_train") / F.col("n"), 6))


def split_differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose side differs, or that only one split holds."""
    o = old.select(F.col(key), F.col("side").alias("old_side"))
    n = new.select(F.col(key), F.col("side").alias("new_side"))
    return o.join(n, key, "full").where(~F.col("old_side").eqNullSafe(F.col("new_side")))


def frozen_split_guard(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new split; the job fails when it differs from the frozen one."""
    bad = split_differences(old, new, key).agg(F.count(F.lit(1)).alias("n")).scalar()
    return new.withColumn(
        "side", F.when(bad > 0, F.raise_error(F.lit("the frozen split differs"))).otherwise(F.col("side"))
    )


def largest_remainder(df: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """(strata, supply, seats): proportional seats with the exact total.

    Leftover seats go to the largest remainders, ties by stratum. The table has
    one row per stratum; the rank over it is bucketed by remainder.
    """
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("supply"))
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    product = F.lit(n).cast("decimal(19,0)") * F.col("supply").cast("decimal(19,0)")
    shares = (
        counts.withColumn("__total", total.cast("decimal(19,0)"))
        .withColumn("__floor", F.floor(product / F.col("__total")).cast("bigint"))
        .withColumn("__rem", F.pmod(product, F.col("__total")).cast("decimal(19,0)"))
        .withColumn("__b", F.floor((1 - F.col("__rem") / F.col("__total")) * 1024).cast("bigint"))
    )
    ranked = running_sum(shares, [], "__b", [F.col("__rem").desc(), *strata], out="__ahead")
    left = F.lit(n) - shares.agg(F.sum("__floor").alias("f")).scalar()
    seats = F.col("__floor") + F.when(F.col("__ahead") < left, 1).otherwise(0)
    full = F.when(F.lit(n) >= F.col("__total"), F.col("supply")).otherwise(seats)
    return ranked.select(*strata, "supply", full.cast("bigint").alias("seats"))


def take_seats(df: DataFrame, seats: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int | str) -> DataFrame:
    """The first `seats` rows of each stratum in seeded order."""
    ranked = seeded_rank(df, strata, key, seed, out="__rn")
    joined = join_null_safe(ranked, seats.select(*strata, "seats"), strata)
    return joined.where(F.col("__rn") <= F.col("seats")).drop("__rn", "seats")


def largest_remainder_sample(
    df: DataFrame, strata: Sequence[str], key: Sequence[str], n: int, seed: int | str
) -> DataFrame:
    return take_seats(df, largest_remainder(df, strata, n), strata, key, seed)


def equal_quota_sample(df: DataFrame, category: str, key: Sequence[str], quota: int, seed: int | str) -> DataFrame:
    return seeded_top(df, [category], key, seed, quota)


def waterfill(df: DataFrame, category: str, target: int) -> DataFrame:
    """(category, supply, seats): scarce categories whole, the rest level.

    Served in ascending supply, each may take left div remaining. That has a
    closed form: categories before the first one that cannot be taken whole are
    whole, and the others share what is left, the last ones one more.
    """
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("supply"))
    if target == 0:
        return counts.withColumn("seats", F.col("supply"))
    order = ["supply", category]
    bucketed = range_bucket(counts, order)
    pos = running_sum(bucketed, [], "__b", order, out="__before", total="__m")
    filled = running_sum(pos, [], "__b", order, weight=F.col("supply"), out="__taken")
    quota = F.floor((F.lit(target) - F.col("__taken")) / (F.col("__m") - F.col("__before")))
    short = filled.where(F.col("supply") > quota)
    first = short.agg(F.min_by(F.struct("__before", "__taken", "__m"), F.struct("supply", F.col(category))).alias("f"))
    k, taken, m = (first.select(F.col(f"f.{c}")).scalar() for c in ("__before", "__taken", "__m"))
    rest = m - k
    left = F.lit(target) - taken
    level = F.floor(left / rest)
    extra = left - level * rest
    seats = (
        F.when(k.isNull() | (F.col("__before") < k), F.col("supply"))
        .when(F.col("__before") >= m - extra, level + 1)
        .otherwise(level)
    )
    return filled.select(category, "supply", F.greatest(seats, F.lit(0)).cast("bigint").alias("seats"))


def waterfill_sample(df: DataFrame, category: str, key: Sequence[str], target: int, seed: int | str) -> DataFrame:
    if target == 0:
        return df
    return take_seats(df, waterfill(df, category, target), [category], key, seed)


def carve_validation(df: DataFrame, key: Sequence[str], seed: int | str, percent: int = 5, digits: int = 4) -> DataFrame:
    """Adds `part`: max(1, floor(n * percent / 100)) rows become validation.

    Selection instead of sorting: a histogram of the digests' leading digits tells which bucket holds the last row to be
    held out, only that bucket is sorted, and all rows are then compared with its digest. Rows with one key share a part.
    """
    digest = df.select(*key, seeded_key(seed, *[F.col(k) for k in key]).alias("__h")).withColumn("__b", F.substring("__h", 1, digits))
    counts = digest.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__b"))  # a row per bucket
    whole = counts.agg(F.sum("__c").alias("n")).scalar()
    wanted = F.greatest(F.lit(1), F.floor(whole * percent / F.lit(100)))
    edge = counts.select("__b", "__c", upto.alias("__upto")).where(F.col("__upto") >= wanted).agg(
        F.min_by(F.struct("__b", (F.col("__upto") - F.col("__c")).alias("before")), "__b").alias("e")
    )
    bucket, before = edge.select("e.__b").scalar(), edge.select("e.before").scalar()
    row = F.struct("__h", *key)
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *key))
    last = digest.where(F.col("__b") == bucket).withColumn("__rn", place).where(F.col("__rn") == wanted - before).agg(F.max(row).alias("r")).scalar()
    own = F.struct(seeded_key(seed, *[F.col(k) for k in key]).alias("__h"), *key)
    return df.withColumn("part", F.when(F.coalesce(own <= last, F.lit(False)), F.lit("validation")).otherwise(F.lit("train")))


def held_out_subset_check(full: DataFrame, held: DataFrame, record: str, question: str) -> DataFrame:
    """One row: held-out records outside the full set, records left to train on,
    and questions the two sets share."""
    f, h = full.select(record).distinct(), held.select(record).distinct()
    outside = h.join(f, record, "left_anti").agg(F.count(F.lit(1)).alias("c"))
    remaining = f.join(h, record, "left_anti").agg(F.count(F.lit(1)).alias("c"))
    shared = (
        held.select(question).distinct().join(full.select(question).distinct(), question, "left_semi")
    ).agg(F.count(F.lit(1)).alias("c"))
    return outside.select(
        F.col("c").alias("outside"), remaining.scalar().alias("remaining"), shared.scalar().alias("shared_questions")
    ).withColumn("ok", (F.col("outside") == 0) & (F.col("remaining") > 0) & (F.col("shared_questions") == 0))


def first_of_group(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in `order`.

    An aggregate rather than a window: equal rows shrink on the map side, so a
    key that holds a third of all rows costs nothing extra.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, rank).alias("r")
    ).select("r.*")


def pair_key(question: Column, answer: Column) -> Column:
    """A 16-byte key for question and answer, which may be NULL."""
    return gram_key(F.concat(F.coalesce(F.md5(question.cast("binary")), F.lit("-")), F.coalesce(F.md5(answer.cast("binary")), F.lit("-"))))


def drawn_keys(items: DataFrame, key: str, category: str, quota: int, seed: int | str) -> DataFrame:
    """(pair, key, category) of the rows that equal_quota_sample draws from the first of each question and answer, which
    come first by key and category.

    Digests stand for the texts, so that whole items are never shuffled, and few of the digests are: a task sends on the
    first rows of each category, and what else has their question and answer. Where too many of those turn out not to
    be the first of theirs, all digests meet. Rows with equal digests of the draw all stay: the draw itself, on the few
    rows that have these keys, tells them apart.
    """
    question, answer = F.col("question"), F.col("answer")
    narrow = items.select(
        pair_key(question, answer).alias("pair"), F.col(key), F.col(category), F.unhex(seeded_key(seed, F.col(key), question, answer)).alias("__h")
    )
    place = F.rank().over(Window.partitionBy(category).orderBy("__h"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.groupBy("pair").agg(F.min(F.struct(key, category, "__h")).alias("r")).select("pair", "r.*")

    # Spark keeps so many rows per category and task, and no more than 1,000, before it shuffles
    most = min(quota * 16, 1000)
    early = materialise(narrow.withColumn("__rn", place).where(F.col("__rn") <= most).drop("__rn"), "early")
    met = first(narrow.join(F.broadcast(early.select("pair").distinct()), "pair", "left_semi"))
    won = materialise(join_null_safe(met, F.broadcast(early), ["pair", key, category, "__h"], "left_semi"), "won")
    seen = early.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    kept = won.groupBy(category).agg(F.count(F.lit(1)).alias("n_won"))
    short = join_null_safe(seen, kept, [category], "left").where((F.col("n") >= most) & (F.coalesce("n_won", F.lit(0)) < quota))
    winners = won if short.isEmpty() else first(narrow)
    return winners.withColumn("__rn", place).where(F.col("__rn") <= quota).select("pair", key, category)


def dedupe_items(items: DataFrame, order: Sequence[str], question: str = "question", answer: str = "answer") -> DataFrame:
    """The first item of each question and answer, which meet as digests."""
    return first_of_group(items, [gram_key(F.col(question)), gram_key(F.col(answer))], order)


def dedupe_choice_items(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same for choice items: question plus the sorted option texts."""
    options = F.to_json(F.sort_array(F.map_values("options")))
    return first_of_group(items, [gram_key(F.col("question")), gram_key(options)], order)


def clashing_questions(items: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Question texts with more than one distinct answer."""
    return (
        items.groupBy(question)
        .agg(F.min(answer).alias("__lo"), F.max(answer).alias("__hi"), F.count(F.lit(1)).alias("n_items"))
        .where(F.col("__lo") != F.col("__hi"))
        .select(question, "n_items")
    )


def drop_clashing(items: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Digests of questions and answers meet in place of the texts."""
    ends = items.groupBy(gram_key(F.col(question)).alias("__q")).agg(
        F.min(gram_key(F.col(answer))).alias("__lo"), F.max(gram_key(F.col(answer))).alias("__hi")
    )
    return items.withColumn("__q", gram_key(F.col(question))).join(ends.where("__lo <> __hi").select("__q"), "__q", "left_anti").drop("__q")


def mixture_summary(items: DataFrame, category: str, minimum: float = 0.01, small: int = 20) -> DataFrame:
    """Counts and shares per category; categories above `small` must hold `minimum`."""
    total = items.agg(F.count(F.lit(1)).alias("c")).scalar()
    counts = items.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / total
    return counts.select(
        category,
        "n",
        F.round(share, 6).alias("share"),
        ((F.col("n") <= small) | (share >= minimum)).alias("ok"),
    )


def gate(name: str, value: Column, passed: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), value.cast("bigint").alias("value"), passed.alias("passed"))


def side_leak_gates(
    train: DataFrame, test: DataFrame, reserved: DataFrame, all_records: DataFrame, regime: str
) -> DataFrame:
    """Gate table (gate, value, passed) over two item sides.

    train, test: record, question, unit; reserved: unit, the content held for
    the test side before its clashing items were dropped.
    """

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("c")).scalar()

    records = train.select("record").distinct()
    crossing = size(records.join(test.select("record").distinct(), "record", "left_semi"))
    unseen = size(all_records.select("record").distinct().join(records, "record", "left_anti"))
    leaked = size(
        train.where("unit is not null").select("unit").distinct().join(reserved.select("unit").distinct(), "unit", "left_semi")
    )
    same = size(test.join(train.select("question").distinct(), "question", "left_semi"))
    first = (
        gate("records on both sides", crossing, crossing == 0)
        if regime == "split"
        else gate("records without a training item", unseen, unseen == 0)
    )
    rows = F.array(
        first,
        gate("reserved content in training", leaked, leaked == 0),
        gate("same question on both sides", same, same == 0),
    )
    return train.sparkSession.range(1).select(F.explode(rows).alias("g")).select("g.*")

