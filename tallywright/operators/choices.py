"""Choosing k others for each row without pairing rows with each other.

The candidates of a group get positions 1..m in seeded order. A row asks for k
positions on a seeded stride that skips its own, and an equi join on (group,
position) fetches them: k lookups per row however large the group is, and
positions spread a hot group evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import seeded_number
from tallywright.functions.text import norm_loose
from tallywright.operators.ranking import join_null_safe, merged, running_sum, seeded_rank
from tallywright.session import materialise


def with_offsets(df: DataFrame, seed: int | str, key: Sequence[str], m: Column, k: Column | int) -> DataFrame:
    """k rows per row with j and o: distinct o in [0, m), m >= k, on a seeded
    start and stride. A stride that would meet itself within k steps becomes one.
    """
    cols = [F.col(c) for c in key]
    staged = (
        df.withColumn("__m", m.cast("bigint"))
        .withColumn("__k", (F.lit(k) if isinstance(k, int) else k).cast("bigint"))
        .withColumn("__start", seeded_number(f"{seed}-start", *cols) % F.col("__m"))
        .withColumn("__stride", 1 + seeded_number(f"{seed}-stride", *cols) % F.greatest(F.col("__m") - 1, F.lit(1)))
    )
    later = F.when(F.col("__k") > 1, F.sequence(F.lit(1).cast("bigint"), F.col("__k") - 1))
    repeats = F.coalesce(F.exists(later, lambda j: (F.col("__stride") * j) % F.col("__m") == 0), F.lit(False))
    stepped = staged.withColumn("__step", F.when(repeats, F.lit(1).cast("bigint")).otherwise(F.col("__stride")))
    rows = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1),
        lambda j: F.struct(j.alias("j"), ((F.col("__start") + F.col("__step") * j) % F.col("__m")).alias("o")),
    )
    return stepped.select(*df.columns, F.explode(rows).alias("__a")).select(*df.columns, "__a.j", "__a.o")


def fetch(
    asks: DataFrame, index: DataFrame, key: Sequence[str], strata: Sequence[str], value: str, out: str
) -> DataFrame:
    """(key, out): values at the asked positions as one array of k, in ask order."""
    found = join_null_safe(asks, merged(index), [*strata, "pos"])
    rows = F.sort_array(F.collect_list(F.struct("j", F.col(value).alias("v"))))
    # k values per row: the list is bounded by the constant k
    return found.groupBy(*key).agg(F.transform(rows, lambda r: r["v"]).alias(out))


def pick_other_values(
    items: DataFrame,
    key: Sequence[str],
    strata: Sequence[str],
    value: str,
    domain: DataFrame,
    k: int,
    seed: int | str,
    out: str = "others",
    at_most: bool = False,
) -> DataFrame:
    """Items with k distinct other values of their stratum's domain.

    domain: strata and value, any repeats. Rows whose domain has fewer than k
    others are dropped, or take what there is when `at_most` is set. The distinct
    values are written once to the shared folder: both lookups rank them.
    """
    values = materialise(domain.select(*strata, value).distinct(), "values")
    index = seeded_rank(values, strata, [value], seed, out="pos", total="m")
    own = join_null_safe(items, merged(index), [*strata, value])
    others = F.col("m") - 1
    able = own.where(others >= (1 if at_most else k)).select(*key, *strata, "m", F.col("pos").alias("own"))
    asks = with_offsets(able, seed, key, others, F.least(others, F.lit(k)) if at_most else k).select(
        *key, *strata, "j", ((F.col("own") + F.col("o")) % F.col("m") + 1).alias("pos")
    )
    picked = fetch(asks, index.drop("m"), key, strata, value, out)
    return items.join(merged(picked), list(key))


def pick_rivals_without_value(
    records: DataFrame, key: str, stratum: str, value: str, name: str, k: int, seed: int | str
) -> DataFrame:
    """Records with k names of the same stratum whose value differs.

    Names stand in blocks by value, so the names that share the value are one
    run of positions and the stride walks round the rest of the circle.
    """
    blocks = records.groupBy(stratum, value).agg(F.count(F.lit(1)).alias("c"))
    hashed = blocks.withColumn("__h", F.md5(F.coalesce(F.col(value), F.lit("")).cast("binary"))).withColumn(
        "__b", F.substring("__h", 1, 3)
    )
    placed = running_sum(hashed, [stratum], "__b", ["__h", value], weight=F.col("c"), out="off", total="m").drop(
        "__h", "__b"
    )
    ranked = seeded_rank(records, [stratum, value], [key], seed, out="__r")
    index = join_null_safe(ranked, merged(placed), [stratum, value]).withColumn("pos", F.col("off") + F.col("__r") - 1)
    rest = F.col("m") - F.col("c")
    able = index.where(rest >= k).select(key, stratum, "off", "c", "m")
    asks = with_offsets(able, seed, [key], rest, k).select(
        key, stratum, "j", ((F.col("off") + F.col("c") + F.col("o")) % F.col("m")).alias("pos")
    )
    table = index.select(stratum, "pos", F.col(name).alias("__name"))
    return records.join(merged(fetch(asks, table, [key], [stratum], "__name", "others")), key)


def tiered_distractors(
    records: DataFrame, key: str, name: str, tiers: Sequence[tuple[str, Sequence[str]]], k: int, seed: int | str
) -> DataFrame:
    """(key, level, others): k other names from the tightest tier that has k.

    tiers: (label, columns), tight to loose. Names that read alike once normalised are one candidate of a tier's group,
    that of the least key, and no record is offered a name like its own. Each tier costs one ranking of its candidates,
    and each record k lookups in its own tier.
    """
    ranked = records.withColumn("__like", norm_loose(F.col(name)))
    index = None
    level, pos, m, group = F.lit(None), F.lit(None), F.lit(None), F.lit(None)

    def group_key(cols: Sequence[str]) -> Column:
        parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
        return F.concat_ws("\u0001", *parts)

    for i, (_, cols) in enumerate(tiers):
        alike = ranked.groupBy(*cols, "__like").agg(F.min(key).alias(key), F.min_by(name, key).alias("__name"))
        placed = seeded_rank(alike, list(cols), [key], seed, out=f"__p{i}", total=f"__m{i}", counts_from=alike)
        entry = placed.select("__name", F.lit(i).alias("tier"), group_key(cols).alias("grp"), F.col(f"__p{i}").alias("pos"))
        index = entry if index is None else index.unionByName(entry)
        ranked = join_null_safe(ranked, merged(placed.select(*cols, "__like", f"__p{i}", f"__m{i}")), [*cols, "__like"])
    for i in reversed(range(len(tiers))):
        fits = F.col(f"__m{i}") - 1 >= k
        level = F.when(fits, F.lit(i)).otherwise(level)
        pos = F.when(fits, F.col(f"__p{i}")).otherwise(pos)
        m = F.when(fits, F.col(f"__m{i}")).otherwise(m)
        group = F.when(fits, group_key(tiers[i][1])).otherwise(group)
    chosen = ranked.select(key, level.alias("tier"), pos.alias("own"), m.alias("m"), group.alias("grp")).where(
        "tier is not null"
    )
    asks = with_offsets(chosen, seed, [key], F.col("m") - 1, k).select(
        key, "tier", "grp", "j", ((F.col("own") + F.col("o")) % F.col("m") + 1).alias("pos")
    )
    picked = fetch(asks, index, [key, "tier"], ["tier", "grp"], "__name", "others")
    labels = F.array(*[F.lit(label) for label, _ in tiers])
    return picked.select(key, F.element_at(labels, (F.col("tier") + 1).cast("int")).alias("level"), "others")
