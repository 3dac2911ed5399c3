"""Excerpts of a record's bars, and which records own them.

Windows are cut inside the row that holds the bars, so cutting adds no shuffle;
only ownership, a property of the whole corpus, is an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import gram_key, seeded_key
from tallywright.functions.text import words_of

# fixed values: excerpt lengths, and the lengths asked in counting questions
EXCERPT_BARS = [2, 4, 8]
COUNT_BARS = list(range(3, 13))

Notes = Callable[[Column], Column]


def word_notes(excerpt: Column) -> Column:
    """Words as notes, bar marks apart: pitch is the length of the word."""
    sounding = F.filter(words_of(excerpt), lambda w: w != "|")
    return F.transform(sounding, lambda w: F.struct(F.length(w).cast("bigint").alias("pitch"), w.alias("token")))


def window_text(bars: Column, start: Column, n: Column | int) -> Column:
    size = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(bars, start.cast("int") + 1, size.cast("int")), " | ")


def _starts(bars: Column, n: int, step: int) -> Column:
    # sequence() counts down when its end lies below its start
    return F.when(F.size(bars) >= n, F.sequence(F.lit(0), F.size(bars) - n, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def _window(bars: Column, start: Column, n: int) -> Column:
    return F.struct(F.lit(n).alias("n"), start.alias("start"), window_text(bars, start, n).alias("excerpt"))


def _windows(bars: Column, n: int, step: int) -> Column:
    return F.transform(_starts(bars, n, step), lambda s: _window(bars, s, n))


def _explode_windows(records: DataFrame, bars: str, per_size: Sequence[Column]) -> DataFrame:
    """One row per window. The bars array stays behind: only the windows
    themselves are copied into the exploded rows."""
    rest = [c for c in records.columns if c != bars]
    cut = records.select(*rest, F.explode(F.concat(*per_size)).alias("__w"))
    return cut.select(*rest, "__w.n", "__w.start", "__w.excerpt")


def sliding_excerpts(records: DataFrame, bars: str, sizes: Sequence[int] = EXCERPT_BARS) -> DataFrame:
    """Adds n, start and excerpt: every window of n consecutive bars."""
    return _explode_windows(records, bars, [_windows(F.col(bars), n, 1) for n in sizes])


def tiling_excerpts(records: DataFrame, bars: str, sizes: Sequence[int] = EXCERPT_BARS) -> DataFrame:
    """Windows side by side, with 1-based first and last bar."""
    cut = _explode_windows(records, bars, [_windows(F.col(bars), n, n) for n in sizes])
    return cut.withColumn("first_bar", F.col("start") + 1).withColumn("last_bar", F.col("start") + F.col("n"))


def picked_excerpts(
    records: DataFrame,
    key: str,
    bars: str,
    sizes: Sequence[int],
    limit: int | None,
    seed: int | str,
    notes: Notes | None = None,
    fill: bool = False,
) -> DataFrame:
    """The first `limit` windows per size in seeded order, inside the row.

    With `notes`, dull windows drop out: after the cut, or before it when
    `fill` asks for `limit` informative ones.
    """
    b = F.col(bars)

    def picked(n: int) -> Column:
        starts = _starts(b, n, 1)
        if fill and notes is not None:
            starts = F.filter(starts, lambda s: informative_excerpt(notes(window_text(b, s, n))))
        if limit is None:
            return F.transform(starts, lambda s: _window(b, s, n))
        ranked = F.sort_array(
            F.transform(starts, lambda s: F.struct(seeded_key(seed, F.col(key), F.lit(n), s).alias("h"), s.alias("s")))
        )
        return F.transform(F.slice(ranked, 1, limit), lambda r: _window(b, r["s"], n))

    out = _explode_windows(records, bars, [picked(n) for n in sizes])
    if notes is not None and not fill:
        out = out.withColumn("__n", notes(F.col("excerpt"))).where(informative_excerpt(F.col("__n"))).drop("__n")
    return out


def excerpt_owners(excerpts: DataFrame, owner: str) -> DataFrame:
    """(gram, n_owners): distinct owners of each excerpt over the whole corpus.

    Sixteen bytes stand for the text in the shuffle. Repeats inside one record
    collapse before it, and a phrase found everywhere is counted in parts.
    """
    pairs = excerpts.select(gram_key(F.col("excerpt")).alias("gram"), owner).distinct()
    return pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n_owners"))


def shared_excerpts(excerpts: DataFrame, owner: str) -> DataFrame:
    """(gram): excerpts with more than one owner; least and greatest owner decide,
    so a phrase found everywhere costs no more than a rare one."""
    ends = excerpts.groupBy(gram_key(F.col("excerpt")).alias("gram")).agg(
        F.min(owner).alias("lo"), F.max(owner).alias("hi")
    )
    return ends.where("lo <> hi").select("gram")


def drop_ambiguous(items: DataFrame, shared: DataFrame, excerpt: Column, identifies: Column) -> DataFrame:
    """Items without those that ask who owns an excerpt with several owners."""
    asked = items.withColumn("gram", F.when(identifies, gram_key(excerpt)))
    return asked.join(shared, "gram", "left_anti").drop("gram")


def informative_excerpt(notes: Column) -> Column:
    """At least four notes and three distinct pitches."""
    pitches = F.transform(notes, lambda x: x["pitch"])
    return (F.size(notes) >= 4) & (F.size(F.array_distinct(pitches)) >= 3)


def highest_in_excerpt(notes: Column) -> Column:
    """Token of the highest note; equal pitches go to the greater token."""
    return F.array_max(notes)["token"]


def other_tokens(notes: Column) -> Column:
    """Distinct tokens of the excerpt but the highest."""
    toks = F.transform(notes, lambda x: x["token"])
    return F.array_except(toks, F.array(highest_in_excerpt(notes)))
