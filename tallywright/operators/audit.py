"""Benchmark audit: each check returns its violations.

Checks look inside one item row where they can; only whole-set questions
aggregate. Levels: FAIL, REVIEW.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import gram_key
from tallywright.functions.text import norm_loose, once, quoted_part
from tallywright.operators.excerpts import sliding_excerpts
from tallywright.operators.ranking import join_null_safe, merged

N_OPTIONS = 5
CHANCE = 1 / N_OPTIONS


def trimmed_values(options: Column) -> Column:
    return F.transform(F.map_values(options), lambda v: F.trim(v))


def answer_text(items: DataFrame) -> Column:
    return F.trim(F.coalesce(F.try_element_at("options", F.col("key")), F.lit("")))


def exact_option_count(items: DataFrame, n: int = N_OPTIONS) -> DataFrame:
    return items.where(F.size("options") != n).select("uid", F.size("options").cast("bigint").alias("n_options"))


def empty_option(items: DataFrame) -> DataFrame:
    return items.select("uid", F.explode("options").alias("letter", "text")).where(F.trim("text") == "").select("uid", "letter")


def key_in_options(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce(F.map_contains_key("options", F.col("key")), F.lit(False))).select("uid", "key")


def identical_options(items: DataFrame) -> DataFrame:
    values = trimmed_values(F.col("options"))
    return items.where(F.size(F.array_distinct(values)) < F.size(values)).select("uid", "category")


def alias_options(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items with two options that name one entity; aliases: text, entity."""
    rows = items.select("uid", "category", F.explode("options").alias("letter", "text")).withColumn("text", F.trim("text"))
    named = join_null_safe(rows, aliases, ["text"], "left")
    entity = F.coalesce(F.concat(F.lit("e"), F.col("entity").cast("string")), F.concat(F.lit("t"), "text"))
    return (
        named.groupBy("uid", "category")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct(entity).alias("d"))
        .where("d < n")
        .select("uid", "category")
    )


def nested_options(items: DataFrame) -> DataFrame:
    """Items where one option's text lies inside another's."""
    values = trimmed_values(F.col("options"))
    inside = F.exists(
        values,
        lambda a: (a != "")
        & F.exists(values, lambda b: (b != "") & (a != b) & F.contains(F.lower(b), F.lower(a))),
    )
    return items.where(inside).select("uid", "category")


def key_in_quote(items: DataFrame, harmless: Sequence[str] = ("cloze",)) -> DataFrame:
    """Answers longer than three characters that the quoted part already shows."""
    answer = answer_text(items)
    read = items.withColumn("__a", once(F.struct(F.length(answer).alias("n"), norm_loose(answer).alias("flat"))))
    flat = F.col("__a.flat")
    shown = (F.col("__a.n") > 3) & (flat != "") & F.contains(norm_loose(quoted_part(F.col("question"))), flat)
    level = F.when(F.col("category").isin(list(harmless)), F.lit("REVIEW")).otherwise(F.lit("FAIL"))
    return read.where(shown).select("uid", "category", level.alias("level"))


def shape_cue(items: DataFrame) -> DataFrame:
    """(cue, share, level): can the key be guessed from length or capitals?"""
    entries = F.transform(
        F.map_entries("options"), lambda e: F.struct(F.length(e["value"]).alias("n"), e["key"].alias("k"))
    )
    upper = lambda c: F.trim(c).rlike(r"^\p{Lu}")
    others = F.filter(F.map_entries("options"), lambda e: e["key"] != F.col("key"))
    per = items.select(
        (F.array_min(entries)["k"] == F.col("key")).alias("short"),
        (F.array_max(entries)["k"] == F.col("key")).alias("long"),
        upper(answer_text(items)).alias("key_upper"),
        F.size(F.filter(others, lambda e: upper(e["value"]))).alias("other_upper"),
        F.size(others).alias("others"),
    )
    stats = per.agg(
        F.avg(F.col("short").cast("int")).alias("short"),
        F.avg(F.col("long").cast("int")).alias("long"),
        F.avg(F.col("key_upper").cast("int")).alias("ku"),
        (F.sum("other_upper") / F.sum("others")).alias("ou"),
    )
    bad = F.greatest("short", "long") > CHANCE + 0.05
    gap = F.abs(F.col("ku") - F.col("ou"))
    level = lambda b: F.when(b, F.lit("FAIL")).otherwise(F.lit("ok"))
    rows = F.array(
        F.struct(F.lit("shortest option").alias("cue"), F.col("short").alias("share"), level(bad).alias("level")),
        F.struct(F.lit("longest option").alias("cue"), F.col("long").alias("share"), level(bad).alias("level")),
        F.struct(F.lit("capital gap").alias("cue"), gap.alias("share"), level(gap > 0.10).alias("level")),
    )
    return stats.select(F.explode(rows).alias("r")).select("r.cue", F.round("r.share", 6).alias("share"), "r.level")


def letter_spread(items: DataFrame) -> DataFrame:
    """(letter, n, share, level): key letters off an even spread by five points."""
    counts = items.groupBy(F.col("key").alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    share = F.col("n") / totals.select("t").scalar()
    off = F.abs(share - 1 / totals.select("k").scalar()) > 0.05
    return counts.select(
        "letter", "n", F.round(share, 6).alias("share"), F.when(off, F.lit("REVIEW")).otherwise(F.lit("ok")).alias("level")
    )


def answer_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category", answer_text(items).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def narrow_answer_space(items: DataFrame) -> DataFrame:
    """Categories with three answers or fewer, or one answer above 75 percent."""
    per = answer_counts(items).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_answers"), F.max("n").alias("top"), F.sum("n").alias("n_items")
    )
    return per.where((F.col("n_answers") <= 3) | (F.col("top") / F.col("n_items") > 0.75)).select(
        "category", "n_answers", "n_items", F.round(F.col("top") / F.col("n_items"), 6).alias("top_share")
    )


def repeated_question(items: DataFrame, question: str = "question") -> DataFrame:
    """(digest, n): normalised questions asked more than once."""
    return (
        items.groupBy(F.md5(norm_loose(F.col(question))).alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def inferred_source_used(items: DataFrame, sources: DataFrame, category: str, printed: str = "printed") -> DataFrame:
    """Items of the category whose record's value was inferred; sources: record, source."""
    asked = items.where(F.col("category") == category)
    joined = join_null_safe(asked, sources, ["record"], "left")
    return joined.where(~F.col("source").eqNullSafe(F.lit(printed))).select("uid", "record")


def ambiguous_title_option(items: DataFrame, titles: DataFrame) -> DataFrame:
    """Items with an option that several records are titled; titles: record, title."""
    shared = titles.groupBy(F.col("title").alias("text")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text")
    rows = items.select("uid", "category", F.explode("options").alias("letter", "raw")).withColumn("text", F.trim("raw"))
    return rows.join(shared, "text", "left_semi").select("uid", "category").distinct()


def key_matches_master(items: DataFrame, master: DataFrame) -> DataFrame:
    """Fact keys unlike the master value; master: record, category, value as shown."""
    joined = items.withColumn("answer", answer_text(items)).join(merged(master), ["record", "category"])
    return joined.where((F.trim("value") != "") & (norm_loose(F.col("answer")) != norm_loose(F.col("value")))).select(
        "uid", "answer", "value"
    )


def split_leak(train: DataFrame, test: DataFrame, record: str) -> DataFrame:
    return train.select(record).intersect(test.select(record))


def audit_summary(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(check, n, level): violations per check, ok where there are none."""
    out = None
    for name, (level, violations) in checks.items():
        row = violations.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("check"), "n", F.when(F.col("n") > 0, F.lit(level)).otherwise(F.lit("ok")).alias("level")
        )
        out = row if out is None else out.unionByName(row)
    return out


def canary_scan(corpus: DataFrame, text: str, canary: str) -> DataFrame:
    """Corpus rows that hold the canary string."""
    return corpus.where(F.contains(F.col(text), F.lit(canary)))


def gram_rows(df: DataFrame, key: str, words: str, n: int) -> DataFrame:
    """(key, gram): distinct n-word grams of each row, over the whole text."""
    grams = sliding_excerpts(df.select(key, F.col(words).alias("__ws")), "__ws", [n])
    return grams.select(key, gram_key(F.col("excerpt")).alias("gram")).distinct()


def contaminated_documents(corpus: DataFrame, corpus_key: str, items: DataFrame, item_key: str, words: str, n: int) -> DataFrame:
    """(corpus_key, n_shared): corpus rows with n-word grams of the question set.

    Rows are never paired with items: each side meets the other's distinct
    grams, so a passage copied everywhere costs one lookup per copy.
    """
    asked = gram_rows(items, item_key, words, n).select("gram").distinct()
    held = gram_rows(corpus, corpus_key, words, n).join(asked, "gram", "left_semi")
    return held.groupBy(corpus_key).agg(F.count(F.lit(1)).alias("n_shared"))


def contaminated_items(corpus: DataFrame, corpus_key: str, items: DataFrame, item_key: str, words: str, n: int) -> DataFrame:
    """(item_key, n_grams, n_found): how much of each item the corpus holds."""
    asked = gram_rows(items, item_key, words, n)
    wanted = asked.select("gram").distinct()
    grams = sliding_excerpts(corpus.select(F.col(words).alias("__ws")), "__ws", [n])
    held = grams.select(gram_key(F.col("excerpt")).alias("gram")).join(wanted, "gram", "left_semi").distinct()
    return (
        asked.join(held.withColumn("found", F.lit(1)), "gram", "left")
        .groupBy(item_key)
        .agg(F.count(F.lit(1)).alias("n_grams"), F.count("found").alias("n_found"))
    )


def prompt_builder_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], prompt: str) -> DataFrame:
    """Keys whose two renderings differ, or that one builder lacks."""
    left = a.select(*keys, F.col(prompt).alias("a"))
    right = b.select(*keys, F.col(prompt).alias("b"))
    return left.join(right, list(keys), "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)
