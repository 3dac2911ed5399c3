"""Exam-style question tables from outside, turned into multiple-choice items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.ranking import join_null_safe


def letter_blob(blob: Column) -> Column:
    """`A. x\\nB. y` as a letter -> text map; a marker counts only at a line start.

    The text of an option may run over several lines. Empty options drop out
    and a letter that comes back keeps its last text.
    """
    marked = F.regexp_replace(F.coalesce(blob, F.lit("")), r"(?m)^([A-E])\.\s?", "\u0001$1\u0002")
    parts = F.filter(
        F.slice(F.split(marked, "\u0001"), 2, 2147483646),
        lambda p: F.regexp_replace(F.substr(p, F.lit(3)), r"^\s+|\s+$", "") != "",
    )
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.substring(p, 1, 1).alias("key"), F.regexp_replace(F.substr(p, F.lit(3)), r"^\s+|\s+$", "").alias("value")
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.lit(2147483646)), lambda o: o["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def list_literal(options: Column) -> Column:
    """`['A. x', "B. it's"]` as a letter -> text map."""
    quoted = F.regexp_extract_all(options, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    texts = F.transform(
        quoted,
        lambda q: F.trim(F.regexp_replace(F.regexp_replace(F.substr(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"), r"\s+$", "")),
    )
    good = F.filter(texts, lambda t: t.rlike(r"^[A-E]\.\s?"))
    return F.map_from_entries(
        F.transform(
            good,
            lambda t: F.struct(
                F.substring(t, 1, 1).alias("key"), F.trim(F.regexp_replace(t, r"^[A-E]\.\s?", "")).alias("value")
            ),
        )
    )


def classify_exam_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every input row with its options and the reason it is dropped ('' = kept).

    rows: id, is_for_fewshot, blob, key, subject, level, question;
    groups: subject, subject_group, a table with one row per subject.
    """
    parsed = rows.select(
        "id",
        "is_for_fewshot",
        F.trim("subject").alias("subject"),
        F.trim("level").alias("level"),
        F.trim("question").alias("question"),
        letter_blob(F.col("blob")).alias("options"),
        "key",
    )
    joined = join_null_safe(parsed, groups.select("subject", "subject_group"), ["subject"], "left")
    reason = (
        F.when(F.col("is_for_fewshot") == "1", F.lit("few-shot example"))
        .when(~F.coalesce(F.map_contains_key("options", F.col("key")), F.lit(False)), F.lit("key not in options"))
        .when(F.col("subject_group").isNull(), F.lit("unknown subject"))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("reason", reason)


def classify_literal_rows(rows: DataFrame) -> DataFrame:
    """The same for rows with a list literal; the flag sets the difficulty level.

    rows: id, options_text, key, topic, is_specific, province, context.
    """
    options = list_literal(F.col("options_text"))
    parsed = rows.select(
        "id",
        F.trim("topic").alias("category"),
        F.when(F.col("is_specific") == "True", F.lit("province")).otherwise(F.lit("general")).alias("level"),
        F.trim("province").alias("province"),
        F.trim("context").alias("question"),
        options.alias("options"),
        "key",
    )
    kept = F.coalesce(F.map_contains_key("options", F.col("key")), F.lit(False))
    return parsed.withColumn("reason", F.when(kept, F.lit("")).otherwise(F.lit("key not in options")))


def drop_reasons(classified: DataFrame) -> DataFrame:
    return classified.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
