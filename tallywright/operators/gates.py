"""Gates that stop a job: conditions on whole tables that the result depends on.

A gate table has rows (gate, value, passed). `passed()` ties a result to it: the verdict is an aggregate that Spark works
out as a subquery of the result's own plan, and it raises if a gate has not passed, so nothing is printed or written
and the driver needs no step of its own. An empty result is refused as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators import generation, provenance, sampling, scoring


def count_of(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("c")).scalar()


def gate_table(df: DataFrame, *rows: Column) -> DataFrame:
    """(gate, value, passed) rows out of structs made by sampling.gate."""
    return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def refusals(gates: DataFrame) -> DataFrame:
    """One row with the sorted names and values of the gates that have not passed; a gate that says NULL has not."""
    named = F.concat(F.col("gate"), F.lit(": "), F.coalesce(F.col("value").cast("string"), F.lit("unknown")))
    return gates.agg(F.array_sort(F.collect_list(F.when(~F.coalesce("passed", F.lit(False)), named))).alias("broken"))


def verdict(gates: DataFrame) -> Column:
    """True, or the job fails with the refusals."""
    broken = F.col("broken")
    said = F.raise_error(F.concat(F.lit("refused: "), F.array_join(broken, "; "))).cast("boolean")
    return refusals(gates).select(F.when(F.size(broken) > 0, said).otherwise(F.lit(True)).alias("ok")).scalar()


def passed(df: DataFrame, *gates: DataFrame) -> DataFrame:
    """df, if all gates of all tables have passed."""
    for table in gates:
        df = df.where(verdict(table))
    return df


def build_gate(headers: DataFrame, manifest: DataFrame, missing_is_fatal: bool) -> DataFrame:
    """Do all prediction files answer the current build of their question file?"""
    status = provenance.build_status(headers, manifest, missing_is_fatal)
    refused = count_of(status.where(F.startswith("status", F.lit("refused"))))
    return gate_table(headers, sampling.gate("files of another build", refused, refused == 0))


def matched_gate(preds: DataFrame, keys: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Has every prediction a key? A short file is fine, an unmatched prediction means another build."""
    lost = scoring.unmatched_gate(preds, keys, slot).select("n_unmatched").scalar()
    return gate_table(preds, sampling.gate("predictions without a key", lost, lost == 0))


def complete_gate(preds: DataFrame, items: DataFrame, run: str, key: str) -> DataFrame:
    """Has every run answered every item? An answer to something else doesn't count."""
    short = count_of(preds.select(run).distinct().join(scoring.completeness_gate(preds, items, run, key).where("complete"), run, "left_anti"))
    return gate_table(preds, sampling.gate("runs that miss items", short, short == 0))


def order_gate(preds: DataFrame, keys: DataFrame, slot: Sequence[str], order: str) -> DataFrame:
    """Do predictions that are matched by position stand in the keys' order?"""
    alarm = scoring.order_alarm(preds, keys, slot, order).select(F.when(F.col("alarm"), F.col("n_moved")).otherwise(F.lit(0)).alias("n")).scalar()
    return gate_table(preds, sampling.gate("predictions in another order", alarm, alarm == 0))


def template_gate(templates: DataFrame) -> DataFrame:
    """Are the wordings of the two sides apart, whatever sampling has kept of them?"""
    found = generation.template_lint(templates)
    rules = ["train wording on the test side", "wording repeated", "paraphrase equals base"]
    counts = [count_of(found.where(F.col("rule") == r)) for r in rules]
    return gate_table(templates, *[sampling.gate(r, n, n == 0) for r, n in zip(rules, counts, strict=True)])


def checked_sides(
    train: DataFrame, test: DataFrame, reserved: DataFrame, all_records: DataFrame, regime: str, templates: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both sides, if neither their wordings nor their items leak. regime: split or all."""
    leaks = sampling.side_leak_gates(train, test, reserved, all_records, regime)
    words = template_gate(templates)
    return passed(train, leaks, words), passed(test, leaks, words)


def scored_choices(preds: DataFrame, items: DataFrame, headers: DataFrame, manifest: DataFrame, key: str, run: str = "run") -> DataFrame:
    """Choice scores of runs that answer the current build in full; refuses otherwise.

    preds: run, key, reply; items: key, category, options, key letter; headers: file, question_file, sha.
    """
    return passed(scoring.score_choices(preds, items, key), build_gate(headers, manifest, True), complete_gate(preds, items, run, key))
