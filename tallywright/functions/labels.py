"""Run labels, derived classes and chat rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.operators.ranking import join_null_safe

# fixed values: file-name parts of a prediction file
METHOD_SUFFIXES = ["peluang-opsi", "peluang"]
CONTROL_PREFIX = "kontrol-"
BASE_SUFFIX = "-base"
RUN = r"^(.+?)-(?:split70|full14|full)-s(\d+)(?:-(.+))?$"


def parse_run_label(name: Column) -> Column:
    """`<run>--<regime>.jsonl` as struct(model, kind, seed, regime, method).

    kind is control, base or trained. A tag reaches the model name, since two
    arms of an ablation differ by nothing else.
    """
    stem = F.regexp_replace(name, r"\.jsonl$", "")
    regime = F.regexp_extract(stem, r"^.*--(.*)$", 1)
    run = F.regexp_replace(stem, r"^(.*)--.*$", "$1")
    suffix = "|".join(METHOD_SUFFIXES)
    method = F.regexp_extract(run, rf"-({suffix})$", 1)
    core = F.regexp_replace(run, rf"-({suffix})$", "")
    is_control = F.startswith(core, F.lit(CONTROL_PREFIX))
    is_base = F.endswith(core, F.lit(BASE_SUFFIX)) & ~is_control
    matched = core.rlike(RUN) & ~is_control & ~is_base
    tag = F.regexp_extract(core, RUN, 3)
    tagged = F.concat(F.regexp_extract(core, RUN, 1), F.when(tag != "", F.concat(F.lit(" ["), tag, F.lit("]"))).otherwise(F.lit("")))
    model = (
        F.when(is_control, F.regexp_replace(core, f"^{CONTROL_PREFIX}", ""))
        .when(is_base, F.regexp_replace(core, f"{BASE_SUFFIX}$", ""))
        .when(matched, tagged)
        .otherwise(core)
    )
    kind = F.when(is_control, F.lit("control")).when(is_base, F.lit("base")).otherwise(F.lit("trained"))
    seed = F.when(matched, F.regexp_extract(core, RUN, 2).cast("bigint"))
    return F.struct(
        model.alias("model"),
        kind.alias("kind"),
        seed.alias("seed"),
        regime.alias("regime"),
        method.alias("method"),
    )


def parse_external_label(name: Column, dataset: str, strip: list[str]) -> Column:
    """struct(model, prompt) of an external run; `strip` are name parts to drop."""
    stem = F.regexp_replace(name, rf"--{dataset}\.jsonl$", "")
    neutral = F.endswith(stem, F.lit("-netral"))
    core = F.regexp_replace(F.regexp_replace(stem, "-netral$", ""), rf"-({'|'.join(METHOD_SUFFIXES)})$", "")
    for part in strip:
        core = F.replace(core, F.lit(part), F.lit(""))
    return F.struct(core.alias("model"), F.when(neutral, F.lit("neutral")).otherwise(F.lit("own")).alias("prompt"))


def canonicalise_values(df: DataFrame, column: str, spellings: DataFrame) -> DataFrame:
    """Canonical value in `column`, the printed one in `<column>_printed`.

    spellings: printed, canonical ('' means the value is not known).
    """
    table = spellings.select(F.col("printed").alias(f"{column}_printed"), F.col("canonical").alias("__canon"))
    renamed = df.withColumn(f"{column}_printed", F.col(column)).drop(column)
    joined = join_null_safe(renamed, table, [f"{column}_printed"], "left")
    return joined.withColumn(column, F.coalesce("__canon", f"{column}_printed")).drop("__canon")


def render_chat(question: Column, options: Column, system: Column, instruction: str) -> Column:
    """Two-turn message array with the lettered options in letter order."""
    lettered = F.array_join(
        F.transform(
            F.sort_array(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])
        ),
        "\n",
    )
    body = F.concat(question, F.lit("\n\n"), lettered, F.lit(f"\n\n{instruction}"))
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), body.alias("content")),
    )


def split_prompt_completion(messages: Column) -> tuple[Column, Column]:
    n = F.size(messages)
    return F.slice(messages, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(messages, F.greatest(n, F.lit(1)), F.lit(1))


def split_turns(turns: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Turn rows marked prompt or completion; the last turn is the completion.

    Works on rows, so a very long conversation is never gathered in one cell.
    """
    last = turns.groupBy(conversation).agg(F.max(turn).alias("__last"))
    joined = join_null_safe(turns, last, [conversation], "left")
    return joined.withColumn(
        "part", F.when(F.col(turn) == F.col("__last"), F.lit("completion")).otherwise(F.lit("prompt"))
    ).drop("__last")


def contract_check(rules: Sequence[tuple[str, Column]]) -> Column:
    """Array of the names of the broken rules of a record, in rule order."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])
    return F.filter(broken, lambda m: m.isNotNull())
