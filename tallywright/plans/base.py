"""Stand-ins shared by several queries, each with its SQL twin.

Free-form items come from `part` (title, maker, kind, size), replies are drawn
by hash so that both engines build the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.hashing import seeded_number
from tallywright.functions.text import once
from tallywright.operators.ranking import deal
from tallywright.plans.registry import load
from tallywright.plans.sqlkit import number

KINDS = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]


def qa_items(spark: SparkSession, sf: str) -> DataFrame:
    """Three items per part; parts of every tenth size state no maker.

    Parts are dealt by key before they become items and replies: a small file would be one task to the end.
    """
    part = deal(load(spark, sf, "part"), "p_partkey")
    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey"))
    blank = F.col("p_size") % 10 == 0
    rows = F.array(
        F.struct(
            F.lit(0).alias("slot"),
            F.when(blank, F.lit("maker_abstain")).otherwise(F.lit("maker")).alias("category"),
            F.concat(F.lit("Who makes "), title, F.lit("?")).alias("question"),
            F.when(blank, F.concat(F.lit("The sheet names no maker of "), title, F.lit(".")))
            .otherwise(F.col("p_brand"))
            .alias("answer"),
        ),
        F.struct(
            F.lit(1).alias("slot"),
            F.lit("kind").alias("category"),
            F.concat(F.lit("Of what kind is "), title, F.lit("?")).alias("question"),
            F.col("p_type").alias("answer"),
        ),
        F.struct(
            F.lit(2).alias("slot"),
            F.lit("hitung_bar").alias("category"),
            F.concat(F.lit("What size is "), title, F.lit("?")).alias("question"),
            F.col("p_size").cast("string").alias("answer"),
        ),
    )
    return (
        part.select(F.col("p_partkey").alias("rec_id"), F.explode(rows).alias("x"))
        .select("rec_id", "x.*")
        .select(
            (F.col("rec_id") * 3 + F.col("slot")).alias("item_id"),
            "rec_id",
            "category",
            "question",
            "answer",
        )
    )


QA_SQL = """
SELECT p_partkey * 3 AS item_id, p_partkey AS rec_id,
       CASE WHEN p_size % 10 = 0 THEN 'maker_abstain' ELSE 'maker' END AS category,
       'Who makes ' || p_name || ' ' || p_partkey || '?' AS question,
       CASE WHEN p_size % 10 = 0 THEN 'The sheet names no maker of ' || p_name || ' ' || p_partkey || '.'
            ELSE p_brand END AS answer
FROM part
UNION ALL
SELECT p_partkey * 3 + 1, p_partkey, 'kind', 'Of what kind is ' || p_name || ' ' || p_partkey || '?', p_type FROM part
UNION ALL
SELECT p_partkey * 3 + 2, p_partkey, 'hitung_bar', 'What size is ' || p_name || ' ' || p_partkey || '?',
       CAST(p_size AS VARCHAR) FROM part
"""

# share of right replies per run, out of ten
RUNS = {"base": 2, "s1": 6, "s2": 7}


def predictions(spark: SparkSession, sf: str, runs: dict[str, int] = RUNS) -> DataFrame:
    """One reply per run and item: right, wrapped, hedged, refused or wrong.

    Draws, the rival and the reply are each worked out once a row: put at every mention they made code beyond what the
    compiler takes.
    """
    items = qa_items(spark, sf)
    table = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("skill")) for r, k in runs.items()])
    rows = items.withColumn("r", F.explode(table)).select("*", "r.*").drop("r")
    draw = lambda seed: seeded_number(seed, F.col("run"), F.col("item_id")).alias(seed)
    rows = rows.withColumn("d", once(F.struct(draw("luck"), draw("form"), draw("rival"))))
    luck, form, rival = F.col("d.luck") % 10, F.col("d.form") % 5, F.col("d.rival")
    spelled = (
        F.when(
            F.startswith("category", F.lit("maker")),
            F.concat(F.lit("Brand#"), 1 + rival % 25),
        )
        .when(
            F.col("category") == "kind",
            F.element_at(
                F.array(*[F.lit(k) for k in KINDS]),
                (1 + rival % len(KINDS)).cast("int"),
            ),
        )
        .otherwise((1 + rival % 50).cast("string"))
    )
    rows, other = rows.withColumn("other", once(spelled)), F.col("other")
    gold = F.when(F.col("category") == "maker_abstain", F.lit("Maaf, tidak diketahui.")).otherwise(F.col("answer"))
    right = (
        F.when(form == 0, F.col("answer"))
        .when(form == 1, F.concat(F.lit("The answer is "), gold, F.lit(".")))
        .when(form == 2, F.concat(F.lit("<think>maybe "), other, F.lit("</think> "), F.upper(gold)))
        .when(form == 3, F.concat(F.lit("**"), gold, F.lit("**")))
        .otherwise(F.concat(gold, F.lit(", I think")))
    )
    wrong = (
        F.when(form == 0, other)
        .when(form == 1, F.concat(gold, F.lit(" atau "), other))
        .when(form == 2, F.concat(F.lit("Maaf, tidak diketahui. "), other))
        .when(form == 3, F.concat(F.lit("<think>"), gold))
        .otherwise(F.concat(F.lit("Perhaps "), other, F.lit(" 99")))
    )
    return rows.select(
        "run",
        "item_id",
        "rec_id",
        "category",
        "question",
        "answer",
        once(F.when(luck < F.col("skill"), right).otherwise(wrong)).alias("reply"),
    )


_RUN_ROWS = ", ".join(f"('{r}', {k})" for r, k in RUNS.items())
_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
PRED_SQL = f"""
SELECT run, item_id, rec_id, category, question, answer,
       CASE WHEN luck < skill THEN
         CASE form WHEN 0 THEN answer WHEN 1 THEN 'The answer is ' || gold || '.'
              WHEN 2 THEN '<think>maybe ' || other || '</think> ' || upper(gold)
              WHEN 3 THEN '**' || gold || '**' ELSE gold || ', I think' END
       ELSE
         CASE form WHEN 0 THEN other WHEN 1 THEN gold || ' atau ' || other
              WHEN 2 THEN 'Maaf, tidak diketahui. ' || other WHEN 3 THEN '<think>' || gold
              ELSE 'Perhaps ' || other || ' 99' END
       END AS reply
FROM (
  SELECT *, {number('luck', 'run', 'item_id')} % 10 AS luck, {number('form', 'run', 'item_id')} % 5 AS form,
    CASE WHEN starts_with(category, 'maker') THEN 'Brand#' || (1 + {number('rival', 'run', 'item_id')} % 25)
         WHEN category = 'kind' THEN {_KIND_LIST}[CAST(1 + {number('rival', 'run', 'item_id')} % {len(KINDS)} AS INT)]
         ELSE CAST(1 + {number('rival', 'run', 'item_id')} % 50 AS VARCHAR) END AS other,
    CASE WHEN category = 'maker_abstain' THEN 'Maaf, tidak diketahui.' ELSE answer END AS gold
  FROM ({QA_SQL}) q, (VALUES {_RUN_ROWS}) r(run, skill)
) t
"""
