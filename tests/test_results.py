"""Plans and rows behind the leaderboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywright.plans import result_queries


def parts(spark, folder):
    rows = spark.range(60).select(F.col("id").alias("p_partkey"), (F.col("id") % 9).cast("int").alias("p_size"))
    rows.write.parquet(f"{folder}/part.parquet")
    return str(folder)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_labels_are_read_per_run_and_not_per_item(spark, tmp_path):
    board = result_queries.board(spark, parts(spark, tmp_path)).where("kind = 'control' and model = 'prior'")
    assert [r["run"] for r in board.collect()] == ["kontrol-prior"]
    plan = optimized(board)
    below = plan[next(i for i, line in enumerate(plan) if "Aggregate" in line):]
    assert not any("mc.jsonl" in line for line in below)


def test_parts_are_dealt_before_they_become_hits(spark, tmp_path):
    hits = result_queries.hits(spark, parts(spark, tmp_path))
    assert hits.count() == 60 * len(result_queries.RUNS) * len(result_queries.CATEGORIES)
    plan = optimized(hits)
    dealt = next(i for i, line in enumerate(plan) if "Repartition" in line)
    assert dealt > max(i for i, line in enumerate(plan) if "Generate" in line)
