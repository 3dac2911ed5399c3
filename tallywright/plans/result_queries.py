"""Queries for leaderboards and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions.hashing import seeded_number
from tallywright.functions.labels import parse_run_label
from tallywright.functions.text import once
from tallywright.operators import results, scoring
from tallywright.operators.ranking import deal
from tallywright.plans.choice_queries import MC_SQL, audited, mc_items
from tallywright.plans.item_queries import REC, records
from tallywright.plans.registry import load, query
from tallywright.plans.scoring_queries import MCS, scored_choices
from tallywright.plans.sqlkit import number

# run name -> right answers per hundred, over the items of `part`
RUNS = {
    "kontrol-konstan": 30, "kontrol-prior": 34, "alpha-base-peluang-opsi": 25, "alpha-full-s1-peluang-opsi": 62,
    "alpha-full-s2-peluang-opsi": 58, "alpha-full-s3-r8-peluang-opsi": 45, "beta-base-peluang-opsi": 41, "beta-base": 47,
}
CATEGORIES = ["maker", "kind", "size", "odd"]
GROUPS = {"maker": "facts", "kind": "facts", "size": "numbers", "never": "empty"}
_ROWS = ", ".join(f"('{r}', {k})" for r, k in RUNS.items())
_CATS = ", ".join(f"('{c}')" for c in CATEGORIES)
HITS = f"""hits AS (SELECT run, category, p_partkey, CASE WHEN {number('hit', 'run', 'category', 'p_partkey')} % 100 < skill + p_size % 7 THEN 1 ELSE 0 END AS lenient,
  CASE WHEN {number('hit', 'run', 'category', 'p_partkey')} % 100 < skill - 5 THEN 1 ELSE 0 END AS strict FROM part, (VALUES {_ROWS}) r(run, skill), (VALUES {_CATS}) c(category)),
tl AS (SELECT run, category, count(*) AS n, CAST(sum(strict) AS BIGINT) AS strict, CAST(sum(lenient) AS BIGINT) AS lenient FROM hits GROUP BY run, category),
board AS (SELECT run, sum(lenient) / sum(n) * 100 AS overall FROM tl GROUP BY run),
lab AS (SELECT run, overall, CASE WHEN starts_with(run, 'kontrol-') THEN substr(run, 9) WHEN contains(run, '-r8') THEN 'alpha [r8]' ELSE split_part(run, '-', 1) END AS model,
  CASE WHEN starts_with(run, 'kontrol-') THEN 'control' WHEN contains(run, '-base') THEN 'base' ELSE 'trained' END AS kind, CASE WHEN ends_with(run, 'peluang-opsi') THEN 'peluang-opsi' ELSE '' END AS method FROM board)"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Item-level scores of every run and category; parts are dealt by key before they become 32 rows each."""
    part = deal(load(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("skill")) for r, k in RUNS.items()])
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    rows = part.select("p_partkey", "p_size", F.explode(runs).alias("r")).select(
        "p_partkey", "p_size", "r.*", F.explode(cats).alias("category")
    )
    luck = F.col("luck")
    return rows.withColumn("luck", seeded_number("hit", F.col("run"), F.col("category"), F.col("p_partkey")) % 100).select(
        "run", "category", "p_partkey", (luck < F.col("skill") + F.col("p_size") % 7).cast("bigint").alias("lenient"),
        (luck < F.col("skill") - 5).cast("bigint").alias("strict"),
    )


def tally(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.tally(hits(spark, sf)).where("category is not null")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUPS.items()), "category string, skill string")


def board(spark: SparkSession, sf: str) -> DataFrame:
    acc = tally(spark, sf).groupBy("run").agg((F.sum("lenient") / F.sum("n") * 100).alias("overall"))
    # once: a filter on the label would be moved below the sums and read the label of every item
    return acc.select("run", "overall", once(parse_run_label(F.concat("run", F.lit("--mc.jsonl")))).alias("l")).select(
        "run", "overall", "l.model", "l.kind", "l.method"
    )


_SKILL = f"""sk AS (SELECT run, s AS skill, n, hits, CASE WHEN n > 0 THEN round(hits / n * 100, 6) END AS accuracy FROM (SELECT b.run, z.s, coalesce(sum(n), 0) AS n, coalesce(sum(lenient), 0) AS hits
  FROM board b, (VALUES ('facts'), ('numbers'), ('empty'), ('overall')) z(s) LEFT JOIN tl ON tl.run = b.run AND (z.s = 'overall' OR z.s = CASE category WHEN 'maker' THEN 'facts' WHEN 'kind' THEN 'facts' WHEN 'size' THEN 'numbers' END) GROUP BY b.run, z.s))"""


@query("skill_group_accuracy", f"WITH {HITS}, {_SKILL} SELECT run, skill, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, accuracy FROM sk")
def skill_group_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return results.skill_group_accuracy(tally(spark, sf), "run", groups(spark))


@query(
    "publish_wide",
    f"""WITH {HITS}, {_SKILL} SELECT run, max(accuracy) FILTER (skill = 'facts') AS facts, max(accuracy) FILTER (skill = 'numbers') AS numbers, max(accuracy) FILTER (skill = 'empty') AS empty,
    max(accuracy) FILTER (skill = 'overall') AS overall FROM sk GROUP BY run""",
)
def publish_wide(spark: SparkSession, sf: str) -> DataFrame:
    return results.publish_wide(skill_group_accuracy(spark, sf), "run", ["facts", "numbers", "empty", "overall"])


@query(
    "banded_ranking",
    f"""WITH {HITS} SELECT run, kind, CAST(CASE kind WHEN 'control' THEN 1 WHEN 'base' THEN 2 ELSE 3 END AS BIGINT) AS band, row_number() OVER (PARTITION BY kind ORDER BY overall DESC, run) AS place, round(overall, 6) AS overall FROM lab""",
)
def banded_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return results.banded_ranking(board(spark, sf), "kind", "overall", "run").select(
        "run", "kind", "band", "place", F.round("overall", 6).alias("overall")
    )


@query(
    "below_floor_flag",
    f"WITH {HITS}, f AS (SELECT max(overall) AS f FROM lab WHERE kind = 'control' AND model = 'prior') SELECT run, round(f, 6) AS floor, kind <> 'control' AND overall < f AS below_floor FROM lab, f",
)
def below_floor_flag(spark: SparkSession, sf: str) -> DataFrame:
    return results.below_floor_flag(board(spark, sf), "model", "kind", "overall", "prior").select(
        "run", F.round("floor", 6).alias("floor"), "below_floor"
    )


@query("one_method_only", f"WITH {HITS} SELECT run, model, kind, method FROM lab WHERE method = 'peluang-opsi' OR kind = 'control'")
def one_method_only(spark: SparkSession, sf: str) -> DataFrame:
    return results.one_method_only(board(spark, sf), "kind", "method", "peluang-opsi").select("run", "model", "kind", "method")


BASE, S1, CONST = "alpha-base-peluang-opsi", "alpha-full-s1-peluang-opsi", "kontrol-konstan"
S2 = "alpha-full-s2-peluang-opsi"


@query(
    "compare_runs",
    f"""WITH {HITS}, x AS (SELECT category, sum(n) FILTER (run = '{S2}') AS n, sum(lenient) FILTER (run = '{S1}') AS a, sum(lenient) FILTER (run = '{S2}') AS b, grouping(category) AS g FROM tl GROUP BY ROLLUP (category))
    SELECT category, CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS first_hits, CAST(b AS BIGINT) AS last_hits, CAST(b - a AS BIGINT) AS diff_items, round((b - a) / n * 100, 6) AS diff_points,
    CASE WHEN a = b THEN 'unchanged' WHEN abs(b - a) < 7 THEN 'small' ELSE 'large' END AS size, row_number() OVER (PARTITION BY g ORDER BY abs(round((b - a) / n * 100, 6)) DESC, category) AS place FROM x""",
)
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return results.compare_runs(tally(spark, sf), "run", S1, S2)


_WAYS = f"""w AS (SELECT category, max(n) AS n, sum(lenient / n * 100) FILTER (run = '{BASE}') AS base, sum(lenient / n * 100) FILTER (run = '{CONST}') AS constant, sum(lenient / n * 100) FILTER (run = '{S1}') AS trained,
  sum(strict / n * 100) FILTER (run = '{S1}') AS strict FROM tl GROUP BY category)"""


@query(
    "gain_decomposition",
    f"""WITH {HITS}, {_WAYS} SELECT category, round(base, 6) AS base, round(constant, 6) AS constant, round(trained, 6) AS trained, round(trained - constant, 6) AS gain,
    CASE WHEN abs(trained - constant) < 1 THEN 'illusory' WHEN trained - constant > 10 THEN 'up' WHEN trained - constant < -5 THEN 'down' ELSE '' END AS verdict FROM w""",
)
def gain_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    return results.gain_decomposition(tally(spark, sf), "run", BASE, CONST, S1)


@query(
    "before_after_by_category",
    f"WITH {HITS}, {_WAYS} SELECT category, n, round(base, 6) AS base, round(trained, 6) AS trained, round(constant, 6) AS constant, round(strict, 6) AS strict FROM w",
)
def before_after_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return results.before_after_by_category(tally(spark, sf), "run", BASE, CONST, S1)


@query(
    "model_mean_range",
    f"WITH {HITS} SELECT model, kind, count(*) AS n_runs, round(avg(overall), 6) AS mean, round(min(overall), 6) AS least, round(max(overall), 6) AS greatest, kind = 'control' AS is_floor FROM lab GROUP BY model, kind",
)
def model_mean_range(spark: SparkSession, sf: str) -> DataFrame:
    return results.model_mean_range(board(spark, sf), "model", "kind", "overall")


@query(
    "seed_spread",
    "SELECT user_id, event_type, count(*) AS n_runs, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id, event_type HAVING count(*) >= 2",
)
def seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    return results.seed_spread(load(spark, sf, "events"), "user_id", "event_type", "value")


@query(
    "run_cost_table",
    """WITH r AS (SELECT user_id AS run_id, CASE user_id % 3 WHEN 0 THEN 'L4' WHEN 1 THEN 'L40S' ELSE 'X1' END AS card, CAST(sum(event_id) AS DOUBLE) AS seconds, count(*) AS steps FROM events GROUP BY user_id),
    e AS (SELECT user_id AS run_id, event_id AS epoch, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn FROM events WHERE event_type = 'error'),
    p AS (SELECT r.*, CASE card WHEN 'L4' THEN 0.8 WHEN 'L40S' THEN 1.95 ELSE 0 END AS rate, epoch, loss FROM r LEFT JOIN e ON e.run_id = r.run_id AND rn = 1)
    SELECT run_id, CAST(sum(steps) AS BIGINT) AS steps, round(sum(seconds) / 60, 4) AS minutes, round(sum(seconds * rate) / 3600, 3) AS usd, CASE WHEN grouping(run_id) = 0 THEN max(epoch) END AS best_epoch, CASE WHEN grouping(run_id) = 0 THEN max(loss) END AS best_loss
    FROM p GROUP BY GROUPING SETS ((run_id), ())""",
)
def run_cost_table(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    k = F.col("user_id") % 3
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(
        F.when(F.col("user_id") % 3 == 0, F.lit("L4")).when(F.col("user_id") % 3 == 1, F.lit("L40S")).otherwise(F.lit("X1")).alias("card"),
        F.sum("event_id").cast("double").alias("seconds"), F.count(F.lit(1)).alias("steps"),
    )
    evaluations = e.where("event_type = 'error'").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    rates = e.where(k < 2).select(
        F.when(k == 0, F.lit("L4")).otherwise(F.lit("L40S")).alias("card"), F.when(k == 0, F.lit(0.8)).otherwise(F.lit(1.95)).alias("usd_per_hour")
    ).distinct()
    return results.run_cost_table(runs, evaluations, rates)


@query(
    "checkpoint_curve",
    f"""WITH {HITS}, s AS (SELECT run, CASE run WHEN '{BASE}' THEN 0 WHEN '{S1}' THEN 100 WHEN '{S2}' THEN 200 END AS step, 100 * sum(lenient) FILTER (category = 'maker') / sum(n) FILTER (category = 'maker') AS maker, 100 * sum(lenient) FILTER (category = 'kind') / sum(n) FILTER (category = 'kind') AS kind FROM tl GROUP BY run)
    SELECT run, CAST(step AS BIGINT) AS step, 'maker' AS metric, round(maker, 6) AS value FROM s WHERE step IS NOT NULL UNION ALL SELECT run, step, 'kind', round(kind, 6) FROM s WHERE step IS NOT NULL""",
)
def checkpoint_curve(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda c: F.round(F.sum(F.when(F.col("category") == c, F.col("lenient"))) / F.sum(F.when(F.col("category") == c, F.col("n"))) * 100, 6).alias(c)
    wide = tally(spark, sf).groupBy("run").agg(pick("maker"), pick("kind"))
    steps = spark.createDataFrame([(BASE, 0), (S1, 100), (S2, 200)], "run string, step bigint")
    return results.checkpoint_curve(wide, "run", steps, ["maker", "kind"])


# outside benchmark: documents answered by models under two prompts

_MODELS = {"base": 40, "tuned": 46, "other-a": 30, "other-b": 52}
_MROWS = ", ".join(f"('{m}', {k})" for m, k in _MODELS.items())
EXT = f"""ext AS (SELECT doc_id, lang, source, model, prompt, CASE WHEN {number('ext', 'model', 'prompt', 'doc_id')} % 100 < skill THEN 1 ELSE 0 END AS correct
  FROM documents, (VALUES {_MROWS}) m(model, skill), (VALUES ('own'), ('neutral')) p(prompt) WHERE NOT (model = 'other-a' AND prompt = 'neutral'))"""


def external(spark: SparkSession, sf: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("skill")) for m, k in _MODELS.items()])
    rows = load(spark, sf, "documents").select("doc_id", "lang", "source", F.explode(models).alias("m")).select(
        "doc_id", "lang", "source", "m.*", F.explode(F.array(F.lit("own"), F.lit("neutral"))).alias("prompt")
    )
    luck = seeded_number("ext", F.col("model"), F.col("prompt"), F.col("doc_id")) % 100
    return rows.where("not (model = 'other-a' and prompt = 'neutral')").withColumn("correct", (luck < F.col("skill")).cast("bigint"))


_EACC = "ea AS (SELECT model, prompt, count(*) AS n, avg(correct) * 100 AS a FROM ext GROUP BY model, prompt)"


@query(
    "external_accuracy",
    f"WITH {EXT}, {_EACC} SELECT x.model, x.prompt, x.n, round(x.a, 6) AS accuracy, round(x.a - b.a, 6) AS diff FROM ea x LEFT JOIN ea b ON b.model = 'base' AND b.prompt = x.prompt",
)
def external_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return results.external_accuracy(external(spark, sf), "model", "prompt", "base")


@query(
    "external_axis_delta",
    f"""WITH {EXT}, l AS (SELECT 'lang' AS axis, lang AS value, model, prompt, correct FROM ext UNION ALL SELECT 'source', source, model, prompt, correct FROM ext),
    a AS (SELECT axis, value, model, prompt, count(*) AS n, avg(correct) * 100 AS a FROM l GROUP BY ALL)
    SELECT x.axis, x.value, x.model, x.prompt, x.n, round(x.a, 6) AS accuracy, round(x.a - b.a, 6) AS diff FROM a x LEFT JOIN a b ON b.axis = x.axis AND b.value = x.value AND b.prompt = x.prompt AND b.model = 'base'""",
)
def external_axis_delta(spark: SparkSession, sf: str) -> DataFrame:
    return results.external_axis_delta(external(spark, sf), "model", "prompt", "base", ["lang", "source"])


@query(
    "random_floor",
    f"WITH {MC_SQL}, c AS (SELECT uid, count(*) AS k FROM opt WHERE NOT (record % 40 = 2 AND letter = 'E') GROUP BY uid) SELECT count(*) AS n, round(avg(1 / k), 6) AS floor FROM c",
)
def random_floor(spark: SparkSession, sf: str) -> DataFrame:
    return results.random_floor(audited(spark, sf))


@query(
    "comparison_models",
    f"WITH {EXT}, {_EACC} SELECT model, prompt, n, round(a, 6) AS accuracy, row_number() OVER (ORDER BY round(a, 6) DESC, model, prompt) AS place FROM ea WHERE model NOT IN ('base', 'tuned')",
)
def comparison_models(spark: SparkSession, sf: str) -> DataFrame:
    acc = results.external_accuracy(external(spark, sf), "model", "prompt", "base").drop("diff")
    return results.comparison_models(acc, "model", ["base", "tuned"])


@query(
    "forgetting_slope",
    f"""WITH {EXT}, a AS (SELECT lang, CASE model WHEN 'base' THEN 0 WHEN 'tuned' THEN 1 ELSE 2 END AS stage, avg(correct) * 100 AS a FROM ext WHERE prompt = 'own' AND model <> 'other-a' GROUP BY ALL)
    SELECT lang, CAST(stage AS BIGINT) AS stage, round(a, 6) AS accuracy, round(round(a, 6) - lag(round(a, 6)) OVER (PARTITION BY lang ORDER BY stage), 6) AS change FROM a""",
)
def forgetting_slope(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.col("model") == "base", 0).when(F.col("model") == "tuned", 1).otherwise(2).cast("bigint")
    acc = external(spark, sf).where("prompt = 'own' and model <> 'other-a'").groupBy("lang", stage.alias("stage")).agg(
        F.round(F.avg("correct") * 100, 6).alias("accuracy")
    )
    return results.forgetting_slope(acc, "lang", "stage", "accuracy")


_UM = "(SELECT user_id, avg(value) AS x, CAST(count(*) AS DOUBLE) + avg(event_id % 97) AS y FROM events GROUP BY user_id)"


@query(
    "cross_benchmark_correlation",
    f"""WITH m AS {_UM} SELECT NULL AS left_out, count(*) AS n, round(corr(x, y), 6) AS r FROM m
    UNION ALL SELECT CAST(a.user_id AS VARCHAR), count(*), round(corr(b.x, b.y), 6) FROM m a JOIN m b ON a.user_id <> b.user_id GROUP BY a.user_id""",
)
def cross_benchmark_correlation(spark: SparkSession, sf: str) -> DataFrame:
    models = load(spark, sf, "events").groupBy("user_id").agg(
        F.avg("value").alias("x"), (F.count(F.lit(1)).cast("double") + F.avg(F.col("event_id") % 97)).alias("y")
    )
    return results.cross_benchmark_correlation(models, "user_id", "x", "y")


@query(
    "confusion_matrix",
    f"""WITH {MCS}, t AS (SELECT run, count(*) AS t FROM ms WHERE choice <> '' GROUP BY run) SELECT run, key, {', '.join(f"round(count(*) FILTER (choice = '{x}') / any_value(t) * 100, 6) AS chose_{x}" for x in 'ABCDE')}
    FROM ms JOIN t USING (run) WHERE choice <> '' GROUP BY run, key""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return results.confusion_matrix(scored_choices(spark, sf), "run", list("ABCDE"))


@query(
    "item_difficulty_histogram",
    f"WITH {MCS}, h AS (SELECT s, count(*) AS n FROM (SELECT uid, sum(correct) AS s FROM ms GROUP BY uid) GROUP BY s) SELECT CAST(i AS BIGINT) AS n_right, coalesce(n, 0) AS n_items FROM (SELECT unnest(range(4)) AS i) LEFT JOIN h ON s = i",
)
def item_difficulty_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return results.item_difficulty_histogram(scored_choices(spark, sf), "uid", "run")


_LONG = """long AS (SELECT model, 'overall' AS metric, max(overall) AS value FROM lab GROUP BY model UNION ALL
  SELECT CASE model WHEN 'base' THEN 'alpha' WHEN 'tuned' THEN 'beta' ELSE model END, 'overall', 1.0 FROM ext GROUP BY model UNION ALL
  SELECT CASE model WHEN 'base' THEN 'alpha' WHEN 'tuned' THEN 'beta' ELSE model END, 'external', avg(correct) * 100 FROM ext WHERE prompt = 'neutral' GROUP BY model),
mg AS (SELECT model, metric, max(value) AS value FROM long GROUP BY model, metric)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    own = board(spark, sf).groupBy("model").agg(F.max("overall").alias("value")).withColumn("metric", F.lit("overall"))
    ext = external(spark, sf)
    name = F.when(F.col("model") == "base", F.lit("alpha")).when(F.col("model") == "tuned", F.lit("beta")).otherwise(F.col("model"))
    fallback = ext.select(name.alias("model"), F.lit("overall").alias("metric"), F.lit(1.0).alias("value")).distinct()
    outside = ext.where("prompt = 'neutral'").groupBy(name.alias("model")).agg((F.avg("correct") * 100).alias("value")).withColumn("metric", F.lit("external"))
    return results.metric_merge([own, fallback, outside], "model")


@query("metric_merge", f"WITH {HITS}, {EXT}, {_LONG} SELECT model, metric, round(value, 6) AS value FROM mg")
def metric_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("model", "metric", F.round("value", 6).alias("value"))


@query(
    "best_per_metric",
    f"WITH {HITS}, {EXT}, {_LONG} SELECT model, metric, round(value, 6) AS value, model NOT IN ('konstan', 'prior') AND value = max(value) FILTER (model NOT IN ('konstan', 'prior')) OVER (PARTITION BY metric) AS best FROM mg",
)
def best_per_metric(spark: SparkSession, sf: str) -> DataFrame:
    controls = board(spark, sf).where("kind = 'control'").select("model")
    return results.best_per_metric(merged(spark, sf), "model", controls).select("model", "metric", F.round("value", 6).alias("value"), "best")


@query(
    "complete_metric_pairs",
    f"""WITH {HITS}, {EXT}, {_LONG} SELECT a.model, round(a.value, 6) AS x, round(b.value, 6) AS y, (SELECT count(DISTINCT model) FROM mg) - (SELECT count(*) FROM (SELECT model FROM mg GROUP BY model HAVING count(*) = 2)) AS n_left_out
    FROM mg a JOIN mg b ON a.model = b.model AND a.metric = 'overall' AND b.metric = 'external'""",
)
def complete_metric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return results.complete_metric_pairs(merged(spark, sf), "model", "overall", "external").select(
        "model", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n_left_out"
    )


_FACTS = """f AS (SELECT 'records' AS name, CAST(count(*) AS VARCHAR) AS value, 'part' AS source FROM part UNION ALL SELECT 'makers', CAST(count(DISTINCT p_brand) AS VARCHAR), 'part' FROM part
  UNION ALL SELECT 'records', CAST(count(*) AS VARCHAR), 'documents' FROM documents UNION ALL SELECT 'texts of ' || lang, CAST(count(*) AS VARCHAR), 'documents' FROM documents GROUP BY lang)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    part, docs = load(spark, sf, "part"), load(spark, sf, "documents")
    n = F.count(F.lit(1)).cast("string")

    def fact(df: DataFrame, name, value, source: str) -> DataFrame:
        return df.agg(value.alias("value")).select(F.lit(name).alias("name"), "value", F.lit(source).alias("source"), F.lit("").alias("note"))

    per_lang = docs.groupBy("lang").agg(n.alias("value")).select(
        F.concat(F.lit("texts of "), "lang").alias("name"), "value", F.lit("documents").alias("source"), F.lit("").alias("note")
    )
    return results.facts_store(
        [fact(part, "records", n, "part"), fact(part, "makers", F.countDistinct("p_brand").cast("string"), "part"), fact(docs, "records", n, "documents"), per_lang]
    )


@query("facts_store", f"WITH {_FACTS} SELECT name, value, source FROM f")
def facts_store(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("name", "value", "source")


@query("fact_conflicts", f"WITH {_FACTS} SELECT name, min(value) AS lo, max(value) AS hi FROM f GROUP BY name HAVING count(DISTINCT value) > 1")
def fact_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return results.fact_conflicts(facts(spark, sf))


@query(
    "completeness_counts",
    """SELECT 'c_name' AS "column", CAST(count(*) FILTER (c_custkey % 9 <> 0) AS BIGINT) AS filled, CAST(count(*) FILTER (c_custkey % 9 = 0) AS BIGINT) AS blank FROM customer
    UNION ALL SELECT 'c_mktsegment', CAST(count(*) FILTER (c_custkey % 4 <> 0) AS BIGINT), CAST(count(*) FILTER (c_custkey % 4 = 0) AS BIGINT) FROM customer UNION ALL SELECT 'c_custkey', count(*), 0 FROM customer""",
)
def completeness_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    cells = c.select("c_custkey", F.when(k % 9 == 0, F.lit(" - ")).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return results.completeness_counts(cells, ["c_name", "c_mktsegment", "c_custkey"])


@query(
    "status_and_page_counts",
    "SELECT lang, min(n_chars) AS least, max(n_chars) AS greatest, count(*) AS n, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS printed, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang",
)
def status_and_page_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(
        F.min("n_chars").alias("least"), F.max("n_chars").alias("greatest"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("quality") == 1).alias("printed"), F.count_if(F.col("quality").isNull()).alias("unlabelled"),
    )


@query(
    "titles_by_owner",
    "SELECT n_name, row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS position, s_name, count(*) OVER (PARTITION BY n_name) AS n_titles FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def titles_by_owner(spark: SparkSession, sf: str) -> DataFrame:
    named = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return results.titles_by_owner(named, "n_name", "s_name")


@query("faceted_search", "SELECT doc_id, lang, source FROM documents WHERE (contains(lower(text), 'eau') OR contains(lower(source), 'eau')) AND lang = 'fr'")
def faceted_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return results.faceted_search(docs, ["text", "source"], "EAU", "fr", "lang").select("doc_id", "lang", "source").orderBy("doc_id")


@query("preview_projection", f"WITH {REC} SELECT doc_id, md5(coalesce(array_to_string(ls[1:4], ' | '), '')) AS preview FROM rec")
def preview_projection(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("doc_id", F.md5(results.preview_bars(F.col("ls"), 4)).alias("preview"))


@query("first_questions", f"WITH {MC_SQL} SELECT uid, key FROM mc ORDER BY record, uid LIMIT 50")
def first_questions(spark: SparkSession, sf: str) -> DataFrame:
    return results.first_rows(mc_items(spark, sf), ["record", "uid"], 50).select("uid", "key")


@query(
    "projected_cost",
    """WITH p AS (SELECT 'NVIDIA ' || CASE user_id % 3 WHEN 0 THEN 'L4' WHEN 1 THEN 'L40S' ELSE 'X1' END || ' #' || user_id AS card, avg(value) AS s FROM events GROUP BY user_id),
    r AS (SELECT card, CASE WHEN contains(card, 'L40S') THEN 1.95 WHEN contains(card, 'L4') THEN 0.8 ELSE 0.0 END AS rate, s * 1875 / 3600 AS h FROM p),
    x AS (SELECT card, CAST(rate AS DOUBLE) AS rate, round(h, 6) AS hours, round(h * rate, 6) AS usd FROM r)
    SELECT *, card = (SELECT card FROM x WHERE rate > 0 ORDER BY usd, card LIMIT 1) AS cheapest FROM x""",
)
def projected_cost(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    k = F.col("user_id") % 3
    kind = F.when(k == 0, F.lit("L4")).when(k == 1, F.lit("L40S")).otherwise(F.lit("X1"))
    probes = e.groupBy(F.concat(F.lit("NVIDIA "), kind, F.lit(" #"), F.col("user_id")).alias("card")).agg(F.avg("value").alias("seconds_per_step"))
    rates = e.where(k < 2).select(kind.alias("key"), F.when(k == 0, F.lit(0.8)).otherwise(F.lit(1.95)).alias("usd_per_hour")).distinct()
    return results.projected_cost(probes, rates, 1875)
