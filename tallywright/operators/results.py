"""Leaderboards, comparisons and other tables over scored runs.

Item-level input is aggregated first; what follows works on one row per run,
category or metric, so its windows and pivots stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.ranking import join_null_safe, range_bucket, running_sum

OVERALL = "overall"
# fixed values: items that count as noise between runs; points that make a gain real
NOISE_ITEMS = 7
ILLUSORY, UP, DOWN = 1, 10, -5
BANDS = ["control", "base", "trained"]


def points(hits: Column, n: Column) -> Column:
    """Percent, NULL where nothing was asked."""
    return F.when(n > 0, hits / n * 100)


def skill_group_accuracy(tally: DataFrame, run: str, groups: DataFrame) -> DataFrame:
    """(run, skill, n, hits, accuracy): skill groups and overall.

    A group without items is NULL, not zero; a category in no group counts only
    overall. tally: run, category, n, lenient; groups: category, skill.
    """
    rows = tally.join(groups, "category", "left")
    grouped = rows.where("skill is not null").groupBy(run, "skill").agg(F.sum("n").alias("n"), F.sum("lenient").alias("hits"))
    whole = rows.groupBy(run).agg(F.sum("n").alias("n"), F.sum("lenient").alias("hits")).withColumn("skill", F.lit(OVERALL))
    # runs and skills are both short lists; every run shows every skill
    skills = F.array_append(groups.agg(F.sort_array(F.collect_set("skill")).alias("s")).scalar(), F.lit(OVERALL))
    frame = tally.select(run).distinct().withColumn("skill", F.explode(skills))
    found = grouped.unionByName(whole)
    joined = frame.join(found, [run, "skill"], "left").fillna(0, ["n", "hits"])
    return joined.withColumn("accuracy", F.round(points(F.col("hits"), F.col("n")), 6))


def publish_wide(long: DataFrame, run: str, skills: Sequence[str]) -> DataFrame:
    """One row per run, one column per skill."""
    return long.groupBy(run).pivot("skill", list(skills)).agg(F.first("accuracy"))


def banded_ranking(board: DataFrame, kind: str, overall: str, name: str) -> DataFrame:
    """Adds band and place: controls, untrained, trained; best first inside each."""
    band = F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col(kind))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc(overall), name))
    return board.withColumn("band", band.cast("bigint")).withColumn("place", place.cast("bigint"))


def below_floor_flag(board: DataFrame, name: str, kind: str, overall: str, floor_name: str) -> DataFrame:
    """Adds floor and below_floor; controls are never flagged."""
    floor = board.where((F.col(kind) == "control") & (F.col(name) == floor_name)).agg(F.max(overall).alias("f")).scalar()
    flagged = board.withColumn("floor", floor)
    return flagged.withColumn("below_floor", (F.col(kind) != "control") & F.coalesce(F.col(overall) < F.col("floor"), F.lit(False)))


def one_method_only(runs: DataFrame, kind: str, method: str, wanted: str) -> DataFrame:
    return runs.where((F.col(method) == wanted) | (F.col(kind) == "control"))


def compare_runs(tally: DataFrame, run: str, first: str, last: str) -> DataFrame:
    """(category, n, first_hits, last_hits, diff_items, diff_points, size) with a
    total row, categories by size of the difference (`place`)."""
    pick = lambda r, c: F.sum(F.when(F.col(run) == r, F.col(c)))
    rolled = tally.where(F.col(run).isin(first, last)).rollup("category").agg(
        pick(last, "n").alias("n"), pick(first, "lenient").alias("first_hits"), pick(last, "lenient").alias("last_hits"),
        F.grouping("category").alias("is_total"),
    )
    diff = F.col("last_hits") - F.col("first_hits")
    size = F.when(diff == 0, F.lit("unchanged")).when(F.abs(diff) < NOISE_ITEMS, F.lit("small")).otherwise(F.lit("large"))
    sized = rolled.select(
        "category", "n", "first_hits", "last_hits", diff.alias("diff_items"),
        F.round(points(diff, F.col("n")), 6).alias("diff_points"), size.alias("size"), "is_total",
    )
    order = Window.partitionBy("is_total").orderBy(F.abs("diff_points").desc(), "category")
    return sized.withColumn("place", F.row_number().over(order).cast("bigint")).drop("is_total")


def three_ways(tally: DataFrame, run: str, base: str, constant: str, trained: str) -> DataFrame:
    """(category, n, base, constant, trained): accuracies side by side."""
    acc = lambda r: F.sum(F.when(F.col(run) == r, points(F.col("lenient"), F.col("n"))))
    return tally.groupBy("category").agg(
        F.max("n").alias("n"), acc(base).alias("base"), acc(constant).alias("constant"), acc(trained).alias("trained")
    )


def gain_decomposition(tally: DataFrame, run: str, base: str, constant: str, trained: str) -> DataFrame:
    """Adds gain over the constant control and its verdict."""
    gain = F.col("trained") - F.col("constant")
    verdict = (
        F.when(F.abs(gain) < ILLUSORY, F.lit("illusory"))
        .when(gain > UP, F.lit("up"))
        .when(gain < DOWN, F.lit("down"))
        .otherwise(F.lit(""))
    )
    wide = three_ways(tally, run, base, constant, trained)
    r = lambda c: F.round(c, 6).alias(c)
    return wide.select("category", r("base"), r("constant"), r("trained"), F.round(gain, 6).alias("gain"), verdict.alias("verdict"))


def before_after_by_category(tally: DataFrame, run: str, base: str, constant: str, trained: str) -> DataFrame:
    """(category, n, base, trained, constant, strict of the trained run)."""
    strict = tally.where(F.col(run) == trained).select(
        "category", F.round(points(F.col("strict"), F.col("n")), 6).alias("strict")
    )
    wide = three_ways(tally, run, base, constant, trained)
    r = lambda c: F.round(c, 6).alias(c)
    return wide.join(strict, "category", "full").select("category", "n", r("base"), r("trained"), r("constant"), "strict")


def model_mean_range(board: DataFrame, model: str, kind: str, overall: str) -> DataFrame:
    """Mean, least and greatest score per model and kind; controls are floors."""
    return board.groupBy(model, kind).agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.avg(overall), 6).alias("mean"),
        F.round(F.min(overall), 6).alias("least"), F.round(F.max(overall), 6).alias("greatest"),
    ).withColumn("is_floor", F.col(kind) == "control")


def seed_spread(runs: DataFrame, variant: str, metric: str, value: str) -> DataFrame:
    """Mean, sample deviation and range of variants with two runs or more."""
    return (
        runs.groupBy(variant, metric)
        .agg(
            F.count(F.lit(1)).alias("n_runs"), F.round(F.avg(value), 6).alias("mean"),
            F.round(F.stddev_samp(value), 6).alias("deviation"), F.round(F.max(value) - F.min(value), 6).alias("spread"),
        )
        .where("n_runs >= 2")
    )


def run_cost_table(runs: DataFrame, evaluations: DataFrame, rates: DataFrame) -> DataFrame:
    """Per run: minutes, hours times the card's rate, epoch of the least
    evaluation loss; a total row has NULL run_id.

    runs: run_id, card, seconds, steps; evaluations: run_id, epoch, loss;
    rates: card, usd_per_hour.
    """
    best = evaluations.groupBy("run_id").agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("best_loss")
    )
    priced = runs.join(rates, "card", "left").join(best, "run_id", "left")
    rolled = priced.groupingSets([["run_id"], []], "run_id").agg(
        F.sum("steps").alias("steps"),
        F.round(F.sum("seconds") / 60, 4).alias("minutes"),
        F.round(F.sum(F.col("seconds") * F.coalesce("usd_per_hour", F.lit(0.0))) / 3600, 3).alias("usd"),
        F.max("best_epoch").alias("e"), F.max("best_loss").alias("l"), F.grouping("run_id").alias("g"),
    )
    one = F.col("g") == 0
    return rolled.select(
        "run_id", "steps", "minutes", "usd", F.when(one, F.col("e")).alias("best_epoch"), F.when(one, F.col("l")).alias("best_loss")
    )


def checkpoint_curve(board: DataFrame, run: str, steps: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(run, step, metric, value) of the runs that are checkpoints; steps: run, step."""
    joined = board.join(steps, run)
    return joined.unpivot([run, "step"], list(metrics), "metric", "value")


def external_accuracy(answers: DataFrame, model: str, prompt: str, base: str) -> DataFrame:
    """(model, prompt, n, accuracy, diff): against the base under the same prompt."""
    acc = answers.groupBy(model, prompt).agg(F.count(F.lit(1)).alias("n"), (F.avg("correct") * 100).alias("a"))
    ref = acc.where(F.col(model) == base).select(prompt, F.col("a").alias("b"))
    joined = join_null_safe(acc, ref, [prompt], "left")
    return joined.select(
        model, prompt, "n", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - F.col("b"), 6).alias("diff")
    )


def external_axis_delta(answers: DataFrame, model: str, prompt: str, base: str, axes: Sequence[str]) -> DataFrame:
    """The same per value of each axis (subject, group, province, level)."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    long = answers.select(model, prompt, "correct", F.explode(pairs).alias("x")).select(model, prompt, "correct", "x.*")
    acc = long.groupBy("axis", "value", model, prompt).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("correct") * 100).alias("a")
    )
    ref = acc.where(F.col(model) == base).select("axis", "value", prompt, F.col("a").alias("b"))
    joined = join_null_safe(acc, ref, ["axis", "value", prompt], "left")
    return joined.select(
        "axis", "value", model, prompt, "n", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - F.col("b"), 6).alias("diff")
    )


def random_floor(items: DataFrame) -> DataFrame:
    """One row: mean of one over the number of options."""
    return items.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 / F.size("options")), 6).alias("floor"))


def comparison_models(accuracy: DataFrame, model: str, family: Sequence[str]) -> DataFrame:
    """Models outside the family, ranked by accuracy."""
    others = accuracy.where(~F.col(model).isin(list(family)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("accuracy"), *[c for c in others.columns if c != "accuracy"]))
    return others.withColumn("place", place.cast("bigint"))


def forgetting_slope(accuracy: DataFrame, dataset: str, stage: str, value: str) -> DataFrame:
    """Accuracy by stage with the change since the stage before."""
    before = F.lag(value).over(Window.partitionBy(dataset).orderBy(stage))
    return accuracy.withColumn("change", F.round(F.col(value) - before, 6))


def cross_benchmark_correlation(models: DataFrame, name: str, x: str, y: str) -> DataFrame:
    """(left_out, n, r): Pearson r of two metrics over all models, and without
    each one; NULL for two models or fewer.

    The sums of all rows less those of one give its correlation, so no model is
    paired with the others.
    """
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    both = models.where(xs.isNotNull() & ys.isNotNull())
    sums = both.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.avg(xs).alias("mx"), F.avg(ys).alias("my"), F.var_pop(xs).alias("vx"),
            F.var_pop(ys).alias("vy"), F.covar_pop(xs, ys).alias("c"),
        ).alias("s")
    ).scalar()
    rows = both.select(F.col(name).cast("string").alias("left_out"), xs.alias("x"), ys.alias("y"), sums.alias("s"))
    n, dx, dy = F.col("s.n"), F.col("x") - F.col("s.mx"), F.col("y") - F.col("s.my")
    # deviations from the mean keep the subtraction stable
    scale = n / (n - 1)
    sxy = n * F.col("s.c") - dx * dy * scale
    sxx = n * F.col("s.vx") - dx * dx * scale
    syy = n * F.col("s.vy") - dy * dy * scale
    r = F.when((n - 1 > 2) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))
    each = rows.select("left_out", (n - 1).alias("n"), F.round(r, 6).alias("r"))
    whole = both.agg(
        F.lit(None).cast("string").alias("left_out"), F.count(F.lit(1)).alias("n"),
        F.round(F.when(F.count(F.lit(1)) > 2, F.corr(xs, ys)), 6).alias("r"),
    )
    return whole.unionByName(each)


def confusion_matrix(scored: DataFrame, group: str, letters: Sequence[str]) -> DataFrame:
    """(group, key, one column per letter): percent of the group's readable replies."""
    readable = scored.where("choice <> ''")
    totals = readable.groupBy(group).agg(F.count(F.lit(1)).alias("__t"))
    cells = readable.groupBy(group, "key").agg(*[F.count_if(F.col("choice") == x).alias(f"__{x}") for x in letters])
    joined = join_null_safe(cells, totals, [group])
    return joined.select(group, "key", *[F.round(F.col(f"__{x}") / F.col("__t") * 100, 6).alias(f"chose_{x}") for x in letters])


def item_difficulty_histogram(scored: DataFrame, item: str, run: str) -> DataFrame:
    """(n_right, n_items): items by how many runs got them right, empty bins kept."""
    per = scored.groupBy(item).agg(F.sum("correct").alias("n_right"))
    counts = per.groupBy("n_right").agg(F.count(F.lit(1)).alias("n_items"))
    n_runs = scored.agg(F.countDistinct(run).alias("n")).scalar()
    bins = scored.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), n_runs)).alias("n_right"))
    return bins.join(counts, "n_right", "left").fillna(0, ["n_items"])


def metric_merge(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, metric, value): first source wins. Each source: key, metric, value."""
    out = None
    for i, source in enumerate(sources):
        ranked = source.select(key, "metric", "value", F.lit(i).alias("__p")).where("value is not null")
        out = ranked if out is None else out.unionByName(ranked)
    return out.groupBy(key, "metric").agg(F.min_by("value", "__p").alias("value"))


def best_per_metric(merged: DataFrame, key: str, controls: DataFrame) -> DataFrame:
    """Adds best: the greatest value per metric among models, controls apart."""
    models = merged.join(controls.select(key), key, "left_anti")
    top = models.groupBy("metric").agg(F.max("value").alias("__top"))
    flagged = merged.join(controls.select(key).withColumn("__c", F.lit(True)), key, "left").join(top, "metric", "left")
    best = F.col("__c").isNull() & (F.col("value") == F.col("__top"))
    return flagged.withColumn("best", F.coalesce(best, F.lit(False))).drop("__c", "__top")


def complete_metric_pairs(merged: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, x, y, n_left_out): models that hold both metrics."""
    a = merged.where(F.col("metric") == x).select(key, F.col("value").alias("x"))
    b = merged.where(F.col("metric") == y).select(key, F.col("value").alias("y"))
    pairs = a.join(b, key)
    either = merged.where(F.col("metric").isin(x, y)).agg(F.countDistinct(key).alias("c")).scalar()
    full = pairs.agg(F.count(F.lit(1)).alias("c")).scalar()
    return pairs.withColumn("n_left_out", either - full)


def facts_store(parts: Sequence[DataFrame]) -> DataFrame:
    """(name, value, source, note) of all parts."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """Names recorded with two different values; must be empty."""
    ends = facts.groupBy("name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.where("lo <> hi")


def completeness_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, blank): one pass over the table for all columns."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin("", "-")
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(blank(c)).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.col("__n") - F.col(c)).alias("filled"), F.col(c).alias("blank")) for c in columns]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def titles_by_owner(records: DataFrame, owner: str, title: str) -> DataFrame:
    """(owner, position, title, n_titles): an owner's titles in order, as rows;
    a cell per owner would grow with the owner."""
    bucketed = range_bucket(records.select(owner, title), [title, owner])
    ranked = running_sum(bucketed, [owner], "__b", [title], out="position", total="n_titles").drop("__b")
    return ranked.withColumn("position", F.col("position") + 1)


def faceted_search(df: DataFrame, text: Sequence[str], words: str, kind: str | None = None, kind_column: str | None = None) -> DataFrame:
    """Rows where any text column holds the words, case aside, and the kind fits."""
    hit = F.lit(False)
    for c in text:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(words.lower()))
    out = df.where(hit)
    return out if kind is None else out.where(F.col(kind_column) == kind)


def preview_bars(bars: Column, n: int) -> Column:
    return F.array_join(F.slice(bars, 1, n), " | ")


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows in an explicit order; each task keeps n."""
    return df.orderBy(*order).limit(n)


def projected_cost(probes: DataFrame, rates: DataFrame, steps: int) -> DataFrame:
    """(card, rate, hours, usd, cheapest): a probe scaled to the whole run.

    probes: card, seconds_per_step; rates: key, usd_per_hour. The rate is that
    of the longest key the card's name contains, zero without one.
    """
    # every part of a name that is as long as some key meets the keys; no array of prices is copied to each row
    lengths = rates.agg(F.collect_set(F.length("key"))).scalar()
    low = F.lower("card")
    parts = F.flatten(F.transform("__lengths", lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: i + n - 1 <= F.length(low)), lambda i: F.substr(low, i, n))))
    asked = probes.select("card").distinct().withColumn("__lengths", lengths).select("card", F.explode(F.array_distinct(parts)).alias("__part"))
    keyed = rates.select(F.lower("key").alias("__part"), F.struct(F.length("key"), "key").alias("__long"), "usd_per_hour")
    fits = asked.join(keyed, "__part").groupBy("card").agg(F.max_by("usd_per_hour", "__long").alias("__usd"))
    rated = join_null_safe(probes, fits, ["card"], "left").withColumn("rate", F.coalesce("__usd", F.lit(0.0)))
    hours = F.col("seconds_per_step") * steps / 3600
    priced = rated.select("card", "rate", F.round(hours, 6).alias("hours"), F.round(hours * F.col("rate"), 6).alias("usd"))
    cheapest = priced.where("rate > 0").agg(F.min_by("card", F.struct("usd", "card")).alias("c")).scalar()
    return priced.withColumn("cheapest", F.coalesce(F.col("card") == cheapest, F.lit(False)))
