"""Matching predictions to keys and scoring them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import reply as R
from tallywright.functions.hashing import seeded_number
from tallywright.functions.text import WORD, marked, norm_answer, once
from tallywright.operators.pairs import sequence_pass
from tallywright.operators.ranking import join_null_safe, ordered_rank, seeded_rank
from tallywright.session import materialise

# fixed values: scoring rule of each category; any other category asks for the
# key without a rival, `*_abstain` for a refusal, `verifikasi*` for a verdict
RULES = {
    "hitung_bar": "number", "ambitus": "number", "nada_dasar": "keys",
    "nada_tertinggi": "first_note", "nada_terendah": "first_note", "judul_ke_notasi": "sequence",
    "judul_ke_lirik": "overlap", "judul_ke_baris": "overlap", "lanjut_lirik": "overlap",
}
ABSTAIN = "_abstain"


def rule_of(category: Column, rules: Mapping[str, str] = RULES) -> Column:
    rule = F.when(F.endswith(category, F.lit("abstain")), F.lit("refusal")).when(
        F.startswith(category, F.lit("verifikasi")), F.lit("verdict")
    )
    for name, value in rules.items():
        rule = rule.when(category == name, F.lit(value))
    return rule.otherwise(F.lit("contains"))


def match_by_position(preds: DataFrame, keys: DataFrame, slot: Sequence[str], order: str) -> DataFrame:
    """The n-th prediction of a slot meets its n-th key; surplus predictions
    meet the last one. Ranks are bucketed, so a hot slot is sorted in parts."""
    k = ordered_rank(keys, slot, order, out="__at").drop(order)
    sizes = keys.groupBy(*slot).agg(F.count(F.lit(1)).alias("__n_keys"))
    p = join_null_safe(ordered_rank(preds, slot, order, out="__rn"), sizes, slot)
    return join_null_safe(p.withColumn("__at", F.least("__rn", "__n_keys")), k, [*slot, "__at"]).drop(
        "__at", "__rn", "__n_keys"
    )


def match_by_id(preds: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return preds.join(items, key)


def completeness_gate(preds: DataFrame, items: DataFrame, run: str, key: str) -> DataFrame:
    """(run, n_matched, n_items, complete): every item must be answered."""
    n = items.agg(F.count(F.lit(1)).alias("c")).scalar()
    hits = preds.select(run, key).join(items.select(key), key, "left_semi").groupBy(run).agg(F.count(F.lit(1)).alias("n_matched"))
    return hits.withColumn("n_items", n).withColumn("complete", F.col("n_matched") == F.col("n_items"))


def order_alarm(preds: DataFrame, keys: DataFrame, slot: Sequence[str], order: str) -> DataFrame:
    """One row: do complete predictions come in another order than the keys?

    Short or foreign files stay silent here; other gates deal with them.
    """
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"k.{c}")) for c in slot]
    p = ordered_rank(preds.select(*slot, order), [], order, out="__at").alias("p")
    k = ordered_rank(keys.select(*slot, order), [], order, out="__at").alias("k")
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    moved = p.join(k, F.col("p.__at") == F.col("k.__at"), "full").agg(F.count_if(~F.coalesce(equal, F.lit(False))).alias("c"))
    signed = preds.select(*slot, F.lit(1).alias("__s")).unionByName(keys.select(*slot, F.lit(-1).alias("__s")))
    uneven = signed.groupBy(*slot).agg(F.sum("__s").alias("d")).where("d <> 0").agg(F.count(F.lit(1)).alias("c"))
    return moved.select(F.col("c").alias("n_moved"), uneven.scalar().alias("n_uneven")).withColumn(
        "alarm", (F.col("n_moved") > 0) & (F.col("n_uneven") == 0)
    )


def unmatched_gate(preds: DataFrame, keys: DataFrame, slot: Sequence[str]) -> DataFrame:
    """One row: predictions without a key, their share, and whether to refuse."""
    lost = preds.join(keys.select(*slot).distinct(), list(slot), "left_anti").agg(F.count(F.lit(1)).alias("c"))
    total = preds.agg(F.count(F.lit(1)).alias("c")).scalar()
    return lost.select(F.col("c").alias("n_unmatched"), total.alias("n_predictions")).select(
        "*", F.round(F.col("n_unmatched") / F.col("n_predictions"), 6).alias("share"), (F.col("n_unmatched") > 0).alias("refuse")
    )


def rival_sets(items: DataFrame) -> DataFrame:
    """(category, rival): normalised answers of a category; an abstain category
    takes those of its positive twin."""
    # distinct before and after: each spelling is normalised once
    answers = items.where(~F.endswith("category", F.lit(ABSTAIN))).select("category", "answer").distinct()
    positive = answers.select("category", norm_answer(F.col("answer")).alias("rival")).distinct()
    abstain = items.where(F.endswith("category", F.lit(ABSTAIN))).select("category").distinct()
    twins = abstain.withColumn("twin", F.regexp_replace("category", f"{ABSTAIN}$", "")).join(
        positive.withColumnRenamed("category", "twin"), "twin"
    )
    return positive.unionByName(twins.select("category", "rival"))


def rival_hits(preds: DataFrame, key: Sequence[str], rivals: DataFrame) -> DataFrame:
    """(key, names_rival, names_long): does a reply name a rival of its category?

    preds: key, category, p, g (normalised reply and gold). A reply is cut into
    word n-grams of the lengths its rivals have and meets them in an equi join,
    so cost follows the replies and not replies times rivals. Symbols and word
    ends are then tested on marked texts, spelled once per reply and rival: no
    pattern is made from a rival. The rivals, which are read twice, are written
    once to the shared folder.
    """
    word = rf"[{WORD}]+"
    spelled = F.regexp_extract_all("rival", F.lit(word), F.lit(0))
    keyed = materialise(
        rivals.where("rival <> ''").select(
            "category", "rival", F.size(spelled).alias("n"), F.array_join(spelled, " ").alias("gram"), marked(F.col("rival")).alias("rm")
        ),
        "rivals",
    )
    lengths = keyed.groupBy("category").agg(F.collect_set("n").alias("lengths"))
    # a row per category is broadcast; Spark's own choice by file size would be the replies
    read = F.struct(F.regexp_extract_all("p", F.lit(word), F.lit(0)).alias("ws"), marked(F.col("p")).alias("pm"), F.col("g").alias("g"))
    worded = preds.join(F.broadcast(lengths), "category").withColumn("__r", once(read)).select(*key, "category", "lengths", "__r.*")
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                "lengths",
                lambda n: F.when(n == 0, F.array(F.lit("")))
                .when(
                    F.size("ws") >= n,
                    F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " ")),
                )
                .otherwise(F.array().cast("array<string>")),
            )
        )
    )
    asked = worded.select(*key, "category", "g", "pm", F.explode(grams).alias("gram"))
    met = asked.join(keyed.select("category", "gram", "rival", "rm"), ["category", "gram"])
    judged = met.where(F.contains("pm", F.col("rm"))).select(
        *key, (~F.contains("g", F.col("rival"))).alias("names"), (F.length("rival") > 3).alias("long")
    )
    return judged.groupBy(*key).agg(F.bool_or("names").alias("names_rival"), F.bool_or("long").alias("names_long"))


def score(preds: DataFrame, key: Sequence[str], rivals: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Adds strict and lenient (0/1). preds: key, category, reply, answer. No reply is right where the answer is NULL.

    Replies are read once and written to the shared folder. Every branch behind reads that table: as one plan, the work on
    items and replies stood in it up to eight times, and plan, code and task records filled the driver.
    """
    read = preds.withColumn("said", once(R.strip_reasoning(F.coalesce("reply", F.lit(""))))).withColumn(
        "rule", rule_of(F.col("category"), rules)
    )
    texts = F.struct(norm_answer(F.col("said")).alias("p"), norm_answer(F.col("answer")).alias("g"))
    norm = materialise(read.withColumn("__t", once(texts)).select(*read.columns, "__t.*"), "read-replies")
    by_rival = F.col("rule").isin("contains", "refusal")
    hits = rival_hits(norm.where(by_rival).select(*key, "category", "p", "g"), key, rivals)
    joined = join_null_safe(norm.where("rule <> 'sequence'"), hits, key, "left").fillna(False, ["names_rival", "names_long"])
    gold_notes, notes = R.melody_tokens(F.col("answer")), R.melody_tokens(F.col("said"))
    want = R.named_keys(F.col("answer"))
    said_verdict = R.verdict(F.col("said"))
    first = F.get(notes, F.lit(0)) == F.get(gold_notes, F.lit(0))
    rule = F.col("rule")
    lenient = (
        F.when(rule == "refusal", R.says_no(F.col("said")) & ~F.col("names_long"))
        .when(rule == "verdict", said_verdict == R.verdict(F.col("answer")))
        .when(rule == "number", R.number_matches(F.col("said"), F.col("answer")))
        .when(rule == "keys", (F.size(want) > 0) & (R.named_keys(F.col("said")) == want))
        .when(rule == "first_note", first)
        .when(rule == "overlap", R.token_f1(F.col("said"), F.col("answer")) >= R.PASS_RATIO)
        .when(rule == "contains", R.contains_key(F.col("p"), F.col("g")) & ~F.col("names_rival"))
    )
    out = joined.withColumn("ok", F.coalesce(lenient, F.lit(False))).drop("names_rival", "names_long")
    if "sequence" in rules.values():
        # only this branch leaves the JVM
        seq = norm.where("rule = 'sequence'").withColumn("__a", notes).withColumn("__b", gold_notes)
        judged = sequence_pass(seq, "__a", "__b", "ok").withColumn("ok", F.coalesce(F.col("ok") & (F.size("__b") > 0), F.lit(False)))
        out = out.unionByName(judged.drop("__a", "__b"))
    return out.select(
        *preds.columns,
        F.coalesce(F.col("p") == F.col("g"), F.lit(False)).cast("bigint").alias("strict"),
        F.col("ok").cast("bigint").alias("lenient"),
    )


def tally(scored: DataFrame, run: str = "run") -> DataFrame:
    """(run, category, n, strict, lenient); the total of a run has NULL category."""
    return scored.groupingSets([[run, "category"], [run]], run, "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("strict").alias("strict"), F.sum("lenient").alias("lenient")
    )


def per_record_accuracy(scored: DataFrame, run: str, record: str) -> DataFrame:
    return scored.groupBy(run, record).agg(
        F.sum("lenient").alias("hits"), F.count(F.lit(1)).alias("n"), F.round(F.avg("lenient"), 6).alias("share")
    )


def error_summary(scored: DataFrame, run: str, top: int = 8, width: int | None = None) -> DataFrame:
    """The `top` categories of a run by misses, with the commonest wrong reply.

    Replies are counted as aggregates; only one row per category is ranked.
    width: replies that agree so far count as one; whole replies by default.
    """
    wrong = scored.where("lenient = 0").select(run, "category", F.trim("reply").alias("r"))
    texts = wrong.groupBy(run, "category", "r").agg(F.count(F.lit(1)).alias("c"))
    short = texts.groupBy(run, "category", (F.col("r") if width is None else F.substring("r", 1, width)).alias("text")).agg(
        F.sum("c").alias("k"), F.count(F.lit(1)).alias("d")
    )
    best = F.min_by(F.struct("text", "k"), F.struct(-F.col("k"), F.col("text")))
    per = short.groupBy(run, "category").agg(
        F.sum("k").alias("misses"), F.sum("d").alias("n_distinct"), best.alias("b")
    )
    rank = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("misses"), "category"))
    return (
        per.withColumn("place", rank.cast("bigint"))
        .where(F.col("place") <= top)
        .select(run, "place", "category", "misses", "n_distinct", F.col("b.text").alias("commonest"), F.col("b.k").alias("times"))
    )


def score_choices(preds: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """preds (run, key, reply) with choice, correct and readable columns."""
    joined = preds.join(items, key)
    chosen = joined.withColumn("choice", R.chosen_letter(F.col("reply"), F.col("options")))
    return chosen.withColumn("correct", (F.col("choice") == F.col("key")).cast("bigint")).withColumn(
        "readable", (F.col("choice") != "").cast("bigint")
    )


def mc_report(scored: DataFrame, run: str = "run") -> DataFrame:
    """Accuracy and readable share per category and run; total rows carry the
    modal letter and the two warnings."""
    rolled = scored.groupingSets([[run, "category"], [run]], run, "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("a"), F.avg("readable").alias("r"),
        F.grouping("category").alias("total"),
    )
    letters = scored.where("readable = 1").groupBy(run, "choice").agg(F.count(F.lit(1)).alias("c"))
    modal = letters.groupBy(run).agg(
        F.min_by(F.struct("choice", "c"), F.struct(-F.col("c"), F.col("choice"))).alias("m"), F.sum("c").alias("all")
    )
    joined = rolled.join(modal, run, "left")
    whole = F.col("total") == 1
    share = F.col("m.c") / F.col("all")
    return joined.select(
        run, "category", "n", F.round("a", 6).alias("accuracy"), F.round("r", 6).alias("readable"),
        F.when(whole, F.col("m.choice")).alias("modal_letter"),
        F.when(whole, F.round(share, 6)).alias("modal_share"),
        F.when(whole, F.col("r") < 0.9).alias("warn_unreadable"),
        F.when(whole, share > 0.5).alias("warn_one_letter"),
    )


def option_likelihood_choice(tokens: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(item, choice, score, valid) from (item, letter, logprob) token rows.

    Mean log-probability per option, ties to the first letter; an item with an
    option that contributes no tokens is invalid. items: item, letter.
    """
    means = tokens.groupBy(item, "letter").agg(F.avg("logprob").alias("score"))
    every = items.join(means, [item, "letter"], "left")
    best = F.min_by(F.struct("letter", "score"), F.struct(-F.col("score"), F.col("letter")))
    return every.groupBy(item).agg(best.alias("b"), F.bool_and(F.col("score").isNotNull()).alias("valid")).select(
        item, F.when(F.col("valid"), F.col("b.letter")).alias("choice"), F.when(F.col("valid"), F.col("b.score")).alias("score"), "valid"
    )


def letter_likelihood_choice(variants: DataFrame, item: str) -> DataFrame:
    """(item, choice): greatest token variant per letter, then the best letter."""
    best = variants.groupBy(item, "letter").agg(F.max("logprob").alias("score"))
    return best.groupBy(item).agg(F.min_by("letter", F.struct(-F.col("score"), F.col("letter"))).alias("choice"))


def truncation_rate(replies: DataFrame, model: str, n_tokens: str, asked: int, budgets: DataFrame, warn: float = 0.10) -> DataFrame:
    """(model, budget, n, share, warn): replies that used the whole budget, which
    is the greater of the asked one and the model's own."""
    joined = join_null_safe(replies, budgets, [model], "left")
    budget = F.greatest(F.lit(asked).cast("bigint"), F.coalesce("budget", F.lit(0)).cast("bigint"))
    cut = (F.col(n_tokens) >= budget).cast("int")
    per = joined.groupBy(model).agg(F.max(budget).alias("budget"), F.count(F.lit(1)).alias("n"), F.avg(cut).alias("share"))
    return per.select(model, "budget", "n", F.round("share", 6).alias("share"), (F.col("share") > warn).alias("warn"))


# negative controls


def most_common(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value, n, share): commonest value, ties to the lesser one."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    top = F.min_by(F.struct(F.col(value).alias("v"), F.col("n").alias("n")), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(*group).agg(top.alias("t"), F.sum("n").alias("all")).select(
        *group, F.col("t.v").alias(value), F.col("t.n").alias("n"), F.round(F.col("t.n") / F.col("all"), 6).alias("share")
    )


def control_constant(items: DataFrame, category: str, answer: str) -> DataFrame:
    """Items with the commonest answer of their category as the reply."""
    top = most_common(items, [category], answer).select(category, F.col(answer).alias("reply"))
    return join_null_safe(items, top, [category])


def control_random(items: DataFrame, key: str, category: str, answer: str, seed: int | str) -> DataFrame:
    """Items with a seeded draw from their category's own answers as the reply."""
    indexed = seeded_rank(items.select(key, category, answer), [category], [key], seed, out="pos", total="m")
    sizes = items.groupBy(category).agg(F.count(F.lit(1)).alias("m"))
    drawn = join_null_safe(items, sizes, [category]).withColumn("pos", 1 + seeded_number(f"{seed}-draw", F.col(key)) % F.col("m"))
    table = indexed.select(category, "pos", F.col(answer).alias("reply"))
    return join_null_safe(drawn, table, [category, "pos"]).drop("pos", "m")


def control_empty(items: DataFrame) -> DataFrame:
    return items.withColumn("reply", F.lit(""))


def control_prior(options: DataFrame, counts: DataFrame, item: str, seed: int | str) -> DataFrame:
    """(item, choice): the option whose text is commonest in the corpus.

    options: item, category, letter, text; counts: category, text, n, from the
    corpus and never from the keys. A category without counts guesses a letter.
    """
    known = counts.select("category").distinct().withColumn("known", F.lit(True))
    rows = join_null_safe(options.withColumn("text", F.trim("text")), counts, ["category", "text"], "left")
    rows = join_null_safe(rows, known, ["category"], "left")
    guess = seeded_number(seed, F.col(item), F.col("letter"))
    weight = F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(guess)
    return rows.groupBy(item).agg(F.min_by("letter", F.struct(-weight, F.col("letter"))).alias("choice"))
