"""Multiple-choice items: five options, one key, balanced and self-audited.

Raw items hold uid, record, category, question, answer, others (four distinct
texts), key_source, level and hardness; place_options turns them into items.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.hashing import gram_key, seeded_key
from tallywright.functions.text import gives_away, once, words_of
from tallywright.operators.choices import pick_other_values, pick_rivals_without_value
from tallywright.operators.excerpts import (
    COUNT_BARS,
    EXCERPT_BARS,
    Notes,
    highest_in_excerpt,
    other_tokens,
    picked_excerpts,
)
from tallywright.operators.generation import blanked, counted_excerpts, fill
from tallywright.operators.ranking import seeded_rank
from tallywright.session import materialise

LETTERS = ["A", "B", "C", "D", "E"]
N_OPTIONS = 5
CHANCE = 1 / N_OPTIONS
RAW = ["uid", "record", "category", "question", "answer", "others", "key_source", "level", "hardness"]


def raw_item(uid: Column, category: Column, question: Column, answer: Column, others: Column, source: str, level: str, hardness: Column) -> list[Column]:
    return [
        uid.alias("uid"), F.col("record"), category.alias("category"), question.alias("question"), answer.alias("answer"),
        others.alias("others"), F.lit(source).alias("key_source"), F.lit(level).alias("level"), hardness.alias("hardness"),
    ]


def uid(*parts: Column) -> Column:
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def fact_mc(facts: DataFrame, domain: DataFrame, seed: int | str) -> DataFrame:
    """Attribute questions; facts: record, category, question, answer, hardness.

    domain: category, answer; literals outside the corpus may be added so that a
    category with few values can be built at all.
    """
    picked = pick_other_values(facts, ["record", "category"], ["category"], "answer", domain, N_OPTIONS - 1, seed)
    return picked.select(
        *raw_item(
            uid(F.col("record"), F.col("category")), F.col("category"), F.col("question"), F.col("answer"),
            F.col("others"), "printed", "recall", F.col("hardness"),
        )
    )


def reversed_mc(
    records: DataFrame, key: str, stratum: str, value: str, name: str, category: str, template: str, seed: int | str
) -> DataFrame:
    """Value to name: rivals share the stratum and never the value."""
    stated = records.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    picked = pick_rivals_without_value(stated, key, stratum, value, name, N_OPTIONS - 1, seed)
    return picked.withColumn("record", F.col(key)).select(
        *raw_item(
            uid(F.col(key), F.lit(category)), F.lit(category), fill(template, value=F.col(value)), F.col(name),
            F.col("others"), "printed", "recall", F.lit(stratum),
        )
    )


def _seeded_four(options: Column, seed: int | str, *key: Column) -> Column:
    ranked = F.sort_array(F.transform(options, lambda o: F.struct(seeded_key(seed, *key, o).alias("h"), o.alias("o"))))
    return F.transform(F.slice(ranked, 1, N_OPTIONS - 1), lambda r: r["o"])


def excerpt_mc(
    records: DataFrame, key: str, name: str, bars: str, distractors: DataFrame, shared: DataFrame,
    templates: tuple[str, str], per_record: int, seed: int | str, notes: Notes,
) -> DataFrame:
    """Excerpt to name where one record owns it, and the highest note of an excerpt.

    distractors: key, level, others; shared: gram of excerpts with several owners.
    """
    base = records.select(F.col(key).alias("record"), F.col(name).alias("name"), F.col(bars).alias("bars"))
    cut = picked_excerpts(base, "record", "bars", EXCERPT_BARS, per_record, seed, notes, fill=True)
    names = distractors.select(F.col(key).alias("record"), F.col("level").alias("tier"), "others")
    owned = cut.withColumn("gram", gram_key(F.col("excerpt"))).join(shared, "gram", "left_anti")
    which = owned.join(names, "record").select(
        *raw_item(
            uid(F.col("record"), F.lit("excerpt"), F.col("n"), F.col("start")), F.lit("excerpt_to_title"),
            fill(templates[0], excerpt=F.col("excerpt")), F.col("name"), F.col("others"), "computed", "recall", F.col("tier"),
        )
    )
    noted = cut.withColumn("notes", notes(F.col("excerpt")))
    rest = noted.withColumn("rest", other_tokens(F.col("notes"))).where(F.size("rest") >= N_OPTIONS - 1)
    high = rest.select(
        *raw_item(
            uid(F.col("record"), F.lit("highest"), F.col("n"), F.col("start")), F.lit("highest_note"),
            fill(templates[1], excerpt=F.col("excerpt")), highest_in_excerpt(F.col("notes")),
            _seeded_four(F.col("rest"), seed, F.col("record"), F.col("n"), F.col("start")), "computed", "reasoning",
            F.lit("same excerpt"),
        )
    )
    return which.unionByName(high)


def count_mc(records: DataFrame, key: str, bars: str, template: str, per_record: int | None, seed: int | str) -> DataFrame:
    """Counted bars with neighbouring numbers inside the asked range."""
    cut = counted_excerpts(records, key, bars, per_record, seed)
    near = F.filter(
        F.array(*[F.col("n") + d for d in (-2, -1, 1, 2, 3)]), lambda x: (x >= COUNT_BARS[0]) & (x <= COUNT_BARS[-1])
    )
    asked = cut.withColumn("near", F.transform(near, lambda x: x.cast("string"))).where(F.size("near") >= N_OPTIONS - 1)
    return asked.select(
        *raw_item(
            uid(F.col("record"), F.lit("count"), F.col("n")), F.lit("count_bars"), fill(template, excerpt=F.col("excerpt")),
            F.col("n").cast("string"), _seeded_four(F.col("near"), seed, F.col("record"), F.col("n")), "computed", "reasoning",
            F.lit("near the answer"),
        )
    )


def line_mc(
    records: DataFrame, key: str, name: str, lines: str, distractors: DataFrame, template: str, per_record: int | None = None
) -> DataFrame:
    """Line to name: four words or more that do not give the name away."""
    rows = records.select(
        F.col(key).alias("record"), F.col(name).alias("name"), F.posexplode(F.col(lines) if per_record is None else F.slice(lines, 1, per_record)).alias("i", "line")
    )
    kept = rows.where((F.size(words_of(F.col("line"))) >= 4) & ~gives_away(F.col("name"), F.col("line")))
    names = distractors.select(F.col(key).alias("record"), F.col("level").alias("tier"), "others")
    return kept.join(names, "record").select(
        *raw_item(
            uid(F.col("record"), F.lit("line"), F.col("i")), F.lit("line_to_title"), fill(template, line=F.col("line")),
            F.col("name"), F.col("others"), "printed", "recall", F.col("tier"),
        )
    )


def cloze_mc(
    records: DataFrame, key: str, name: str, lines: str, template: str, per_record: int | None, seed: int | str
) -> DataFrame:
    """A missing word with options from all words of the same record.

    Each line draws among its record's whole vocabulary, so work follows lines times distinct words of a record; a line's
    copy of the vocabulary lives as long as the line is read and is never shuffled.
    """
    base = records.select(F.col(key).alias("record"), F.col(name).alias("name"), F.col(lines).alias("ls"))
    long_words = F.flatten(F.transform("ls", lambda x: F.filter(words_of(x), lambda w: F.length(w) > 2)))
    base = base.withColumn("vocab", F.array_distinct(long_words))
    rows = base.select("record", "name", "vocab", F.posexplode(F.col("ls") if per_record is None else F.slice("ls", 1, per_record)).alias("i", "line")).withColumn(
        "ws", words_of(F.col("line"))
    )
    spots = F.filter(
        F.transform("ws", lambda w, j: F.struct(seeded_key(seed, F.col("record"), F.col("i"), j).alias("h"), j.alias("j"), w.alias("w"))),
        lambda s: (s["j"] > 0) & (s["j"] < F.size("ws") - 1) & (F.length(s["w"]) > 2),
    )
    # exploding one spot, not computing it in place: a filter on a computed column
    # would be pushed down and worked out again for every word of the vocabulary
    spotted = rows.where(F.size("ws") >= 5).withColumn("s", F.explode(F.slice(F.sort_array(spots), 1, 1)))
    rest = spotted.withColumn("rest", F.filter("vocab", lambda w: F.lower(w) != F.lower(F.col("s.w")))).where(
        F.size("rest") >= N_OPTIONS - 1
    )
    return rest.select(
        *raw_item(
            uid(F.col("record"), F.lit("cloze"), F.col("i")), F.lit("cloze"),
            fill(template, name=F.col("name"), line=blanked(F.col("ws"), F.col("s.j"))), F.col("s.w"),
            _seeded_four(F.col("rest"), seed, F.col("record"), F.col("i")), "printed", "recall", F.lit("same record"),
        )
    )


def place_options(raw: DataFrame, seed: int | str) -> DataFrame:
    """Items with lettered options in seeded order and the key letter; items
    whose options are not five distinct texts are rejected."""
    every = F.concat(F.array("answer"), F.col("others"))
    distinct = F.size(F.array_distinct(F.transform(every, lambda o: F.lower(F.trim(o))))) == N_OPTIONS
    shuffled = F.transform(
        F.sort_array(F.transform(every, lambda o: F.struct(seeded_key(seed, F.col("uid"), o).alias("h"), o.alias("o")))),
        lambda r: r["o"],
    )
    placed = raw.where(distinct).withColumn("__o", once(shuffled))
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return placed.select(
        *[c for c in raw.columns if c not in ("answer", "others")],
        F.map_from_arrays(letters, F.col("__o")).alias("options"),
        F.element_at(letters, F.array_position("__o", F.col("answer")).cast("int")).alias("key"),
    )


def option_rows(items: DataFrame) -> DataFrame:
    """(uid, category, key, letter, text): one row per option."""
    return items.select("uid", "category", "key", F.explode("options").alias("letter", "text"))


def balance_to_target(items: DataFrame, target: int, seed: int | str, prefix: str = "mc") -> DataFrame:
    """Even quota per category, room left filled from the rest, ids by a final
    seeded order. Every rank is bucketed, so no category is sorted in one task.

    The pool is written once to the shared folder: the three ranks read it many
    times, and only its key columns.
    """
    items = materialise(items, "choice-pool")
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    n_cat = counts.agg(F.count(F.lit(1)).alias("c"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(target) / F.greatest(n_cat.scalar(), F.lit(1))))
    ranked = seeded_rank(items.select("uid", "category"), ["category"], ["uid"], seed, out="__rn").withColumn(
        "__in", F.col("__rn") <= quota
    )
    taken = counts.agg(F.sum(F.least("n", quota)).alias("t")).scalar()
    within = seeded_rank(ranked, ["__in"], ["uid"], f"{seed}-rest", out="__rest")
    chosen = within.where(F.col("__in") | (F.col("__rest") <= F.lit(target) - taken)).select("uid")
    final = items.join(seeded_rank(chosen, [], ["uid"], f"{seed}-order", out="place"), "uid")
    place = F.col("place").cast("string")
    # lpad cuts what is longer than its width
    return final.withColumn("item_id", F.concat(F.lit(f"{prefix}-"), F.lpad(place, F.greatest(F.lit(4), F.length(place)), F.lit("0"))))


def strictly_longest(items: DataFrame) -> Column:
    """The key's text is longer than every other option."""
    lengths = F.transform(F.map_values("options"), lambda o: F.length(o))
    top = F.array_max(lengths)
    return (F.length(F.element_at("options", F.col("key"))) == top) & (
        F.size(F.filter(lengths, lambda n: n == top)) == 1
    )


def mc_self_audit(items: DataFrame) -> DataFrame:
    """(check, category, label, n, share, failed): letter counts, longest-answer
    cue, twin options, hardness and key source. NULL category is the whole set."""
    flagged = items.select(
        "category", "key", "hardness", "key_source",
        strictly_longest(items).alias("longest"),
        (F.size(F.array_distinct(F.transform(F.map_values("options"), lambda o: F.lower(F.trim(o))))) != N_OPTIONS).alias("twin"),
    )
    sets = [["category", "key"], ["key"], ["category"], [], ["hardness"], ["key_source"]]
    cols = ["category", "key", "hardness", "key_source"]
    # one pass over the items; what follows works on a few rows per category
    agg = flagged.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).alias("m"),
        F.count_if("longest").alias("n_longest"),
        F.count_if("twin").alias("n_twin"),
    )
    bits = {tuple(x): sum(1 << (3 - i) for i, c in enumerate(cols) if c not in x) for x in sets}
    g = lambda *x: F.col("g") == bits[tuple(x)]
    whole = agg.withColumn("total", F.max(F.when(g(), F.col("m"))).over(Window.partitionBy(F.lit(0))))
    share, cue = F.col("m") / F.col("total"), F.col("n_longest") / F.col("m")

    def row(check: str, label: Column, n: Column, part: Column, failed: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), label.cast("string").alias("label"), n.cast("bigint").alias("n"),
            F.round(part, 6).alias("share"), failed.alias("failed"),
        )

    never = F.lit(False)
    rows = F.array(
        F.when(g("category", "key"), row("key letter", F.col("key"), F.col("m"), F.lit(None).cast("double"), never)),
        F.when(g("key"), row("key letter", F.col("key"), F.col("m"), share, share > CHANCE + 0.05)),
        F.when(g("category"), row("longest answer", F.lit("longest"), F.col("n_longest"), cue, cue > CHANCE + 0.15)),
        F.when(g(), row("longest answer", F.lit("longest"), F.col("n_longest"), cue, cue > CHANCE + 0.10)),
        F.when(g(), row("twin options", F.lit("twin"), F.col("n_twin"), F.col("n_twin") / F.col("m"), F.col("n_twin") > 0)),
        F.when(g("hardness") & (F.col("hardness") != ""), row("hardness", F.col("hardness"), F.col("m"), share, never)),
        F.when(g("key_source"), row("key source", F.col("key_source"), F.col("m"), share, never)),
    )
    return whole.select("category", F.explode(rows).alias("r")).where("r is not null").select("category", "r.*")
