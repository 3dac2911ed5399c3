"""Free-form questions from records.

An item row holds record, category, question, answer, key_source and unit. The
unit names the content an item uses up, NULL when wording alone separates the
two sides. Families are unions of narrow projections: no shuffle until the
items are assembled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.hashing import seeded_key, seeded_number
from tallywright.functions.text import gives_away, is_content_word, is_missing, let, words_of
from tallywright.operators.choices import pick_other_values
from tallywright.operators.excerpts import (
    COUNT_BARS,
    EXCERPT_BARS,
    Notes,
    highest_in_excerpt,
    picked_excerpts,
    tiling_excerpts,
    window_text,
)

ITEM = ["record", "category", "question", "answer", "key_source", "unit"]
# categories whose answer may stand in the question
ANSWER_MAY_APPEAR = ["highest_note", "count_bars", "title_to_bars", "kind"]
REASONING = ["highest_note", "count_bars"]
# fixed values: false claims per fact on the training side, blanks per line
FALSE_CLAIMS = 4
BLANKS_PER_LINE = 3
BLANK = "____"


@dataclass(frozen=True)
class Fact:
    """One attribute to ask about; {name} and {value} are filled in."""

    category: str
    column: str
    abstain: str | None = None
    answer: str = "{value}"
    printed_if: str | None = None


def fill(template: str, **parts: Column) -> Column:
    """A template with its {names} replaced by columns."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def wordings(templates: Mapping[str, Sequence[str]], category: str, side: str) -> list[str]:
    """All wordings of a category on the training side, the first on the test side."""
    every = list(templates[category])
    return every if side == "train" else every[:1]


def fact_items(
    records: DataFrame, key: str, name: str, facts: Sequence[Fact], templates: Mapping[str, Sequence[str]], side: str
) -> DataFrame:
    """One question per filled attribute and wording; a blank attribute asks for
    an honest refusal instead, and an inferred one is not asked at all."""
    rows = []
    for fact in facts:
        value = F.col(fact.column).cast("string")
        blank = is_missing(value)
        for wording in wordings(templates, fact.category, side):
            asked = F.struct(
                F.when(blank, F.lit(f"{fact.category}_abstain")).otherwise(F.lit(fact.category)).alias("category"),
                fill(wording, name=F.col(name)).alias("question"),
                F.when(blank, fill(fact.abstain, name=F.col(name)) if fact.abstain else F.lit(None))
                .otherwise(fill(fact.answer, value=F.trim(value)))
                .alias("answer"),
            )
            shown = F.lit(True) if fact.printed_if is None else F.expr(fact.printed_if)
            rows.append(F.when(shown, asked))
    exploded = records.select(F.col(key).alias("record"), F.explode(F.array(*rows)).alias("x"))
    return exploded.where("x is not null and x.answer is not null").select(
        "record", "x.*", F.lit("printed").alias("key_source"), F.lit(None).cast("string").alias("unit")
    )


def verify_items(
    records: DataFrame, key: str, name: str, facts: Sequence[tuple[str, str, str]], templates: Sequence[str], side: str, seed: int | str
) -> DataFrame:
    """True/false claims. facts: (category, column, phrase).

    Every wording states the truth; false claims take one wording each, one
    rival on the test side and up to four distinct ones in training.
    """
    asked = list(templates) if side == "train" else list(templates)[:1]
    out = None
    for category, column, phrase in facts:
        filled = records.where(~is_missing(F.col(column).cast("string"))).select(
            F.col(key).alias("record"), F.col(name).alias("name"), F.trim(F.col(column).cast("string")).alias("value")
        )
        said = lambda w, v, p=phrase: fill(w, name=F.col("name"), phrase=F.lit(p), value=v)
        true_rows = F.array(
            *[
                F.struct(
                    said(w, F.col("value")).alias("question"),
                    F.concat(F.lit("True. "), "name", F.lit(f" {phrase} "), "value", F.lit(".")).alias("answer"),
                )
                for w in asked
            ]
        )
        rivals = pick_other_values(
            filled, ["record"], [], "value", filled, FALSE_CLAIMS if side == "train" else 1, f"{seed}-{category}",
            out="rivals", at_most=True,
        )
        texts = F.array(*[F.lit(w) for w in asked])
        false_rows = F.transform(
            "rivals",
            lambda r, i: F.struct(
                F.replace(
                    F.replace(
                        F.replace(F.element_at(texts, i % len(asked) + 1), F.lit("{name}"), F.col("name")),
                        F.lit("{phrase}"), F.lit(phrase),
                    ),
                    F.lit("{value}"), r,
                ).alias("question"),
                F.concat(
                    F.lit("False. "), F.col("name"), F.lit(f" {phrase} "), F.col("value"), F.lit(", not "), r, F.lit(".")
                ).alias("answer"),
            ),
        )
        both = filled.select("record", F.explode(true_rows).alias("x")).unionByName(
            rivals.select("record", F.explode(false_rows).alias("x"))
        )
        family = both.select(
            "record", F.lit(f"verify_{category}").alias("category"), "x.question", "x.answer",
            F.lit("printed").alias("key_source"), F.lit(None).cast("string").alias("unit"),
        )
        out = family if out is None else out.unionByName(family)
    return out


def item(category: str, question: Column, answer: Column, source: str, unit: Column, record: str = "record") -> list[Column]:
    return [
        F.col(record).alias("record"), F.lit(category).alias("category"), question.alias("question"),
        answer.alias("answer"), F.lit(source).alias("key_source"), unit.alias("unit"),
    ]


def unit_key(kind: str, *parts: Column) -> Column:
    """The content an item uses up, as one string."""
    return F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts])


def excerpt_to_title_items(
    records: DataFrame, key: str, title: str, bars: str, template: str, limit: int | None, seed: int | str, notes: Notes
) -> DataFrame:
    cut = picked_excerpts(
        records.select(F.col(key).alias("record"), F.col(title).alias("title"), F.col(bars).alias("bars")),
        "record", "bars", EXCERPT_BARS, limit, seed, notes,
    )
    return cut.select(
        *item("excerpt_to_title", fill(template, excerpt=F.col("excerpt")), F.col("title"), "computed", unit_key("excerpt", F.col("excerpt")))
    )


def _numbered(records: DataFrame, key: str, lines: str, cols: Mapping[str, str]) -> DataFrame:
    """(record, cols, i, line, next): a line carries its successor, not the text."""
    pairs = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.get(F.col(lines), i + 1).alias("next")))
    return records.select(
        F.col(key).alias("record"), *[F.col(c).alias(a) for a, c in cols.items()], F.explode(pairs).alias("x")
    ).select("record", *cols, "x.*")


def below(i: Column, limit: int | None) -> Column:
    """Is position i within the limit? No limit takes every line."""
    return F.lit(True) if limit is None else i < limit


def line_to_title_items(records: DataFrame, key: str, title: str, lines: str, template: str, limit: int | None = None) -> DataFrame:
    """Line to title, without lines that give the title away."""
    rows = _numbered(records, key, lines, {"title": title}).where(below(F.col("i"), limit))
    kept = rows.where(~gives_away(F.col("title"), F.col("line")))
    return kept.select(
        *item("line_to_title", fill(template, line=F.col("line")), F.col("title"), "printed", unit_key("line", F.col("record"), F.col("i")))
    )


def next_line_items(records: DataFrame, key: str, name: str, lines: str, template: str, limit: int | None = None) -> DataFrame:
    rows = _numbered(records, key, lines, {"name": name}).where(below(F.col("i"), limit) & F.col("next").isNotNull())
    return rows.select(
        *item(
            "next_line", fill(template, name=F.col("name"), line=F.col("line")), F.col("next"), "printed",
            unit_key("pair", F.col("record"), F.col("i")),
        )
    )


def blanked(words: Column, at: Column) -> Column:
    return F.array_join(F.transform(words, lambda w, j: F.when(j == at, F.lit(BLANK)).otherwise(w)), " ")


def cloze_items(
    records: DataFrame, key: str, name: str, lines: str, template: str, limit: int | None, seed: int | str
) -> DataFrame:
    """Lines of four words or more; up to three inner content words that occur
    once in the line are blanked, each in an item of its own."""
    rows = _numbered(records, key, lines, {"name": name}).where(below(F.col("i"), limit))
    split = rows.withColumn("ws", words_of(F.col("line"))).where(F.size("ws") >= 4)
    # equal words are neighbours once sorted, so a word that occurs once differs from both of its own
    placed = F.array_sort(F.transform("ws", lambda w, j: F.struct(w.alias("w"), j.alias("j"))))

    def single(ps: Column) -> Column:
        def other(p: Column, i: Column) -> Column:
            return ~F.get(ps, i)["w"].eqNullSafe(p["w"])

        last = F.size(ps) - 1
        alone = F.filter(ps, lambda p, i: other(p, i - 1) & other(p, i + 1))
        inner = F.filter(alone, lambda p: (p["j"] > 0) & (p["j"] < last) & is_content_word(p["w"]))
        return F.transform(inner, lambda p: F.struct(seeded_key(seed, F.col("record"), F.col("i"), p["j"]).alias("h"), p["j"].alias("j"), p["w"].alias("w")))

    spots = let(placed, single)
    cut = split.withColumn("s", F.explode(F.slice(F.sort_array(spots), 1, BLANKS_PER_LINE)))
    return cut.select(
        *item(
            "cloze", fill(template, name=F.col("name"), line=blanked(F.col("ws"), F.col("s.j"))), F.col("s.w"), "printed",
            unit_key("cloze", F.col("record"), F.col("i"), F.col("s.j")),
        )
    )


def recall_items(
    records: DataFrame, key: str, name: str, lines: str, text: str, bars: str,
    templates: Mapping[str, Sequence[str]], side: str, limit: int | None = None,
) -> DataFrame:
    """Title to whole text, to its n-th line, and to bars a to b."""
    base = records.select(
        F.col(key).alias("record"), F.col(name).alias("name"), F.col(lines).alias("ls"), F.trim(text).alias("text"), F.col(bars).alias("bars")
    )
    asked = F.array(*[F.lit(w) for w in wordings(templates, "title_to_text", side)])
    whole = base.where(F.size("ls") > 0).select("record", "name", "text", F.explode(asked).alias("w")).select(
        *item("title_to_text", F.replace("w", F.lit("{name}"), F.col("name")), F.col("text"), "printed", F.lit(None).cast("string"))
    )
    nth = base.select("record", "name", F.posexplode("ls").alias("i", "line")).where(below(F.col("i"), limit)).select(
        *item(
            "title_to_line",
            fill(templates["title_to_line"][0], name=F.col("name"), n=(F.col("i") + 1).cast("string")),
            F.col("line"), "printed", unit_key("line", F.col("record"), F.col("i")),
        )
    )
    tiles = tiling_excerpts(base.select("record", "name", "bars"), "bars", EXCERPT_BARS).select(
        *item(
            "title_to_bars",
            fill(
                templates["title_to_bars"][0], name=F.col("name"), a=F.col("first_bar").cast("string"),
                b=F.col("last_bar").cast("string"),
            ),
            F.col("excerpt"), "computed", unit_key("bars", F.col("record"), F.col("start"), F.col("n")),
        )
    )
    return whole.unionByName(nth).unionByName(tiles)


def counted_excerpts(records: DataFrame, key: str, bars: str, limit: int | None, seed: int | str) -> DataFrame:
    """(record, n, excerpt): `limit` seeded lengths out of the counting range,
    each with one seeded window."""
    base = records.select(F.col(key).alias("record"), F.col(bars).alias("bars"))
    b = F.col("bars")
    lengths = F.sort_array(
        F.transform(
            F.filter(F.array(*[F.lit(n) for n in COUNT_BARS]), lambda n: F.size(b) >= n),
            lambda n: F.struct(seeded_key(f"{seed}-length", F.col("record"), n).alias("h"), n.alias("n")),
        )
    )

    def cut(n: Column) -> Column:
        start = seeded_number(f"{seed}-at", F.col("record"), n) % (F.size(b) - n + 1)
        return F.struct(n.alias("n"), window_text(b, start, n).alias("excerpt"))

    windows = F.transform(lengths if limit is None else F.slice(lengths, 1, limit), lambda x: cut(x["n"]))
    return base.select("record", F.explode(windows).alias("x")).select("record", "x.*")


def reasoning_items(
    records: DataFrame, key: str, bars: str, templates: Mapping[str, Sequence[str]], limit: int | None, seed: int | str, notes: Notes
) -> DataFrame:
    """Highest note of a shown excerpt, and how many bars one has."""
    base = records.select(F.col(key).alias("record"), F.col(bars).alias("bars"))
    cut = picked_excerpts(base, "record", "bars", EXCERPT_BARS, limit, seed).withColumn("notes", notes(F.col("excerpt")))
    unit = unit_key("excerpt", F.col("excerpt"))
    high = cut.where(F.size("notes") > 0).select(
        *item("highest_note", fill(templates["highest_note"][0], excerpt=F.col("excerpt")), highest_in_excerpt(F.col("notes")), "computed", unit)
    )
    counts = counted_excerpts(base, "record", "bars", limit, seed).where(F.size(notes(F.col("excerpt"))) > 0).select(
        *item("count_bars", fill(templates["count_bars"][0], excerpt=F.col("excerpt")), F.col("n").cast("string"), "computed", unit)
    )
    return high.unionByName(counts)


def assemble_side(families: Sequence[DataFrame], reserved: DataFrame | None = None) -> DataFrame:
    """All families without empty answers, reserved content and questions that
    answer themselves; the level is tagged."""
    items = families[0].select(*ITEM)
    for family in families[1:]:
        items = items.unionByName(family.select(*ITEM))
    exempt = F.col("category").isin(ANSWER_MAY_APPEAR)
    kept = items.where(F.trim("answer") != "").where(exempt | ~gives_away(F.col("answer"), F.col("question")))
    if reserved is not None:
        kept = kept.join(reserved.select("unit"), "unit", "left_anti").select(*ITEM)
    level = F.when(F.col("category").isin(REASONING), F.lit("reasoning")).otherwise(F.lit("recall"))
    return kept.withColumn("level", level)


def content_units(items: DataFrame) -> DataFrame:
    """(unit): the content the items use up."""
    return items.where("unit is not null").select("unit").distinct()


def template_lint(templates: DataFrame) -> DataFrame:
    """(rule, category, wording) of a template table (category, side, is_base,
    wording): train wording also on the test side, a wording repeated, a
    paraphrase equal to its base."""
    test = templates.where("side = 'test'").select("wording").distinct()
    crossing = templates.where("side = 'train'").join(test, "wording", "left_semi").select(
        F.lit("train wording on the test side").alias("rule"), "category", "wording"
    )
    para = templates.where("side = 'train' and not is_base")
    twice = para.groupBy("category", "wording").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("wording repeated").alias("rule"), "category", "wording"
    )
    base = templates.where("side = 'train' and is_base").select("category", "wording")
    same = para.select("category", "wording").distinct().join(base, ["category", "wording"], "left_semi").select(
        F.lit("paraphrase equals base").alias("rule"), "category", "wording"
    )
    return crossing.distinct().unionByName(twice).unionByName(same)
