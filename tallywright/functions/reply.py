"""Reading an answer out of a free-form reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.text import contains_whole_word, let, norm_answer, squeeze

# fixed values: phrases that decline to answer
REFUSAL = [
    "tidak mencantumkan", "tidak tercantum", "tidak disebut",
    "tidak disebutkan", "tidak diketahui", "tidak ada keterangan",
    "tidak memiliki informasi", "tidak punya informasi",
    "tidak menemukan", "tidak dapat memastikan", "tidak bisa memastikan",
    "belum diketahui", "tidak ditemukan", "anonim", "maaf",
]
# fixed values: accepted second spellings of a normalised key
SPELLINGS = {"bhinneka tunggal ika": ["bhineka tunggal ika"]}
# fixed values: words that judge a claim, and words that turn a judgement round
AGREE = ["benar", "tepat"]
DISAGREE = ["salah", "keliru"]
NEGATE = ["tidak", "bukan", "kurang", "belum"]
# fixed values: share of agreement that still counts as the same text
PASS_RATIO = 0.80

# fixed values: patterns that a reply is read by
THINK = r"(?is)<think>(.*?)</think>"
NUMBER = r"-?\d+"
MELODY = r"[#b]*[0-7][',]*_*\.?|-|\|"


def strip_reasoning(reply: Column) -> Column:
    """Reply without its reasoning; an unclosed block leaves no answer."""
    out = F.regexp_replace(reply, THINK, " ")
    return F.when(F.contains(F.lower(out), F.lit("<think>")), F.lit("")).otherwise(
        F.regexp_replace(out, r"^\s+|\s+$", "")
    )


def reasoning_of(reply: Column) -> Column:
    """Closed blocks joined by a rule, or everything after an unclosed tag."""
    edges = r"^\s+|\s+$"
    blocks = F.transform(
        F.regexp_extract_all(reply, F.lit(THINK), F.lit(1)), lambda b: F.regexp_replace(b, edges, "")
    )
    tail = F.regexp_replace(F.regexp_extract(reply, r"(?is)<think>(.*)$", 1), edges, "")
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n---\n")).otherwise(tail)


def verdict(reply: Column) -> Column:
    """First judgement in the reply, turned round by a negator; NULL without one."""
    text = norm_answer(reply)
    pattern = rf"(?:({'|'.join(NEGATE)})\s+)?({'|'.join(AGREE + DISAGREE)})"
    word = F.regexp_extract(text, pattern, 2)
    negated = F.regexp_extract(text, pattern, 1) != ""
    return F.when(word == "", F.lit(None).cast("string")).otherwise(
        F.when(word.isin(AGREE) != negated, F.lit(AGREE[0])).otherwise(F.lit(DISAGREE[0]))
    )


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(0))


def number_matches(reply: Column, gold: Column) -> Column:
    """Gold's first integer is the first or the last integer of the reply."""
    got, want = numbers(reply), numbers(gold)
    first = F.get(want, F.lit(0))
    hit = (first == F.get(got, F.lit(0))) | (first == F.get(got, F.size(got) - 1))
    return F.coalesce(hit, F.lit(False))


def named_keys(reply: Column) -> Column:
    """Sorted set of the key letters a reply names."""
    text = norm_answer(reply)
    before = F.regexp_extract_all(
        text, F.lit(r"(?:do|nada dasar(?:nya)?|bernada dasar|kunci|key)\s+([a-g])(?![a-z])"), F.lit(1)
    )
    # a letter followed by its mode, except where the first form took that letter
    rest = F.regexp_replace(
        text, r"(?:do|nada dasar(?:nya)?|bernada dasar|kunci|key)\s+[a-g](?![a-z])", "1"
    )
    after = F.regexp_extract_all(
        rest, F.lit(r"(?<![a-z])([a-g])\s+(?:mayor|major|minor|mol)(?![a-z])"), F.lit(1)
    )
    found = F.sort_array(F.array_distinct(F.concat(before, after)))
    return F.when((F.size(found) == 0) & text.rlike("^[a-g]$"), F.array(text)).otherwise(found)


def melody_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MELODY), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(norm_answer(text), " "), lambda t: t != "")


def occurrences(tokens: Column) -> Column:
    """Each token with the number of equal ones before it: distinct texts, as many as there are tokens."""

    def numbered(ts: Column) -> Column:
        starts = F.filter(F.transform(ts, lambda t, i: F.when(F.coalesce(F.get(ts, i - 1) != t, F.lit(True)), i)), lambda i: i.isNotNull())

        def runs(at: Column) -> Column:
            def one(s: Column, j: Column) -> Column:
                n = F.coalesce(F.get(at, j + 1), F.size(ts)) - s
                return F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.get(ts, s), F.lit("\u0000"), k.cast("string")))

            return F.flatten(F.transform(at, one))

        return let(starts, runs)

    return let(F.sort_array(tokens), numbered)


def token_f1_arrays(p: Column, g: Column) -> Column:
    """Multiset overlap F1 of two token arrays of a row: one sort of each, and one hashed intersection."""
    common = F.size(F.array_intersect(occurrences(p), occurrences(g))).cast("double")
    n_p, n_g = F.size(p), F.size(g)
    return (
        F.when((n_p == 0) | (n_g == 0), F.when((n_p == 0) & (n_g == 0), F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(common == 0, F.lit(0.0))
        .otherwise(2 * common / (n_p + n_g))
    )


def token_f1(pred: Column, gold: Column) -> Column:
    return token_f1_arrays(tokens(pred), tokens(gold))


def variants(gold: Column) -> Column:
    """The normalised key and its accepted second spellings."""
    extra = F.array().cast("array<string>")
    for key, other in SPELLINGS.items():
        extra = F.when(gold == key, F.array(*[F.lit(o) for o in other])).otherwise(extra)
    return F.concat(F.array(gold), extra)


def contains_key(pred_norm: Column, gold_norm: Column) -> Column:
    """Key, or a second spelling of it, present as whole words."""
    return F.exists(variants(gold_norm), lambda v: contains_whole_word(pred_norm, v))


def rival_named(pred_norm: Column, gold_norm: Column, rival: Column) -> Column:
    """A competing answer is named; one that is part of the key does not count."""
    real = (rival != "") & ~F.contains(gold_norm, rival)
    return real & contains_whole_word(pred_norm, rival)


def contains_key_no_rival(pred: Column, gold: Column, rivals: Column) -> Column:
    p, g = norm_answer(pred), norm_answer(gold)
    return contains_key(p, g) & ~F.exists(rivals, lambda r: rival_named(p, g, r))


def says_no(reply: Column, phrases: list[str] = REFUSAL) -> Column:
    low = F.lower(reply)
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def is_refusal_without_name(reply: Column, rivals: Column, phrases: list[str] = REFUSAL) -> Column:
    """Declines, and names no rival longer than three characters."""
    norm = norm_answer(reply)
    named = F.exists(rivals, lambda r: (F.length(r) > 3) & contains_whole_word(norm, r))
    return says_no(reply, phrases) & ~named


def chosen_letter(reply: Column, options: Column) -> Column:
    """Letter a reply picks from a letter -> text map, '' when ambiguous.

    Leading letter, then labelled letter, then the longest option text that
    occurs (a tie falls through), then exactly one lone letter.
    """
    text = squeeze(F.regexp_replace(strip_reasoning(F.coalesce(reply, F.lit(""))), "[*_`#]+", ""))
    leading = F.regexp_extract(text, r"^\(?([A-E])\)?\s*(?:[.):\-]|$)", 1)
    labelled = F.upper(
        F.regexp_extract(
            text,
            r"(?i)(?:jawaban(?:nya)?|pilihan(?:nya)?|answer)\s*(?:adalah|ialah|:|=)?\s*"
            r"\(?([A-E])\)?(?![A-Za-z])",
            1,
        )
    )
    low = F.lower(text)
    entries = F.filter(
        F.transform(
            F.map_entries(options),
            lambda e: F.struct(
                F.length(F.trim(e["value"])).alias("n"), e["key"].alias("k"), F.lower(F.trim(e["value"])).alias("v")
            ),
        ),
        lambda e: (e["n"] > 0) & F.contains(low, e["v"]),
    )
    ranked = F.reverse(F.sort_array(entries))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    named = F.when(
        (F.size(ranked) == 1) | ((F.size(ranked) > 1) & (best["n"] > second["n"])), best["k"]
    ).otherwise(F.lit(""))
    lone = F.array_intersect(
        F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![A-Za-z])([A-E])(?![A-Za-z])"), F.lit(1))),
        F.map_keys(options),
    )
    only = F.when(F.size(lone) == 1, F.get(lone, F.lit(0))).otherwise(F.lit(""))
    return (
        F.when(text == "", F.lit(""))
        .when(leading != "", leading)
        .when(labelled != "", labelled)
        .when(named != "", named)
        .otherwise(only)
    )
