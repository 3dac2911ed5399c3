"""Normalisation, predicates and extraction over single text columns."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
#: Stands at word ends in a marked text.
EDGE = "\u0001"

# fixed values: cells that mean "the source leaves this blank"
MISSING = ["", "-", "–", "—"]
HEADER_MISSING = ["", "-"]

# fixed values: function words that make a cloze answerable by grammar alone
STOPWORDS = [
    "yang", "di", "ke", "dari", "dan", "atau", "itu", "ini", "pada", "untuk",
    "dengan", "akan", "ada", "aku", "kau", "kita", "kami", "mu", "ku", "nya",
    "tak", "tidak", "sudah", "telah", "juga", "saja", "pun", "lah", "kah",
    "para", "se", "si", "oh", "o", "hai", "la", "sang", "adalah", "dalam",
]


# fixed values: the first syllable, and how many vowels and tails a lead is written with
HANGUL, VOWELS, TAILS = 0xAC00, 21, 28


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """(accented, plain, multi): compatibility forms without combining marks, over all planes.

    `accented[i]` folds to `plain[i]`; combining marks sit behind the end of `plain`, which is how translate() is told
    to delete them. `multi` spells a character with several. Hangul syllables are computed and in no table.
    """
    single: dict[str, str] = {}
    multi: dict[str, str] = {}
    marks = []
    for point in [*range(0xA0, HANGUL), *range(0xD7A4, 0xD800), *range(0xF900, sys.maxunicode + 1)]:
        char = chr(point)
        if not (unicodedata.combining(char) or unicodedata.decomposition(char)):
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if flat == char:
            continue
        if not flat:
            marks.append(char)
        elif len(flat) == 1:
            single[char] = flat
        else:
            multi[char] = flat
    return "".join([*single, *marks]), "".join(single.values()), multi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it, also behind pushed-down filters."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """value, for a column of its own in a select: no filter or lambda behind it works it out again.

    Spark moves a filter below the columns it names and puts what they are made of at each mention, also inside lambdas;
    not below an explode.
    """
    return F.explode(F.array(value))


def _letters_of_syllable(char: Column) -> Column:
    """Lead, vowel and tail of one Hangul syllable."""
    at = F.ascii(char) - HANGUL

    def letter(first: int, n: int, i: Column) -> Column:
        return F.get(F.split(F.lit(" ".join(chr(first + k) for k in range(n))), " "), i.cast("int"))

    tail = F.when(at % TAILS == 0, F.lit("")).otherwise(letter(0x11A7, TAILS, at % TAILS))
    return F.concat(letter(0x1100, 19, F.floor(at / (VOWELS * TAILS))), letter(0x1161, VOWELS, F.floor(at / TAILS) % VOWELS), tail)


def fold_accents(text: Column) -> Column:
    """Compatibility fold without combining marks.

    ASCII texts are returned as they are. Characters that are spelled with several are looked for by translate(), whose
    table is hashed, and only the rows that hold one, or a Hangul syllable, are taken apart.
    """
    accented, plain, multi = _fold_table()
    rare = "".join(multi)
    table = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")  # one folded literal

    def spelled(t: Column) -> Column:
        letters = F.transform(
            F.split(t, ""),
            lambda c: F.when(F.octet_length(c) < 2, c)
            .when(F.translate(c, rare, "") == "", F.element_at(table, c))
            .when(c.between("\uac00", "\ud7a3"), _letters_of_syllable(c))
            .otherwise(c),
        )
        return F.array_join(letters, "")

    def fold(t: Column) -> Column:
        holds = (F.length(F.translate(t, rare, "")) < F.length(t)) | t.rlike("[\uac00-\ud7a3]")
        return F.when(F.octet_length(t) == F.length(t), t).otherwise(
            F.translate(F.when(holds, spelled(t)).otherwise(t), accented, plain)
        )

    return let(text, fold)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def norm_answer(text: Column) -> Column:
    """Fold case, accents and punctuation; keep word characters and / # ,"""
    spaced = F.translate(F.lower(fold_accents(text)), "-'", "  ")
    return squeeze(F.regexp_replace(spaced, rf"[^{WORD}\s/#,]", " "))


def norm_title(text: Column) -> Column:
    return squeeze(F.lower(text))


def norm_loose(text: Column) -> Column:
    """Lower case with every run of non-word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[^{WORD}]+", " "))


def norm_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def slugify(text: Column, keep_extension: bool = False) -> Column:
    """Accent-free lower-case name with runs of other characters as one underscore."""

    def slug(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")

    if not keep_extension:
        return slug(text)
    ext = F.lower(F.regexp_extract(text, r"(\.[A-Za-z0-9]+)$", 1))
    return F.concat(slug(F.regexp_replace(text, r"\.[A-Za-z0-9]+$", "")), ext)


def is_missing(text: Column, values: list[str] = MISSING) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).isin(values)


def blank_to_empty(text: Column, values: list[str] = MISSING) -> Column:
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.when(clean.isin(values), F.lit("")).otherwise(clean)


def marked(text: Column) -> Column:
    """The text with a mark at both ends and around every character that is no part of a word."""
    return F.concat(F.lit(EDGE), F.regexp_replace(text, rf"([^{WORD}])", f"{EDGE}$1{EDGE}"), F.lit(EDGE))


def contains_whole_word(hay: Column, needle: Column) -> Column:
    """Literal needle bounded by non-word characters.

    Between marks, word ends are characters like others, so no pattern is made from the needle; what is marked is
    marked by one constant pattern, and only for rows that hold the needle at all.
    """
    return F.contains(hay, needle) & F.contains(marked(hay), marked(needle))


def flat(text: Column) -> Column:
    """Whole-word flattened text, padded so that contains() respects word ends."""
    body = F.trim(F.regexp_replace(F.lower(fold_accents(text)), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), body, F.lit(" "))


def gives_away(answer: Column, prompt: Column) -> Column:
    """Does the prompt already contain the answer, on flattened whole words?"""
    return let(flat(answer), lambda key: (F.trim(key) != "") & F.contains(flat(prompt), key))


def bare_word(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, rf"[^{WORD}'-]", ""))


def is_content_word(word: Column, stop: list[str] = STOPWORDS) -> Column:
    bare = bare_word(word)
    return (F.length(bare) > 2) & ~bare.isin(stop)


def lines_of(text: Column) -> Column:
    """Non-empty trimmed lines, in order."""
    return F.filter(
        F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.trim(line)), lambda line: line != ""
    )


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def header_field(text: Column, tag: str) -> Column:
    """Trimmed value of the first `TAG:` line, '' when there is none."""
    return F.trim(F.regexp_extract(text, rf"(?m)^{tag}:(.*)$", 1))


def directive(text: Column, name: str) -> Column:
    """Trimmed value of the first `% name value` line."""
    return F.trim(F.regexp_extract(text, rf"(?m)^%\s*{name}[ \t]+(.*)$", 1))


def canonical_key_letter(header: Column, printed: Column) -> tuple[Column, Column]:
    """(letter, note): one letter from the header, or from the printed value.

    The note says that the two sources disagree or that neither names a key.
    """
    from_header = F.upper(F.regexp_extract(F.trim(header), r"^([A-Ga-g])", 1))
    from_print = F.upper(F.regexp_extract(printed, r"(?i)do\s*=\s*([A-G])", 1))
    letter = F.when(from_header != "", from_header).otherwise(from_print)
    note = (
        F.when(letter == "", F.lit("no key"))
        .when((from_header != "") & (from_print != "") & (from_header != from_print), F.lit("sources disagree"))
        .otherwise(F.lit(""))
    )
    return letter, note


def split_quoted_tempo(text: Column) -> Column:
    """`"word" number` becomes `word (number)`; anything else is only trimmed."""
    return F.trim(F.regexp_replace(F.trim(text), r'^"([^"]*)"\s*(\S.*)$', "$1 ($2)"))


def unfence(text: Column, marker: str) -> Column:
    """Fenced block holding the marker, else the longest block, else the text."""
    blocks = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?s)```[^\n`]*\n(.*?)```"), F.lit(1)), lambda b: F.trim(b)
    )
    marked = F.filter(blocks, lambda b: F.contains(b, F.lit(marker)))
    # longest first, the earlier one on a tie
    ranked = F.sort_array(
        F.transform(blocks, lambda b, i: F.struct((-F.length(b)).alias("n"), i.alias("i"), b.alias("b")))
    )
    return (
        F.when(F.size(marked) > 0, F.get(marked, F.lit(0)))
        .when(F.size(blocks) > 0, F.get(ranked, F.lit(0)).getField("b"))
        .otherwise(F.trim(text))
    )


def quoted_part(question: Column) -> Column:
    """Text after the first blank line, the whole question without one."""
    at = F.instr(question, "\n\n")
    return F.when(at > 0, F.substr(question, at + 2)).otherwise(question)


def display_name(unique: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(unique), F.lit("")), title)
