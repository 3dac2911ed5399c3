"""Pieces of SQL shared by the oracle queries."""

from __future__ import annotations


def md5(seed, *cols: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def num(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 8) AS BIGINT)"


def number(seed, *cols: str) -> str:
    return num(md5(seed, *cols))


def fold(x: str) -> str:
    return f"strip_accents({x})"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def norm(x: str) -> str:
    inner = rf"regexp_replace(replace(replace(lower(strip_accents({x})), '-', ' '), '''', ' '), '[^\p{{L}}\p{{N}}_\s/#,]', ' ', 'g')"
    return squeeze(inner)


def flat(x: str) -> str:
    return f"(' ' || trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def gives_away(answer: str, prompt: str) -> str:
    return f"(trim({flat(answer)}) <> '' AND contains({flat(prompt)}, {flat(answer)}))"


def whole_word(hay: str, needle: str) -> str:
    return (
        rf"(contains({hay}, {needle}) AND regexp_matches({hay}, '(^|[^\p{{L}}\p{{N}}_])' || "
        rf"regexp_escape({needle}) || '([^\p{{L}}\p{{N}}_]|$)'))"
    )


def lines(x: str) -> str:
    return rf"[trim(l) for l in regexp_split_to_array({x}, '\r\n|\r|\n') if trim(l) <> '']"


def words(x: str) -> str:
    return rf"[w for w in regexp_split_to_array({x}, '\s+') if w <> '']"


def edges(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
