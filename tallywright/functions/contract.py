"""Ordered rules that a delivered notation file has to keep, read from its text.

Every rule is a column over the whole text; the broken ones come out in the order of the rules. What the caller's house
style names (directives, forbidden directives, the remark that excuses a short file) are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywright.functions.labels import contract_check
from tallywright.functions.text import let


@dataclass(frozen=True)
class Contract:
    """What a file must hold. The defaults are fixed values of the notation's exchange form."""

    mark: str = "%abc-2.1"
    directives: Sequence[str] = ()
    fields: Sequence[str] = ("X", "T", "C", "O", "Q", "M", "L", "K")
    fixed: Mapping[str, str] = field(default_factory=lambda: {"L": "1/8"})
    forbidden: Sequence[str] = ()
    bar_lines: int = 8
    excuse: str | None = None


def _directive(name: str) -> str:
    """A remark line `% name value`; the form with two signs is accepted."""
    return rf"(?m)^%%?[ \t]*{re.escape(name)}[ \t]+(.*)$"


def _field(tag: str) -> str:
    return rf"(?m)^{tag}:(.*)$"


def read_values(text: Column, contract: Contract) -> Column:
    """struct of the directives and fields, trimmed; NULL where there is no such line."""

    def value(pattern: str) -> Column:
        return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))

    names = [(d, _directive(d)) for d in contract.directives] + [(f, _field(f)) for f in contract.fields]
    return F.struct(*[value(p).alias(n) for n, p in names])


def in_order(text: Column, fields: Sequence[str]) -> Column:
    """Do the first lines of the fields that are there stand in this order?"""
    at = F.array(*[F.regexp_instr(text, F.lit(_field(f))) for f in fields])
    return let(F.filter(at, lambda p: p > 0), lambda p: p == F.array_sort(p))


def bar_lines(text: Column) -> Column:
    """Bar lines outside of lyric lines."""
    return F.regexp_count(F.regexp_replace(text, "(?m)^w:.*$", ""), F.lit(r"\|"))


def violations(text: Column, contract: Contract) -> Column:
    """Names of the broken rules, in rule order; a NULL text breaks all that ask for something."""

    def rules(t: Column) -> Column:
        values = read_values(t, contract)
        first = F.trim(F.get(F.split(t, r"\r\n|\r|\n"), F.lit(0)))
        found = [("first line is not the version mark", first == contract.mark)]
        found += [(f"no directive {d}", values[d].isNotNull()) for d in contract.directives]
        for f in contract.fields:
            found.append((f"no field {f}", values[f].isNotNull()))
            found.append((f"field {f} is empty", F.coalesce(values[f], F.lit("-")) != ""))
        found.append(("fields out of order", in_order(t, contract.fields)))
        found += [(f"field {f} is not {v}", F.coalesce(values[f], F.lit("")).isin("", v)) for f, v in contract.fixed.items()]
        if contract.forbidden:
            names = "|".join(map(re.escape, contract.forbidden))
            found.append(("holds a directive that only the build may write", ~t.rlike(rf"(?m)^%%?[ \t]*({names})\b")))
        enough = bar_lines(t) >= contract.bar_lines
        if contract.excuse is not None:
            enough = enough | F.contains(t, F.lit(contract.excuse))
        found.append((f"fewer than {contract.bar_lines} bar lines", enough))
        return contract_check(found)

    return let(F.coalesce(text, F.lit("")), rules)
