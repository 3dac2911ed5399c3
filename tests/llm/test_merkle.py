"""The manifest against a tree that is built level by level, and on odd rows."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, tree string, digest string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, change=lambda t: t):
    return sha256("".join(field(change(row[c]) if c == "text" and row[c] is not None else row[c]) for c in FIELDS).encode()).hexdigest()


def up(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha256("".join(levels[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = ""
    for level in levels[:-1]:
        out += "".join(level[k] for k in range(i - i % 8, min(i - i % 8 + 8, len(level))) if k != i)
        i //= 8
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lows = {}
    for g in order:
        ordered = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        lows[g] = (ordered, up([leaf(r) for r in ordered]))
    high = up([lows[g][1][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        ordered, levels = lows[g]
        for i, r in enumerate(ordered):
            out.append((r["doc_id"], leaf(r), levels[-1][0], high[-1][0], siblings(levels, i) + siblings(high, j)))
    return sorted(map(str, out))


def proofs(docs, height):
    return merkle.prove(docs, merkle.leaf([F.col(c) for c in FIELDS]), carry=[merkle.leaf([F.col(c) if c != "text" else F.upper(c) for c in FIELDS]).alias("other")], height=height)


def table(spark, n):
    """Half of all rows in one group, a null group, lone leaves, repeated rows, null keys, empty and long texts."""
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else [None, "fr", "é", ""][i // 2 % 4]
        rows.append((i * 7 % n, None if i % 11 == 0 else "" if i % 13 == 0 else f"Text {i} é" * (i % 5 + 1), lang, None if i % 5 == 0 else "s", i, 1, "x", None))
    rows += [(None, "no key", "en", "s", 3, 1, "x", "y")] * 3 + [(5, "twice", "de", None, None, 1, "x", "y")] * 2 + [(1, "long " * 200_000, "only", "s", 1, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "height"), [(1, 4), (9, 1), (700, 1), (700, 2), (700, 4)])
def test_against_plain_levels(spark, n, height):
    docs = table(spark, n)
    got = proofs(docs, height).collect()
    mine = sorted(str((r.doc_id, r.digest.hex(), r.subroot.hex(), r.root.hex(), r.others.hex())) for r in got)
    assert mine == expected([r.asDict() for r in docs.collect()])


def test_folding_finds_changed_rows(spark):
    made = proofs(table(spark, 300), 2)
    same = merkle.folded(made, "digest").where("folded <> root or folded is null").count()
    changed = merkle.folded(made.where("other <> digest"), "other").where("folded = root").count()
    assert (same, changed) == (0, 0) and made.where("other <> digest").count() > 200


def test_empty_table(spark):
    docs = table(spark, 9).where("false")
    assert proofs(docs, 4).collect() == []


@pytest.mark.parametrize("height", range(1, 7))
def test_layout_is_a_permutation_with_halves_together(height):
    spots = [merkle.address(height, d, np.arange(8**d)) for d in range(height)]
    assert sorted(np.concatenate(spots).tolist()) == list(range((8**height - 1) // 7))
    upper = height // 2
    if upper:  # the upper half stands first, the lower subtrees follow one by one
        size, below = (8**upper - 1) // 7, (8 ** (height - upper) - 1) // 7
        assert max(s.max() for s in spots[:upper]) == size - 1
        assert spots[upper].tolist() == [size + k * below for k in range(8**upper)]
