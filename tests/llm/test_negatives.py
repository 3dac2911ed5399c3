"""Mined negatives against brute force, and packed products of any width against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, key long, score long, parts string, lane int"


def brute(rows):
    table = {}
    for v, e, label in rows:
        if v is None or e is None or label is None or any(x is None or not math.isfinite(x) or abs(256 * x) > negatives.LIMIT for x in e):
            continue
        row = ((label + 1) % 10 if v % 7 == 0 else label, [math.floor(256 * x) for x in e])
        table[v] = min(row, table.get(v, row))
    out = []
    for a, (la, ea) in table.items():
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(ea, eb, strict=True)), b, lb) for b, (lb, eb) in table.items() if b != a and len(ea) == len(eb)]
        for ps, p, _ in sorted(s for s in scored if s[2] == la)[:5]:
            able = sorted(s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(able, 1)]
    return sorted(out)


def mined(spark, data, **sizes):
    table = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in data], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(table, F.col("vec_id") % 100 == 0, label=label, **sizes)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_rows(n, dims, seed, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(dims)] for _ in range(6)]
    return [(k, [x + rng.gauss(0, scale / 4) for x in centres[rng.randrange(6)]], rng.randrange(10)) for k in range(n)]


@pytest.mark.parametrize(("rows", "group"), [(64, 2), (2048, 512)])
def test_against_brute_force(spark, rows, group):
    table = random_rows(700, 8, 1)
    table += [(1000 + k, list(table[3][1]), k % 10) for k in range(350)]  # a third are copies of one vector: ties by key
    want = brute(table)
    assert len(want) > 100 and mined(spark, table, rows=rows, group=group) == want


def test_odd_rows(spark):
    table = random_rows(120, 3, 2)
    table += [(None, [1.0, 2.0, 3.0], 1), (200, None, 1), (201, [1.0, None, 2.0], 1), (202, [float("nan"), 0.0, 0.0], 1), (203, [float("inf"), 0.0, 0.0], 1), (204, [1.0, 1.0, 1.0], None)]
    table += [(300, [], 1), (301, [], 1), (302, [], 2), (400, [0.0] * 3, 4), (500, [1.0, 2.0], 1), (501, [1.0, 2.0], 1), (503, [1.0, 1.9], 3), (600, [1e300, 0.0, 0.0], 1)]
    table += [(100, [9.0, 9.0, 9.0], 5)] * 2 + [(100, [-9.0, 9.0, 9.0], 5), (700, [9.0, 9.0, 9.5], 5), (701, [-9.0, 8.0, 9.0], 6), (702, [-9.0, 9.0, 9.0], 5)]
    assert mined(spark, table) == brute(table)


def test_no_rows(spark):
    assert mined(spark, [(5, None, 1)]) == []


@pytest.mark.parametrize("scale", [1, 300, 60_000, 16_000_000, 10**9])
def test_packed_products(scale):
    rng = np.random.default_rng(scale)
    for dims in (0, 1, 16):
        block = rng.integers(-scale, scale + 1, (37, dims))
        packed = negatives.Packed(block)
        for anchor in rng.integers(-scale, scale + 1, (5, dims)):
            want = [sum(int(x) * int(y) for x, y in zip(row, anchor, strict=True)) for row in block]
            if max(map(abs, want), default=0) < 1 << 63:
                assert packed.scores(anchor).tolist() == want
