"""Jobs that must fail, and the same jobs with their fault mended."""

import pytest
from pyspark.sql import functions as F

from tallywright.operators import gates

ITEMS = [(1, "c", {"A": "x", "B": "y"}, "A"), (2, "c", {"A": "x", "B": "y"}, "B")]
TEMPLATES = [("a", "train", True, "Who?"), ("a", "train", False, "By whom?"), ("a", "test", True, "Whose?")]


def items(spark):
    return spark.createDataFrame(ITEMS, "id int, category string, options map<string,string>, key string")


def builds(spark, sha):
    return spark.createDataFrame([("r.jsonl", "q", sha)], "file string, question_file string, sha string"), spark.createDataFrame([("q", "now")], "question_file string, sha string")


def choices(spark, preds, sha="now"):
    said = spark.createDataFrame(preds, "run string, id int, reply string")
    return gates.scored_choices(said, items(spark), *builds(spark, sha), "id")


GOOD = [("r", 1, "A"), ("r", 2, "A")]


def test_choices_pass(spark):
    assert sorted((r.id, r.correct) for r in choices(spark, GOOD).collect()) == [(1, 1), (2, 0)]


@pytest.mark.parametrize(
    ("preds", "sha", "said"),
    [
        (GOOD, "old", "files of another build: 1"),
        (GOOD, "", "files of another build: 1"),
        (GOOD[:1], "now", "runs that miss items: 1"),
        ([*GOOD, ("s", 1, "A"), ("s", 9, "B")], "now", "runs that miss items: 1"),
        ([("r", 7, "A")], "now", "runs that miss items: 1"),  # nothing is scored, and still refused
    ],
)
def test_choices_are_refused(spark, preds, sha, said):
    with pytest.raises(Exception, match=said):
        choices(spark, preds, sha).collect()
    with pytest.raises(Exception, match="refused"):
        choices(spark, preds, sha).write.format("noop").mode("overwrite").save()


def test_old_builds_may_be_allowed(spark):
    headers, manifest = builds(spark, "")
    assert gates.passed(headers, gates.build_gate(headers, manifest, False)).count() == 1


def test_unmatched_and_moved_predictions(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "b")], "ord int, slot string")
    short, foreign, moved = ([(1, "a")], [(1, "a"), (2, "z")], [(1, "b"), (2, "a")])
    frame = lambda rows: spark.createDataFrame(rows, "ord int, slot string")
    assert gates.passed(frame(short), gates.matched_gate(frame(short), keys, ["slot"])).count() == 1
    with pytest.raises(Exception, match="predictions without a key: 1"):
        gates.passed(frame(foreign), gates.matched_gate(frame(foreign), keys, ["slot"])).collect()
    with pytest.raises(Exception, match="predictions in another order: 2"):
        gates.passed(frame(moved), gates.order_gate(frame(moved), keys, ["slot"], "ord")).collect()
    assert gates.passed(frame(short), gates.order_gate(frame(short), keys, ["slot"], "ord")).count() == 1


def sides(spark, train, test, regime="split", templates=TEMPLATES, reserved=None):
    frame = lambda rows: spark.createDataFrame(rows, "record int, question string, unit string")
    tr, te = frame(train), frame(test)
    words = spark.createDataFrame(templates, "category string, side string, is_base boolean, wording string")
    return gates.checked_sides(tr, te, frame(reserved or test).select("unit"), frame(train + test), regime, words)


def test_clean_sides(spark):
    for regime, train, test in (("split", [(1, "q1", "u1")], [(2, "q2", "u2")]), ("all", [(1, "q1", "u1"), (2, "q3", "u3")], [(1, "q2", "u2"), (2, "q4", None)])):
        tr, te = sides(spark, train, test, regime)
        assert tr.count() == len(train) and te.count() == len(test)


@pytest.mark.parametrize(
    ("train", "test", "regime", "templates", "reserved", "said"),
    [
        ([(1, "q1", "u1")], [(1, "q2", "u2")], "split", TEMPLATES, None, "records on both sides: 1"),
        ([(1, "q1", "u1")], [(1, "q2", "u2"), (2, "q3", "u3")], "all", TEMPLATES, None, "records without a training item: 1"),
        ([(1, "q1", "u1")], [(2, "q2", "u2")], "split", TEMPLATES, [(2, "q2", "u1")], "reserved content in training: 1"),
        ([(1, "q1", "u1")], [(2, "q1", "u2")], "split", TEMPLATES, None, "same question on both sides: 1"),
        ([(1, "q1", "u1")], [(2, "q2", "u2")], "split", [*TEMPLATES, ("b", "test", True, "By whom?")], None, "train wording on the test side: 1"),
        ([(1, "q1", "u1"), (2, "q3", "u3")], [(1, "q2", "u2"), (2, "q4", "u4")], "all", [*TEMPLATES, ("a", "train", False, "Who?")], None, "paraphrase equals base: 1"),
        ([(1, "q1", "u1")], [(2, "q2", "u2")], "split", [*TEMPLATES, ("a", "train", False, "By whom?")], None, "wording repeated: 1"),
    ],
)
def test_leaking_sides_are_refused(spark, train, test, regime, templates, reserved, said):
    for side in sides(spark, train, test, regime, templates, reserved):
        with pytest.raises(Exception, match=said):
            side.agg(F.count(F.lit(1))).collect()


def test_a_gate_that_says_nothing_has_not_passed(spark):
    unknown = spark.createDataFrame([("a", 1, True), ("b", None, None)], "gate string, value bigint, passed boolean")
    with pytest.raises(Exception, match="refused: b: unknown"):
        gates.passed(spark.range(0), unknown).collect()
    assert gates.passed(spark.range(3), unknown.where("passed")).count() == 3
