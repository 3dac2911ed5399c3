"""Publication by marker, and one file per record."""

import os

import pytest
from pyspark.sql import functions as F

from tallywright.functions import contract
from tallywright.sources import records, staging


def files(root):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, v string")


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_preview_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    assert listed(staging.preview(frame(spark, [(1, "a")]), root, ["id"])) == [(1, "added", 0, 1)] and files(root) == []
    assert staging.publish(frame(spark, [(1, "a"), (2, "b"), (3, "c"), (None, "n")]), root, ["id"]) == 1
    before = files(root)
    new = frame(spark, [(1, "a"), (2, "B"), (4, "d"), (1, "a"), (None, "n")])
    got = sorted(((r.id, r.change, r.old_rows, r.new_rows) for r in staging.preview(new, root, ["id"]).collect()), key=str)
    assert got == [(1, "changed", 1, 2), (2, "changed", 1, 1), (3, "removed", 1, 0), (4, "added", 0, 1)]
    assert files(root) == before and staging.current(spark, root)[0] == 1
    assert staging.preview(frame(spark, [(3, "c"), (2, "b"), (None, "n"), (1, "a")]), root, ["id"]).count() == 0
    assert staging.preview(staging.read_current(spark, root).withColumn("extra", F.lit(1)), root, ["id"]).count() == 4


def test_readers_follow_markers(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        staging.read_current(spark, root)
    staging.publish(frame(spark, [(1, "a")]), root, ["id"])
    staging.stage(frame(spark, [(9, "broken off")]), root)  # an interrupted publisher
    assert listed(staging.read_current(spark, root)) == [(1, "a")]
    old = staging.read_current(spark, root)
    assert staging.publish(frame(spark, [(2, "b")]), root, ["id"], base=1) == 2
    assert listed(staging.read_current(spark, root)) == [(2, "b")] and listed(old) == [(1, "a")]
    assert [tuple(r)[0::2] for r in staging.markers(spark, root).orderBy("number").select("number", "version", "base").collect()] == [(1, 0), (2, 1)]


def test_stale_and_broken_builds_are_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    staging.publish(frame(spark, [(i, "a") for i in range(10)]), root, ["id"])
    staging.publish(frame(spark, [(i, "b") for i in range(10)]), root, ["id"], base=1)
    with pytest.raises(staging.Outdated):
        staging.publish(frame(spark, [(1, "c")]), root, ["id"], base=1)
    with pytest.raises(ValueError, match="fewer than"):
        staging.publish(frame(spark, [(1, "c")]), root, ["id"], least_kept=0.5)
    assert staging.current(spark, root)[0] == 2


def test_two_publishers_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    staging.publish(frame(spark, [(1, "a")]), root, ["id"])
    real = staging.stage

    def racing(df, place):
        monkeypatch.setattr(staging, "stage", real)
        staging.publish(frame(spark, [(2, "rival")]), place, ["id"])
        return "zzz" if not real(df, place) else _named(df, place)

    def _named(df, place):  # a version name that is greater than any other
        df.write.parquet(os.path.join(place, "versions", "zzz"))
        return "zzz"

    monkeypatch.setattr(staging, "stage", racing)
    with pytest.raises(staging.Outdated):
        staging.publish(frame(spark, [(3, "late")]), root, ["id"])
    assert listed(staging.read_current(spark, root)) == [(2, "rival")]


def test_one_file_per_record(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = [(1, "plain", "a\nb\n"), (2, "é + 50% #x", "no end"), (3, "empty", ""), (4, "null", None), (5, "cr", "a\r\nb"), (6, "blank lines", "\n\n")]
    records.save_file_per_record(spark.createDataFrame(rows, "id long, name string, text string"), "id", "name", "text", path)
    got = sorted((r.id, r.name, r.text) for r in records.scan_file_per_record(spark, path).collect())
    assert got == [(i, n, t or "") for i, n, t in rows]
    assert records.one_file_per_id(records.scan_file_per_record(spark, path)).count() == 6


def test_a_repeated_id_is_fatal(spark, tmp_path):
    for name in ("7_one.abc", "7_two.abc", "8_three.abc", "notes.abc", "9_four.txt"):
        (tmp_path / name).write_text(f"X:1\n{name}\n")
    found = records.scan_file_per_record(spark, str(tmp_path))
    assert sorted((r.id, r.name, r.text) for r in found.collect()) == [(7, "one", "X:1\n7_one.abc\n"), (7, "two", "X:1\n7_two.abc\n"), (8, "three", "X:1\n8_three.abc\n")]
    with pytest.raises(Exception, match="7_one.abc 7_two.abc"):
        records.one_file_per_id(found).collect()
    assert records.one_file_per_id(found.where("id > 7")).count() == 1


def test_contract(spark):
    house = contract.Contract(directives=("key-note",), fixed={"L": "1/8"}, forbidden=("own-id",), excuse="% chords")
    good = "%abc-2.1\n% key-note do = C\nX:1\nT:t\nC:-\nO:-\nQ:-\nM:4/4\nL:1/8\nK:C\n" + "a | " * 8 + "\nw: | | |"
    bar = "fewer than 8 bar lines"
    cases = {
        good: [], good.replace("% key-note", "%%key-note"): [], good.replace("%abc-2.1", "%abc"): ["first line is not the version mark"],
        good.replace("C:-\n", "C:\n"): ["field C is empty"], good.replace("C:-\n", ""): ["no field C"], good.replace("a | " * 8, "a | "): [bar],
        good.replace("a | " * 8, "% chords"): [], good.replace("X:1\nT:t\n", "T:t\nX:1\n"): ["fields out of order"], good.replace("L:1/8", "L:1/4"): ["field L is not 1/8"],
        good + "\n% own-id 5": ["holds a directive that only the build may write"], good.replace("% key-note do = C\n", ""): ["no directive key-note"],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, "", None])], "i int, t string")
    got = [r.v for r in df.select("i", contract.violations(F.col("t"), house).alias("v")).orderBy("i").collect()]
    assert got[: len(cases)] == list(cases.values())
    assert got[-1] == got[-2] and len(got[-1]) == 11 and got[-1][-1] == bar
    values = df.where("i = 0").select(contract.read_values(F.col("t"), house).alias("v")).first().v
    assert values["key-note"] == "do = C" and values.M == "4/4" and values.T == "t"
