"""Packages against the standard library's reader, damaged and unusual ones, and records against the pages."""

import glob
import io
import struct
import zipfile
import zlib
from hashlib import sha1

import pytest
from pyspark.sql import functions as F

from tallywright.llm import warc

SCHEMA = "page_id long, url string, html string, key long, digest string, first string, payload string"


def pages(spark):
    """Equal long payloads (a third of all rows), equal short ones, nulls, empty and long pages, repeated rows, odd names."""
    big, other = "<p>é copy</p>" * 100, "<p>other</p>" * 90
    rows = [(i, f"http://h/{i}", big) for i in range(40)] + [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 200)) for i in range(40, 110)]
    rows += [(200, None, None), (201, "http://h/ \r\nWARC-Type: x", ""), (202, "http://h/é", "x" * 999), (203, "u", "x" * 999), (204, "u", "y" * 1000), (205, "u", "y" * 1000)]
    rows += [(300, "u", other), (300, "u", other), (None, "n", other), (None, "n", "z" * 2000), (None, "n", "z" * 2000), (400, "long", "<b>w</b> " * 700_000)]
    return spark.createDataFrame([(*r, 1, "d", "f", "p") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    top = {}
    for r in rows:
        if r.html is not None and len(r.html.encode()) >= 1000 and r.page_id is not None:
            top[r.html] = max(r.page_id, top.get(r.html, r.page_id))
    out = []
    for r in rows:
        b = (r.html or "").encode()
        first = top.get(r.html)
        revisit = first is not None and first != r.page_id
        out.append((str(r.page_id), len(b), sha1(b).hexdigest(), "revisit" if revisit else "response", str(first) if revisit else None))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    table = pages(spark)
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write(table, path)
    return table, path


def answers(back):
    return sorted(str((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in back)


def test_records_come_back(spark, written):
    table, path = written
    back = warc.records(spark, path).collect()
    assert all(r.intact for r in back) and answers(back) == expected(table.collect())
    texts = {r.html or "" for r in table.collect()}
    assert {r.payload.decode() for r in back if r.payload is not None} == texts
    assert {r.url for r in back if r.key == "201"} == {"http://h/%20%0D%0AWARC-Type:%20x"} and {r.url for r in back if r.key == "200"} == {None}


def test_through_spark_alone(spark, written, monkeypatch):
    table, path = written
    monkeypatch.setattr(warc, "reachable", lambda p: False)
    assert answers(warc.records(spark, path).collect()) == expected(table.collect())


def test_chosen_records_by_range(spark, written):
    _, path = written
    some = warc.entries(spark, path).where("key in ('39', '400')")
    assert sorted((r.key, r.record_type) for r in warc.fetch(some).collect()) == [("39", "response"), ("400", "response")]


def test_packages_are_sound(written):
    _, path = written
    names = 0
    for file in glob.glob(f"{path}/part-*"):
        with open(file, "rb") as f:
            data = f.read()
        if not data:
            continue
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None
            for info in z.infolist():
                assert info.compress_type == zipfile.ZIP_STORED
                names += 1
                if info.filename.startswith(warc.ARCHIVES):
                    assert zlib.decompressobj(wbits=31).decompress(z.read(info)).startswith(b"WARC/1.1\r\n")
    assert names >= 2


def test_empty_table(spark, tmp_path):
    warc.write(pages(spark).where(F.lit(False)), str(tmp_path / "none"))
    assert warc.records(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 7])
@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 inside" + b"x" * 30])
def test_directory(monkeypatch, wide, before, comment):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, method in enumerate([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED]):
            z.writestr(f"archive/é{k}.warc.gz", bytes([65 + k]) * (50 * k + 20), method)
        z.comment = comment
    data = before + out.getvalue()
    assert (warc.END64 in data) == wide
    members = warc.directory(warc.Held(data), len(data))
    assert [(m.name, m.method) for m in members] == [("archive/é0.warc.gz", 0), ("archive/é1.warc.gz", 8), ("archive/é2.warc.gz", 0)]
    for k in (0, 2):
        at = warc.begins(warc.Held(data), members[k])
        assert data[at : at + members[k].size] == bytes([65 + k]) * (50 * k + 20)


def test_no_directory():
    with pytest.raises(ValueError, match="no end"):
        warc.directory(warc.Held(b"x" * 100), 100)
    with pytest.raises(ValueError, match="damaged"):
        warc.directory(warc.Held(b"y" * 60 + warc.END + struct.pack("<HHHHIIH", 0, 0, 1, 1, 46, 10, 0)), 82)
