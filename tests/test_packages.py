"""Workbooks and archives as data sources: round trips, links, limits, checksums, commit and abort."""

import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from terravane.sources import packages as P

ROWS = "book string, sheet string, k int, name string, site string"


def written(spark, path, form, rows):
    P.write_packages(spark.createDataFrame(rows, ROWS), form, str(path), "book", "sheet", [F.desc("k")])


def rows(n=3):
    return [(f"b{b}", s, k, f"näme <{k}> & \"x\"" if k else None, f"https://e.org/{b}?a=1&b={k}" if k % 2 else "none") for b in range(2) for s in ("Actors", "Events & more") for k in range(n)]


def test_workbooks(spark, tmp_path):
    written(spark, tmp_path / "out", "workbook", rows())
    assert sorted(os.listdir(tmp_path / "out")) == ["b0.xlsx", "b1.xlsx"]
    read = spark.read.format("workbook").load(str(tmp_path / "out"))
    assert read.rdd.getNumPartitions() == 4  # a sheet each
    got = sorted((os.path.basename(r.path)[:2], r.sheet, r.row_number, int(r["values"]["k"]), r["values"].get("name"), r["values"]["site"], dict(r.links)) for r in read.collect())
    want = sorted((b, s, 4 - k, k, n, u, {"site": u} if k % 2 else {}) for b, s, k, n, u in rows())
    assert got == want


def test_too_many_rows_leave_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="more than 1000 rows"):
        written(spark, tmp_path / "out", "workbook", [*rows(), *[("b9", "Actors", k, "x", "y") for k in range(1000)]])
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="4001 characters"):
        written(spark, tmp_path / "out", "workbook", [("b", "s", 1, "x" * 4001, "y")])


def test_long_and_odd_files_are_refused(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    body = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>v{i}</t></is></c></row>' for i in range(1, 1003))
    data = P.workbook({"s": [["a"]]}, ["h"])
    with zipfile.ZipFile(tmp_path / "in/long.xlsx", "w") as z, zipfile.ZipFile(__import__("io").BytesIO(data)) as base:
        for n in base.namelist():
            z.writestr(n, f'<worksheet xmlns="{P._MAIN}"><sheetData>{body}</sheetData></worksheet>' if n.endswith("sheet1.xml") else base.read(n))
    with pytest.raises(Exception, match="more than 1000 rows"):
        P.register(spark)
        spark.read.format("workbook").load(str(tmp_path / "in")).count()
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no archive"):
        spark.read.format("workbook").load(str(tmp_path / "bad.xlsx")).count()


def test_zipped_lines(spark, tmp_path):
    written(spark, tmp_path / "out", "zipped_lines", [("z", f"{s}.txt", k, f"n{k}", "u") for s in "ab" for k in range(3)])
    P.register(spark)
    read = spark.read.format("zipped_lines").load(str(tmp_path / "out"))
    assert read.rdd.getNumPartitions() == 2
    assert sorted((r.member, r.line_number, r.line) for r in read.collect()) == sorted((f"{s}.txt", n, line) for s in "ab" for n, line in enumerate(["k|name|site", "2|n2|u", "1|n1|u", "0|n0|u"], 1))
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a.txt", "one\n")
        z.writestr(P.SUMS, hashlib.sha256(b"two\n").hexdigest() + "  a.txt\n")
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("zipped_lines").load(str(tmp_path / "bad.zip")).collect()
    with pytest.raises(Exception, match="separator"):
        written(spark, tmp_path / "out2", "zipped_lines", [("z", "a.txt", 1, "a|b", "u")])
    assert not os.path.exists(tmp_path / "out2") or os.listdir(tmp_path / "out2") == []
