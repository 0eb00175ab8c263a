"""CSV read in small ranges against Python's reader."""

import csv
import io
import random

import pytest

from admitlens.sources.ranges import read_csv_ranges


@pytest.mark.parametrize("size", ["300", "5000", "128m"])
def test_ranges(spark, tmp_path, size):
    r, want = random.Random(1), []
    for f in range(3):
        out = io.StringIO()
        end = "\r\n" if f == 1 else "\n"
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "a,b", "t"])
        for i in range(300):
            text = "".join(r.choice(["a", "\n", '"', ",", " ", "é", "\n\n"]) for _ in range(400 if i == 7 else r.randrange(12)))
            row = [f"{f}-{i}", r.choice(["", "x", 'q"q', '"', "a,b"]), text]
            writer.writerow(row)
            want.append((row[0], row[1] or None, row[2] or None, i + 2))
            if r.random() < 0.1:
                out.write(end)
        (tmp_path / f"f{f}.csv").write_bytes(out.getvalue().encode("utf-8-sig" if f == 2 else "utf-8"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = read_csv_ranges(spark, str(tmp_path))
        assert rows.columns == ["id", "a,b", "t", "_line_no"]
        assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_records(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_csv_ranges(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    rows = read_csv_ranges(spark, str(tmp_path / "head.csv"))
    assert rows.columns == ["a", "b", "_line_no"] and rows.count() == 0
