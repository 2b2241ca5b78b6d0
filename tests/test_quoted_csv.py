"""Quoted files in ranges against Spark's reader, which takes a file in one task."""

import csv
import random
from collections import Counter

import pytest

from candora.sources import quoted_csv, reviews


def both(spark, path):
    want = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    got = quoted_csv.read_quoted_csv(spark, path)
    assert got.columns == want.columns
    rows = Counter(map(tuple, got.collect()))
    assert rows == Counter(map(tuple, want.collect()))
    return sum(rows.values())


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("long", [0, 4000])
def test_line_breaks_inside_quotes(spark, tmp_path, small_splits, long):
    rng = random.Random(5)
    piece = lambda: rng.choice(["a", "b c", '"', ",", "\n", "\n\n", "é", "", "x, y", '""', " "])
    for k in range(3):
        with open(tmp_path / f"part-{k}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["review_id", "re, view", "rating"])
            for i in range(150):
                text = "".join(piece() for _ in range(rng.randrange(0, 9))).strip(" ")
                text += "line\n" * (rng.randrange(0, long) if long and i % 50 == 7 else 0)  # spans many splits
                writer.writerow([f"{k}-{i}", f"t{text}t", rng.randrange(5)])
    assert both(spark, str(tmp_path)) == 450
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10


def test_edges(spark, tmp_path, small_splits):
    (tmp_path / "crlf.csv").write_bytes(b'\xef\xbb\xbfa,b\r\n1,x\r\n\r\n2,"y\nz"\r\n3\r\n"",""\r\n4,last')
    got = [tuple(r) for r in quoted_csv.read_quoted_csv(spark, str(tmp_path / "crlf.csv")).collect()]
    assert sorted(got, key=str) == sorted([("1", "x"), ("2", "y\nz"), ("3", None), ("", ""), ("4", "last")], key=str) or sorted(got, key=str) == sorted(
        [("1", "x"), ("2", "y\nz"), ("3", None), (None, None), ("4", "last")], key=str
    )
    (tmp_path / "empty.csv").write_bytes(b"")
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_bytes(b"a,b\n")
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]
    (tmp_path / "open.csv").write_bytes(b'a,b\n1,"never\nclosed\n2,x\n')
    assert quoted_csv.read_quoted_csv(spark, str(tmp_path / "open.csv")).count() == 1


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rating,text\n1,x\n")
    (tmp_path / "b.csv").write_text("text,rating\nx,1\n")
    with pytest.raises(ValueError):
        reviews.ingest_reviews(spark, str(tmp_path), "d")
