"""CSV with quoted line breaks, cut into splits at every place, against Python's csv module."""

import csv
import io
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from bazaarscope.sources import raw_csv
from bazaarscope.sources.split_csv import read_split_csv, records

SCHEMA = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "text", "end")])


@pytest.fixture
def small_splits(spark):
    """Splits of the given number of bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def cut(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")

    yield cut
    for k, v in before.items():
        spark.conf.set(k, v)


def text_of(rows, end="\n", header=("id", "text", "end")):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows([header, *rows])
    return out.getvalue()


def read(spark, path):
    rows = read_split_csv(spark, str(path), SCHEMA, raw_csv.CSV_OPTIONS)
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: int(r[0]))


def nasty(rng, n):
    pieces = ["a", "b c", "\n", "\n\n", '"', '""', ",", "é", "\r\n", "x" * 30, '"\n"', "\n,\n"]
    return [(str(i), "t" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))), "z") for i in range(n)]


@pytest.mark.parametrize("size", [13, 64, 500, 1 << 20])
def test_any_split_gives_the_same_records(spark, tmp_path, small_splits, size):
    rows = nasty(random.Random(size), 60)
    path = tmp_path / "rows.csv"
    path.write_bytes(text_of(rows).encode())
    small_splits(size)
    assert read(spark, path) == rows


def test_break_and_doubled_quotes_on_the_border(spark, tmp_path, small_splits):
    """Every border of one split lies on each byte of a quoted break once."""
    for pad in range(16):
        rows = [("1", "p" * (pad + 1), "z"), ("2", 'he said ""no""\n\n"\n"', "z"), ("3", "q", "\n")]
        path = tmp_path / f"{pad}.csv"
        path.write_bytes(text_of(rows).encode())
        small_splits(24)
        assert read(spark, path) == rows


def test_files_line_ends_and_blank_lines(spark, tmp_path, small_splits):
    small_splits(40)
    (tmp_path / "a.csv").write_bytes(text_of([("1", "x\r\ny", "z"), ("2", "w", "z")], "\r\n").encode())
    (tmp_path / "b.csv").write_bytes(("﻿" + text_of([("3", "v\n" * 40, "z")]) + "\n\n").encode())
    (tmp_path / "c.csv").write_bytes(b"id,text,end\n")
    assert read(spark, tmp_path) == [("1", "x\r\ny", "z"), ("2", "w", "z"), ("3", "v\n" * 40, "z")]


@pytest.mark.parametrize("text", [
    'id,text,end\n1,"open,z\n2,b,z\n', "id,text,end\n1,a,z,more\n", "id,text,end\n1,a\n", "id,end,text\n1,a,z\n",
])
def test_malformed_files_stop(spark, tmp_path, text):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        read(spark, path)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = nasty(random.Random(9), 4000)
    path = tmp_path / "rows.csv"
    path.write_bytes(text_of(rows).encode())
    small_splits(path.stat().st_size // 8)
    found = records(spark, str(path))
    lines = spark.read.option("lineSep", "\n").text(str(path))
    assert lines.rdd.getNumPartitions() >= 4
    assert found.where("is_head").count() == 1
    whole = spark.read.options(**raw_csv.CSV_OPTIONS).option("multiLine", True).schema(SCHEMA).csv(str(path))
    # the whole-file reader turns no line end inside quotes into another
    assert read(spark, path) == sorted((tuple(r) for r in whole.collect()), key=lambda r: int(r[0]))
