"""CSV files in many splits against Python's reader."""

import csv
import io
import random

import pytest

from kindred.sources import catalog, csvsplit


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def table(rng, n, breaks="\n"):
    pieces = ["a", "", 'he said "no"', f"two{breaks}lines", f"{breaks}{breaks}", ",", '"', "é日", "  x ", f'"{breaks}",', "plain words here"]
    return [[str(i), *["".join(rng.choice(pieces) for _ in range(rng.randint(1, 3))) for _ in range(3)]] for i in range(n)]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_in_many_splits(spark, tmp_path, small_splits, ending):
    rows = table(random.Random(len(ending)), 300, ending)
    rows[150][2] = f"x{ending}" * 900  # a field over several splits
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=ending).writerows([["id", "a", "b", "c d"], *rows])
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode())
    lines = csvsplit._lines(spark, str(tmp_path / "t.csv"))
    assert lines.select("start").distinct().count() > 20 and lines.rdd.getNumPartitions() > 20
    df = catalog.read_text_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "a", "b", "c d"]
    found = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
    assert [[x or "" for x in r] for r in found] == rows


def test_same_as_spark_reads_whole_files(spark, tmp_path, small_splits):
    text = "﻿id,name,note\n" + "".join(f'{i},n{i},5" disk\n{i + 1000},"a ""b""\nc",\n\n{i + 2000},"",short\n{i + 3000},only\n' for i in range(40)) + "9,last,no end of line"
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(text)
    path = str(tmp_path / "*.csv")
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    assert catalog.read_text_csv(spark, path).columns == ["id", "name", "note"]
    assert sorted(map(repr, catalog.read_text_csv(spark, path).collect())) == sorted(repr(r).replace("\\ufeff", "") for r in whole.collect())


def test_latin_1_and_empty_files(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("id;x\n1;café\n2;\"ü\nß\"\n".encode("latin-1"))
    assert sorted(tuple(r) for r in catalog.read_text_csv(spark, str(tmp_path / "l.csv"), sep=";").collect()) == [("1", "café"), ("2", "ü\nß")]
    (tmp_path / "h.csv").write_text("id,x\n")
    assert catalog.read_text_csv(spark, str(tmp_path / "h.csv"), ["x"]).count() == 0


@pytest.mark.parametrize("line,states", [(b'a,"b', (True, False)), (b'a""b,c', (False, True)), (b'"a""', (True, False)), (b'x",y', (False, False)), (b'x","y', (True, True)), (b"plain", (False, True)), (b"", (False, True)), (b'""', (False, True))])
def test_states(line, states):
    assert (csvsplit.state_after(line, False), csvsplit.state_after(line, True)) == states
