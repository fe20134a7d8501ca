"""Closures and layers of edge tables; phones by calling codes."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import dag, phones


def test_closures_and_layers_equal_walks(spark):
    rng = random.Random(6)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b}
    edges |= {(100 + i, 101 + i) for i in range(14)}  # a long chain
    df = spark.createDataFrame([*edges, *list(edges)[:5], (None, 3), (4, None)], "parent long, child long")
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)

    def walk(start, gone=()):
        found, front, n = {}, {start}, 0
        while front:
            n += 1
            front = {b for a in front for b in below.get(a, ()) if b not in found and b not in gone}
            found |= dict.fromkeys(front, n)
        return found

    starts = spark.createDataFrame([(0,), (5,), (100,), (5,), (None,)], "node long")
    wanted = {(s, n, k) for s in (0, 5, 100) for n, k in walk(s).items()}
    assert {tuple(r) for r in dag.closure(df, starts).collect()} == wanted
    up = {(r["node"], r["start"], r["distance"]) for r in dag.closure(df, starts.filter("node = 100").union(spark.createDataFrame([(30,), (114,)], "node long")), up=True).collect()}
    assert up == {(a, b, k) for a in {x for e in edges for x in e} for b, k in walk(a).items() if b in (100, 30, 114)}
    gone = {n for n in range(0, 40, 6)} | {108}
    blocked = spark.createDataFrame([(n,) for n in gone], "node long")
    wanted = {n for s in (5, 100) for n in walk(s, gone)} - {5, 100}
    assert {r["node"] for r in dag.descendants(df, starts.filter("node > 0"), blocked=blocked).collect()} == wanted

    def layer(n):
        return max((layer(a) + 1 for a, b in edges if b == n), default=0)

    every = {x for e in edges for x in e} | {77}
    assert {tuple(r) for r in dag.layers(df, spark.createDataFrame([(77,), (100,)], "node long")).collect()} == {(n, layer(n)) for n in every}


def test_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "parent long, child long")
    with pytest.raises(ValueError, match="cycle through, or above, 2, 3, 4"):
        dag.layers(df)
    assert {tuple(r) for r in dag.closure(df, spark.createDataFrame([(2,)], "node long")).collect()} == {(2, 3, 1), (2, 2, 2), (2, 4, 2)}
    none = dag.closure(df.limit(0), spark.createDataFrame([(2,)], "node long"))
    assert none.count() == 0 and dag.layers(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,region,wanted",
    [
        ("+44 20 7946 0958", "US", "+442079460958"), ("020 7946 0958", "GB", "+442079460958"), ("0044 20 7946 0958", "FR", "+442079460958"), ("011 49 30 901820", "US", "+4930901820"), ("(212) 555-0123", "US", "+12125550123"),
        ("1-212-555-0123", "US", "+12125550123"), ("+351 912 345 678", "US", "+351912345678"), ("06 12 34 56 78", "FR", "+33612345678"), ("+33 12", "US", "+3312"), ("12345", "US", "12345"), ("Call Me", "US", "call me"),
        ("+999 1234567", "US", "+9991234567"), (None, "US", None), ("", "US", ""), ("612345678", "ES", "+34612345678"), ("555", None, "555"), ("+1 212 555 0123", None, "+12125550123"),
    ],
)
def test_phones(spark, text, region, wanted):
    df = spark.createDataFrame([(1, text, region)], "id int, p string, r string")
    (row,) = phones.normalize_phones(df, "p", phones.calling_codes(spark), F.col("r")).collect()
    assert row["e164"] == wanted and list(row.asDict()) == ["id", "p", "r", "e164"]
