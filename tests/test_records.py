import datetime

import pytest

from kindred.functions import text as X
from kindred.operators import records as R


def types(df, **options):
    return R.infer_field_types(df, **options)


def test_field_types_of_seven_columns(spark):
    df = spark.createDataFrame(
        [("a@example.com", "+1 (202) 555-0100", "A-1", datetime.datetime(2024, 1, 1), 1.5, True, "first note"), ("b@example.com", "202-555-0101", "A-2", datetime.datetime(2024, 1, 2), 2.5, False, "second note")],
        "email string, contact_no string, sku string, created_at timestamp, amount double, active boolean, notes string",
    )
    assert types(df) == [("email", "column_name"), ("phone", "value_pattern"), ("identifier", "column_name"), ("date", "dtype"), ("numeric", "dtype"), ("categorical", "dtype"), ("text", "fallback")]


@pytest.mark.parametrize(
    ("values", "expected"),
    [(["a@example.com", "not email"], ("text", "fallback")), (["a@example.com", "b@example.com"], ("email", "value_pattern")), (["", "   ", "a@example.com"], ("email", "value_pattern")), ([None, None], ("text", "fallback"))],
)
def test_field_types_by_values(spark, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, contact string")
    assert R.infer_field_type(df, "contact", order_by="i") == expected


def test_only_the_first_values_count(spark):
    df = spark.createDataFrame([(i, f"u{i}@example.com" if i < 3 else "x") for i in range(20)], "i int, v string")
    assert R.infer_field_type(df, "v", order_by="i", sample_size=3) == ("email", "value_pattern")
    assert R.infer_field_type(df, "v", order_by="i", sample_size=0) == ("text", "fallback")


def test_entity_sample(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), (None, "x"), (None, "y")], "e string, v string")
    keep = lambda **o: {r["e"] for r in R.sample_entities(df, "e", ["v"], **o).collect()}
    assert keep(n_entities=2) == {"a", "b"}
    assert keep(n_entities=1, require_variation=True) == {"b"}
    with pytest.raises(ValueError, match="there are 2"):
        R.sample_entities(df, "e", ["v"], 3)


def test_positions_and_codes(spark):
    df = spark.createDataFrame([(9 - i, "abacabadab"[i]) for i in range(10)], "k int, v string").repartition(5)
    assert [r["pos"] for r in R.with_positions(df, "k").orderBy("k").collect()] == list(range(10))
    codes = {r["v"]: r["code"] for r in R.categorical_codes(df, "v", "k").collect()}
    assert codes == {"b": 1, "a": 2, "d": 3, "c": 4}
    with pytest.raises(ValueError, match="4 categories"):
        R.categorical_codes(df, "v", "k", most=3)
    assert R.with_positions(df.filter("k < 0"), "k").count() == 0


def test_zscores_of_constant_and_missing(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 1.0), (3, 5.0, 3.0)], "i int, a double, b double")
    out = {r["i"]: (r["a_z"], r["b_z"]) for r in R.zscores(df, ["a", "b"]).collect()}
    assert out == {1: (0.0, None), 2: (0.0, -1.0), 3: (0.0, 1.0)}


def test_cells_route_by_type(spark):
    df = spark.createDataFrame([(1, "2024-02-29", "7", " AB  c "), (2, "soon", None, None)], "i int, d string, n string, k string")
    rows = {(r["record_id"], r["column"]): r for r in R.cells(df, "i", {"d": "date", "n": "numeric", "k": "identifier"}, True).collect()}
    assert rows[1, "d"]["date"] == datetime.date(2024, 2, 29) and rows[1, "d"]["text"] is None
    assert rows[2, "d"]["text"] == "soon" and not rows[2, "d"]["is_missing"]
    assert rows[1, "n"]["number"] == 7.0 and rows[2, "n"]["is_missing"]
    assert rows[1, "k"]["text"] == "ab c"


@pytest.mark.parametrize(
    ("value", "expected"),
    [("(202) 555-0100", "+12025550100"), ("1-202-555-0100", "+12025550100"), ("+44 20 7946 0958", "+442079460958"), ("12", "12"), ("none", "none"), (" N/A ", "n/a")],
)
def test_normalize_phone(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(X.normalize_phone("v")).first()[0] == expected


def test_values(spark):
    df = spark.createDataFrame([("$1,234.50", " Ada ", "", "José", "3.0"), ("nan", None, None, None, None)], "p string, a string, b string, n string, i string")
    out = df.select(X.clean_numeric_text("p"), X.combine_text(df, ["a", "b", "zzz"]), X.name_token("n"), X.normalize_id("i"), X.clean_missing("p"), X.source_key("A", "i"), X.serialize_colval(["a"]), X.serialize_record(["id", "a", "b"])).collect()
    assert tuple(out[0]) == (1.0, "Ada", "jose", "3", "$1,234.50", "A:3.0", "COL a VAL Ada", "a: Ada")
    assert tuple(out[1]) == (None, None, "user", "", None, "A:nan", "COL a VAL ", "")


def test_prompt_and_answer(spark):
    df = spark.createDataFrame([("r", ["x", "y"], "I say [2]"), ("r", ["x", "y"], "[3]"), ("r", ["x"], None)], "a string, c array<string>, t string")
    assert "[1] x\n[2] y\n" in df.select(X.make_prompt("a", "c")).first()[0]
    import pyspark.sql.functions as F

    assert [r[0] for r in df.select(X.parse_prediction("t", F.size("c"))).collect()] == [2, 0, 0]
