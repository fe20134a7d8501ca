"""Small reference tables: places, nicknames, area codes, checks of result manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACES = "country_code string, postal_code string, place_name string, admin_name1 string, admin_code1 string, admin_name2 string, admin_code2 string, admin_name3 string, admin_code3 string, latitude string, longitude string, accuracy string"


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """postal_code, city, state from a tab-separated file without header; rows that lack one are left out."""
    df = spark.read.schema(_PLACES).option("sep", "\t").option("quote", "").csv(path)
    return df.select("postal_code", F.col("place_name").alias("city"), F.col("admin_code1").alias("state")).dropna()


def nickname_aliases(triplets: DataFrame) -> DataFrame:
    """name, aliases (sorted): symmetric, not transitive; from rows (name1, relationship, name2)."""
    plain = lambda c: F.lower(F.regexp_replace(c, "^\\s+|\\s+$", ""))
    pairs = triplets.filter("relationship = 'has_nickname'").select(plain("name1").alias("name"), plain("name2").alias("alias")).filter("name <> '' and alias <> '' and name <> alias")
    both = pairs.union(pairs.select("alias", "name"))
    return both.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


#: State codes that area codes are kept for: the states and the federal district (fixed values).
STATES = tuple("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split())


def area_codes(df: DataFrame, code: str = "Area Code", region: str = "Region") -> DataFrame:
    """state, codes (ascending) of three-digit area codes."""
    kept = df.select(F.trim(F.col(f"`{region}`")).alias("state"), F.trim(F.col(f"`{code}`")).alias("code")).filter(F.col("state").isin(*STATES) & F.col("code").rlike("^[0-9]{3}$"))
    return kept.groupBy("state").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def general_area_codes(codes: DataFrame) -> DataFrame:
    """One row, codes: those of all states."""
    return codes.select(F.explode("codes").alias("code")).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def with_lookup(df: DataFrame, key: Column, table: DataFrame, table_key: str, value: str, default: Column, name: str) -> DataFrame:
    """Add a looked-up value, or the default; the table is small (checked: 100,000 rows) and is sent to all tasks."""
    small = table.limit(100_001)
    if small.count() > 100_000:
        joined = df.withColumn("_key", key).join(table.select(F.col(table_key).alias("_key"), F.col(value).alias("_value")), "_key", "left")
    else:
        joined = df.withColumn("_key", key).join(F.broadcast(table.select(F.col(table_key).alias("_key"), F.col(value).alias("_value"))), "_key", "left")
    return joined.withColumn(name, F.coalesce("_value", default)).drop("_key", "_value")


def missing_paths(df: DataFrame, column: str, existing: list[str]) -> list[str]:
    """The distinct paths that a result table names and that don't exist (of a bounded list of checkpoints)."""
    named = df.select(F.col(column).alias("path")).filter("path is not null").distinct()
    return sorted(r["path"] for r in named.filter(~F.col("path").isin(*existing)).collect())
