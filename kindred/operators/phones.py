"""Phone numbers of all countries in E.164, by a table of calling codes.

The table has (code, region, least, most, trunk): the digits of the calling code, the region's name, how many digits its
national numbers have, and what is dialled before them within the region ('' if nothing). Several regions may share a code. A
number's code is the longest in the table that it begins with, found by a join on its first one, two and three digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import strip

#: Some calling codes, regions, digits of national numbers, trunk prefixes; callers may give a whole table.
CODES = [
    ("1", "US", 10, 10, "1"), ("1", "CA", 10, 10, "1"), ("7", "RU", 10, 10, "8"), ("20", "EG", 8, 10, "0"), ("27", "ZA", 9, 9, "0"), ("30", "GR", 10, 10, ""), ("31", "NL", 9, 9, "0"), ("32", "BE", 8, 9, "0"), ("33", "FR", 9, 9, "0"),
    ("34", "ES", 9, 9, ""), ("39", "IT", 6, 11, ""), ("41", "CH", 9, 9, "0"), ("43", "AT", 4, 13, "0"), ("44", "GB", 9, 10, "0"), ("45", "DK", 8, 8, ""), ("46", "SE", 7, 10, "0"), ("47", "NO", 8, 8, ""), ("48", "PL", 9, 9, ""),
    ("49", "DE", 6, 11, "0"), ("52", "MX", 10, 10, ""), ("55", "BR", 10, 11, "0"), ("61", "AU", 9, 9, "0"), ("64", "NZ", 8, 10, "0"), ("65", "SG", 8, 8, ""), ("81", "JP", 9, 10, "0"), ("82", "KR", 8, 10, "0"), ("86", "CN", 10, 11, "0"),
    ("90", "TR", 10, 10, "0"), ("91", "IN", 10, 10, "0"), ("351", "PT", 9, 9, ""), ("353", "IE", 7, 9, "0"), ("358", "FI", 5, 11, "0"), ("420", "CZ", 9, 9, ""), ("852", "HK", 8, 8, ""), ("971", "AE", 8, 9, "0"), ("972", "IL", 8, 9, "0"),
]


def calling_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODES, "code string, region string, least int, most int, trunk string")


def normalize_phones(records: DataFrame, phone: str, codes: DataFrame, region: Column, name: str = "e164", international: tuple[str, ...] = ("00", "011")) -> DataFrame:
    """Add the number in E.164: `+`, the code and the national number, if its code is in the table and its length is right.

    A number with a plus, or with an international prefix, has a code; any other one is of the region given, whose trunk prefix
    is taken off. What doesn't become a number stays its plus and digits, or its lower-cased text without digits. codes is
    sent to all tasks: a table of calling codes has a few hundred rows.
    """
    text = strip(phone)
    digits = F.regexp_replace(text, "[^0-9]", "")
    plus = text.startswith("+")
    # an international prefix is taken off what then is long enough to be a number with a code
    prefix = f"^(?:{'|'.join(international)})(?=[1-9][0-9]{{6,14}}$)"
    dialled = F.when(plus, digits).when(digits.rlike(prefix), F.regexp_replace(digits, prefix, ""))
    rows = records.withColumn("_text", text).withColumn("_digits", digits).withColumn("_dialled", dialled).withColumn("_region", region)
    by_code = codes.groupBy("code").agg(F.min("least").alias("_least"), F.max("most").alias("_most"))
    for n in (1, 2, 3):
        named = by_code.filter(F.length("code") == n).select(F.col("code").alias(f"_c{n}"), F.col("_least").alias(f"_l{n}"), F.col("_most").alias(f"_m{n}"))
        rows = rows.join(F.broadcast(named), F.substring("_dialled", 1, n) == F.col(f"_c{n}"), "left")
    home = codes.groupBy("region").agg(F.first("code").alias("_code"), F.first("least").alias("_least"), F.first("most").alias("_most"), F.first("trunk").alias("_trunk"))
    rows = rows.join(F.broadcast(home.withColumnRenamed("region", "_home")), F.col("_region") == F.col("_home"), "left")
    found = F.lit(None).cast("string")
    for n in (1, 2, 3):  # the longest code last, so that it is asked first
        size = F.length("_dialled") - n
        found = F.when(F.col(f"_c{n}").isNotNull(), F.when(size.between(F.col(f"_l{n}"), F.col(f"_m{n}")), F.concat(F.lit("+"), "_dialled"))).otherwise(found)
    bare = F.when((F.col("_trunk") != "") & F.col("_digits").startswith(F.col("_trunk")) & (F.length("_digits") - F.length("_trunk")).between(F.col("_least"), F.col("_most")), F.expr("substring(_digits, length(_trunk) + 1)")).otherwise(F.col("_digits"))
    local = F.when(F.length(bare).between(F.col("_least"), F.col("_most")), F.concat(F.lit("+"), "_code", bare))
    kept = F.when(F.col("_digits") != "", F.concat(F.when(F.col("_text").startswith("+"), "+").otherwise(""), "_digits")).otherwise(F.lower("_text"))
    return rows.select(*[F.col(c) for c in records.columns], F.coalesce(F.when(F.col("_dialled").isNotNull(), found).otherwise(local), kept).alias(name))
