"""Record tables: positions, field types, entity samples, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions import text as X
from kindred.storage import written

FIELD_TYPES = ("text", "categorical", "numeric", "date", "identifier", "email", "phone")

#: Column names that tell a field's type (fixed values).
EMAIL_NAMES = frozenset({"email", "email_address", "e_mail"})
PHONE_NAMES = frozenset({"phone", "phone_number", "mobile", "mobile_phone", "telephone"})
IDENTIFIER_NAMES = frozenset({"id", "identifier", "customer_id", "account_id", "record_id", "external_id", "source_id", "sku", "upc", "code"})


def with_positions(df: DataFrame, order_by: str | list[str], name: str = "pos") -> DataFrame:
    """Number rows from 0 in the order of columns, by a global sort and the counts of its parts (no single-task window).

    The sorted rows are written, as their parts are read twice.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    dealt = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_row", 33)
    sizes = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each part
    starts, before = {}, 0
    for p, n in sizes:
        starts[p] = before
        before += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = F.create_map(*[x for p, n in starts.items() for x in (F.lit(p), F.lit(n))])
    local = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn(name, (table[part] + local).cast("long")).drop("_row")


# -- field types -------------------------------------------------------------------------------------------------


def _type_by_schema(name: str, kind: T.DataType) -> tuple[str, str] | None:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date", "dtype"
    if isinstance(kind, T.BooleanType):
        return "categorical", "dtype"
    if isinstance(kind, T.NumericType):
        return "numeric", "dtype"
    plain = name.strip().lower().replace(" ", "_").replace("-", "_")
    for names, found in ((EMAIL_NAMES, "email"), (PHONE_NAMES, "phone"), (IDENTIFIER_NAMES, "identifier")):
        if plain in names:
            return found, "column_name"
    return None


def infer_field_types(df: DataFrame, order_by: str | None = None, sample_size: int = 100, email_threshold: float = 0.8, phone_threshold: float = 0.8, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """(type, reason) of each column: by its data type, its name, or its first `sample_size` non-blank values.

    The first values are those with the smallest order_by (the first column's order if not given), found with one
    top-k per open column; sample_size of 0 or less takes all values.
    """
    columns = columns or df.columns
    found = {c: _type_by_schema(c, df.schema[c].dataType) for c in columns}
    for c in (c for c, t in found.items() if t is None):
        values = df.select(F.col(order_by or df.columns[0]).alias("o"), X.strip(c).alias("v")).filter("v <> ''")
        if sample_size > 0:
            values = values.orderBy("o", "v").limit(sample_size)
        row = values.agg(F.avg(X.is_email("v").cast("double")).alias("email"), F.avg(X.is_phone("v").cast("double")).alias("phone")).first()
        if row["email"] is not None and row["email"] >= email_threshold:
            found[c] = ("email", "value_pattern")
        elif row["phone"] is not None and row["phone"] >= phone_threshold:
            found[c] = ("phone", "value_pattern")
        else:
            found[c] = ("text", "fallback")
    return [found[c] for c in columns]


def infer_field_type(df: DataFrame, column: str, **options) -> tuple[str, str]:
    return infer_field_types(df, columns=[column], **options)[0]


def field_type_table(df: DataFrame, **options) -> DataFrame:
    """infer_field_types as a table: position, column, field_type, reason."""
    columns = options.get("columns") or df.columns
    rows = [(i, c, t, r) for i, (c, (t, r)) in enumerate(zip(columns, infer_field_types(df, **options)))]
    return df.sparkSession.createDataFrame(rows, "position int, column string, field_type string, reason string")


# -- entity samples ----------------------------------------------------------------------------------------------


def row_signature(columns: list[str]) -> Column:
    """MD5 of the values joined by the unit separator; nulls are skipped, so ('a', null) and (null, 'a') agree."""
    return F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]))


def eligible_entities(df: DataFrame, entity: str, columns: list[str], require_positive_pairs: bool = True, require_variation: bool = False) -> DataFrame:
    """entity_id of the entities with two records or more, and (if asked) with records that differ."""
    rows = df.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity_id"), row_signature(columns).alias("signature"))
    found = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("signature").alias("a"), F.max("signature").alias("b"))
    if require_positive_pairs:
        found = found.filter("n >= 2")
    if require_variation:
        found = found.filter("a <> b")
    return found.select("entity_id")


def sample_entities(df: DataFrame, entity: str, columns: list[str], n_entities: int, seed: int = 0, require_positive_pairs: bool = True, require_variation: bool = False, strict: bool = True) -> DataFrame:
    """The records of a deterministic sample of entities: those first by MD5 of `id:seed`. Fewer than asked is an error if strict."""
    key = F.md5(F.concat(F.col("entity_id").cast("string"), F.lit(f":{seed}")))
    chosen = eligible_entities(df, entity, columns, require_positive_pairs, require_variation).orderBy(key, "entity_id").limit(n_entities)
    if strict and (there := chosen.count()) < n_entities:
        raise ValueError(f"the sample is to have {n_entities} entities, of which there are {there}")
    return df.join(chosen, df[entity] == chosen["entity_id"], "left_semi")


# -- encodings ---------------------------------------------------------------------------------------------------


def zscores(df: DataFrame, columns: list[str], by: list[str] = (), limit: float = 100.0, suffix: str = "_z") -> DataFrame:
    """Standardise numbers by the population's deviation (per group of `by`), cut off at plus and minus the limit."""
    stats = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # without groups: a single row
    for c in columns:
        z = (F.col(c) - F.col(f"_mean_{c}")) / (F.col(f"_std_{c}") + F.lit(1e-20))
        joined = joined.withColumn(c + suffix, F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))))
    return joined.drop(*[f"_{n}_{c}" for c in columns for n in ("mean", "std")])


def categorical_codes(df: DataFrame, column: str, order_by: str, name: str = "code", most: int | None = None) -> DataFrame:
    """Codes from 1 by first appearance; null has none. More categories than `most` are an error."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order_by).alias("_first"))
    coded = with_positions(firsts, ["_first", column], "_pos").select(F.col(column).alias("_value"), (F.col("_pos") + 1).alias(name))
    if most is not None and (there := coded.count()) > most:
        raise ValueError(f"{column} has {there} categories; {most} are allowed")
    return df.join(coded, df[column] == coded["_value"], "left").drop("_value")


def cells(df: DataFrame, record_id: str, field_types: dict[str, str], normalize_identifiers: bool = False) -> DataFrame:
    """One row per cell: record_id, column, field_type, is_missing, number, category, text, date.

    A date that can't be parsed becomes a text.
    """
    parts = []
    for c, kind in field_types.items():
        value = F.col(c)
        missing = X.is_missing(value, df.schema[c].dataType.simpleString())
        date = X.parse_date(value) if kind == "date" else F.lit(None).cast("date")
        is_text = (date.isNull() & ~missing) if kind == "date" else F.lit(kind in ("text", "identifier", "email", "phone"))
        number = value.cast("string").try_cast("double") if kind == "numeric" else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("field_type"),
                missing.alias("is_missing"),
                F.when(~missing, number).alias("number"),
                F.when(~missing & F.lit(kind == "categorical"), value.cast("string")).alias("category"),
                F.when(~missing & is_text, X.identifier_text(kind, value, normalize_identifiers)).alias("text"),
                F.when(~missing, date).alias("date"),
            )
        )
    return df.select(F.col(record_id).alias("record_id"), F.inline(F.array(*parts)))
