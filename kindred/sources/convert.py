"""Conversions of raw matching data to single tables with an entity id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as X
from kindred.operators.graph import connected_components


@dataclass(frozen=True)
class TableMap:
    """How one table of a two-table data set becomes rows: its id column, and for each output column its source columns.

    A value is one column, several to join as text, or ('number', column) for the first number in it.
    """

    id_column: str
    columns: dict[str, str | tuple[str, ...]] = field(default_factory=dict)

    def apply(self, df: DataFrame, table: str) -> DataFrame:
        df = X.clean_frame(df)

        def value(spec: str | tuple[str, ...]) -> Column:
            if isinstance(spec, str):
                return F.col(spec) if spec in df.columns else F.lit(None).cast("string")
            if spec and spec[0] == "number":
                return X.clean_numeric_text(spec[1]) if spec[1] in df.columns else F.lit(None).cast("double")
            return X.combine_text(df, list(spec))

        return df.select(F.lit(table).alias("source_table"), F.col(self.id_column).alias("source_id"), X.source_key(table, self.id_column).alias("_key"), *[value(s).alias(n) for n, s in self.columns.items()])


#: Two-table data sets by name: what becomes of tables A and B.
CONVERSIONS: dict[str, tuple[TableMap, TableMap]] = {
    "amazon_google": (
        TableMap("id", {"title": "title", "description": "description", "manufacturer": "manufacturer", "price": "price"}),
        TableMap("id", {"title": "name", "description": "description", "manufacturer": "manufacturer", "price": "price"}),
    ),
    "dblp_acm": (TableMap("id", {c: c for c in ("title", "authors", "venue", "year")}), TableMap("id", {c: c for c in ("title", "authors", "venue", "year")})),
    "dblp_google_scholar": (TableMap("id", {c: c for c in ("title", "authors", "venue", "year")}), TableMap("id", {c: c for c in ("title", "authors", "venue", "year")})),
    "fodors_zagats": (TableMap("id", {c: c for c in ("name", "addr", "city", "phone", "type")}), TableMap("id", {c: c for c in ("name", "addr", "city", "phone", "type")})),
    "walmart_amazon": (
        TableMap("id", {"title": "title", "brand": "brand", "modelno": "modelno", "price": ("number", "price"), "category": "category", "description": ("shortdescr", "longdescr")}),
        TableMap("id", {"title": "title", "brand": "brand", "modelno": "modelno", "price": ("number", "price"), "category": "category", "description": ("proddescrshort", "proddescrlong")}),
    ),
}


def assign_entities(records: DataFrame, edges: DataFrame, name: str, key: str = "_key", left: str = "left_key", right: str = "right_key") -> DataFrame:
    """Add entity_id `name:i` from match edges; i numbers the records' components by their smallest key, in string order.

    Edges may name keys that no record has; they still connect.
    """
    from kindred.operators.records import with_positions

    nodes = records.select(F.col(key).alias("node"))
    loops = nodes.select(F.col("node").alias(left), F.col("node").alias(right))
    roots = connected_components(edges.select(left, right).unionByName(loops), left, right)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    here = roots.join(nodes, "node", "left_semi").select("root").distinct()
    numbered = with_positions(least.join(here, "root"), "least", "_i")
    named = roots.join(numbered, "root").select(F.col("node").alias(key), F.concat(F.lit(f"{name}:"), F.col("_i").cast("string")).alias("entity_id"))
    return records.join(named, key)


def convert_linkage(table_a: DataFrame, table_b: DataFrame, matches: DataFrame, name: str, maps: tuple[TableMap, TableMap] | None = None, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """One table from two and their matches: entity_id, source_table, source_id, fields."""
    a, b = maps or CONVERSIONS[name]
    rows = a.apply(table_a, "A").unionByName(b.apply(table_b, "B"), allowMissingColumns=True)
    edges = matches.select(X.source_key("A", left_id).alias("left_key"), X.source_key("B", right_id).alias("right_key"))
    out = assign_entities(rows, edges, name).drop("_key")
    return out.select("entity_id", *[c for c in out.columns if c != "entity_id"])


def numeric_price(records: DataFrame) -> DataFrame:
    return records.withColumn("price", X.clean_numeric_text("price"))


def both_prices(records: DataFrame) -> DataFrame:
    return records.withColumnRenamed("price", "price_text").withColumn("price_numeric", X.clean_numeric_text("price_text"))


def convert_snapshots(snapshots: dict[str, DataFrame], entity: str, fields: list[str]) -> DataFrame:
    """Union of snapshots of one population, tagged with their names; the entity is the snapshots' own id."""
    out = None
    for name, df in snapshots.items():
        some = X.clean_frame(df).select(F.col(entity).alias("entity_id"), F.lit(name).alias("source_table"), F.col(entity).alias("source_id"), *fields)
        out = some if out is None else out.unionByName(some)
    return out


def convert_people(df: DataFrame, entity: str, renames: dict[str, str]) -> DataFrame:
    """Rows with an entity, renamed and reordered."""
    return df.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity_id"), *[F.col(a).alias(b) for a, b in renames.items()])


PROFILE = "struct<fullname:string,email:array<string>,phone:array<string>,addr:array<string>,dob:string>"


def read_profile_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labelled profile pairs: match (boolean), profile1, profile2, line (from 0, over all files by name).

    Lines are numbered by file, block and place in the block, so that they don't depend on how files are split.
    """
    from kindred.operators.records import with_positions

    raw = spark.read.schema(f"match string, profile1 {PROFILE}, profile2 {PROFILE}").json(path)
    place = ["_file", "_block", "_place"]
    rows = raw.select((F.col("match") == "True").alias("match"), "profile1", "profile2", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    return with_positions(rows, place, "line").drop(*place)


def balanced_pairs(pairs: DataFrame, n: int = 500, order: str = "line") -> DataFrame:
    """The first n matches and the first n others, in order; two top-k's, no window over all rows."""
    first = lambda m: pairs.filter(F.col("match") == m).orderBy(order).limit(n)
    return first(True).unionByName(first(False))


def profile_records(pairs: DataFrame, name: str = "pair", pair_id: str = "line") -> DataFrame:
    """Two rows per pair, with lists joined; both sides of a match share the entity."""
    key = F.concat(F.lit(f"{name}:"), F.col(pair_id).cast("string"))
    side = lambda s: F.struct(F.lit(s).alias("source_table"), F.col(s).alias("p"))
    rows = pairs.select(key.alias("pair_id"), F.col("match").alias("match_label"), F.inline(F.array(side("profile1"), side("profile2"))))
    entity = F.when(F.col("match_label"), F.col("pair_id")).otherwise(F.concat_ws(":", "pair_id", "source_table"))
    return rows.select(entity.alias("entity_id"), "pair_id", "source_table", "match_label", F.col("p.fullname").alias("fullname"), *[X.join_values(F.col("p")[c]).alias(c) for c in ("email", "phone", "addr")], F.col("p.dob").alias("dob"))
