"""The user's way in: load a model, score a table or two, look at pairs, cluster."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import graph, neural, views
from kindred.operators.score import PairScorer


@dataclass
class Linker:
    """A model that scores all pairs of a table (or of its blocks) and clusters records by a threshold.

    model: a transformer (scores whole blocks), or a PairScorer (scores candidate pairs).
    """

    model: neural.RecordTransformer | PairScorer = field(default_factory=neural.RecordTransformer.random)
    threshold: float = 0.5
    block: str | None = None

    def predict_proba(self, records: DataFrame, record_id: str, field_types: dict[str, str] | list[str] | str = "infer") -> DataFrame:
        """left_id, right_id, score."""
        if isinstance(self.model, neural.RecordTransformer):
            return neural.score_blocks(records, self.model, record_id, field_types, self.block)
        from kindred.operators.pairs import all_pairs, blocked_pairs
        from kindred.operators.records import infer_field_types

        names = [c for c in records.columns if c not in (record_id, self.block)]
        if isinstance(field_types, str):
            if field_types != "infer":
                raise ValueError("field_types must be a mapping, a list or 'infer'")
            field_types = [t for t, _ in infer_field_types(records, record_id, columns=names)]
        if not isinstance(field_types, dict):
            if len(field_types) != len(names):
                raise ValueError(f"{len(field_types)} field types for {len(names)} columns")
            field_types = dict(zip(names, field_types))
        pairs = blocked_pairs(records, record_id, [self.block], names) if self.block else all_pairs(records, record_id, names)
        return self.model.score_pairs(pairs, field_types).select("left_id", "right_id", "score")

    def decision_function(self, records: DataFrame, record_id: str, field_types="infer") -> DataFrame:
        """left_id, right_id, logit."""
        from kindred.functions.text import logit

        return self.predict_proba(records, record_id, field_types).select("left_id", "right_id", logit("score").alias("logit"))

    def fit_predict_adjacency(self, records: DataFrame, record_id: str, field_types="infer") -> DataFrame:
        """The pairs whose score is the threshold or more."""
        return self.predict_proba(records, record_id, field_types).filter(F.col("score") >= self.threshold)

    def fit_predict(self, records: DataFrame, record_id: str, field_types="infer") -> DataFrame:
        """record_id and cluster: components of the pairs at the threshold, numbered from 0 by their smallest id."""
        from kindred.operators.records import with_positions

        if isinstance(self.model, neural.RecordTransformer):
            links = neural.block_links(records, self.model, record_id, field_types, self.block, self.threshold)
        else:
            links = self.fit_predict_adjacency(records, record_id, field_types)
        labels = graph.component_labels(records.select(F.col(record_id)), links, record_id)
        numbers = with_positions(labels.select("component_id").distinct(), "component_id", "cluster")
        return labels.join(numbers, "component_id").select(record_id, "cluster")

    def score_linkage(self, left: DataFrame, right: DataFrame, left_id: str, right_id: str, columns=None, field_types="infer", k: int = 10) -> DataFrame:
        """The k best left-right pairs, scored together as one table: left_index, right_index, score, left_ and right_ columns."""
        if k < 1:
            raise ValueError("k must be at least 1")
        if columns is None:
            columns = [c for c in left.columns if c in right.columns and c not in (left_id, right_id)] or None
        named = views.resolve_linkage_columns(left, right, columns)
        side = lambda df, i, n, s: df.select(F.concat(F.lit(f"{s}:"), F.col(i).cast("string")).alias("_id"), *[F.col(x[n]).alias(x[0]) for x in named])
        both = side(left, left_id, 1, "left").unionByName(side(right, right_id, 2, "right"))
        scored = self.predict_proba(both, "_id", field_types).filter(F.col("left_id").startswith("left:") & F.col("right_id").startswith("right:"))
        best = views.top_pairs(scored, k)
        for s, df, i in (("left", left, left_id), ("right", right, right_id)):
            n = 1 if s == "left" else 2
            looked = df.select(F.concat(F.lit(f"{s}:"), F.col(i).cast("string")).alias(f"{s}_index"), F.col(i).alias(f"_{s}"), *[F.col(x[n]).alias(f"{s}_{x[0]}") for x in named])
            best = looked.join(F.broadcast(best), f"{s}_index")  # k rows
        out = best.select(F.col("_left").alias("left_index"), F.col("_right").alias("right_index"), "score", *[f"{s}_{x[0]}" for x in named for s in ("left", "right")])
        return out.orderBy(F.col("score").desc(), "left_index", "right_index")


def load_model(path: str, threshold: float = 0.5, block: str | None = None) -> Linker:
    """A linker with the weights of a file of arrays."""
    return Linker(neural.RecordTransformer.load(path), threshold, block)
