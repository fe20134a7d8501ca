"""Entity resolution and record linkage on Spark."""

from kindred.api import Linker, load_model
from kindred.operators.records import infer_field_type, infer_field_types
from kindred.operators.views import nearest_neighbors, pair_review_table, score_linkage, top_pairs

__all__ = ["Linker", "infer_field_type", "infer_field_types", "load_model", "nearest_neighbors", "pair_review_table", "score_linkage", "top_pairs"]
