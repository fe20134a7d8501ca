"""Queries on the driver's tables, one for each operator, with the same results in DuckDB's SQL beside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import api, storage
from kindred.functions import compare as C
from kindred.functions import text as X
from kindred.operators import dag, graph, metrics, neighbours, neural, pairs, phones, records, runs, score, simjoin, training, views
from kindred.plans import synth, worldgraph
from kindred.sources import catalog, convert, lookups, selector, sinks
from kindred.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- embeddings: views and metrics -----------------------------------------------------------------------------------


def _cosines(spark: SparkSession, d: str, keep: pairs.Keep, apart: bool = False) -> DataFrame:
    """Of all pairs of embeddings those that are asked for, chosen where they are made."""
    return pairs.cosine_pairs(_sourced(spark, d), "vec_id", "embedding", "label", None, digits=6, keep=keep, apart="source" if apart else None)


def _counted(spark: SparkSession, d: str, apart: bool = False) -> DataFrame:
    """score, target, n of all pairs of embeddings."""
    return pairs.cosine_counts(_sourced(spark, d), "vec_id", "embedding", "label", 6, None, apart="source" if apart else None)


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").withColumn("source", F.col("vec_id") % 3)


_COSINES = """WITH unit AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), scored AS (
  SELECT l.vec_id AS left_id, r.vec_id AS right_id, round(list_cosine_similarity(l.e, r.e), 6) AS score, CAST(l.label = r.label AS INTEGER) AS target FROM unit l JOIN unit r ON l.vec_id < r.vec_id
)"""


@_query(f"{_COSINES} SELECT left_id AS left_index, right_id AS right_index, score FROM scored ORDER BY score DESC, left_id, right_id LIMIT 10")
def top_pairs_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return views.top_pairs(_cosines(spark, d, pairs.ends(10, (None, True))), 10)


@_query(f"""{_COSINES}, both_ AS (SELECT left_id AS q, right_id AS n, score FROM scored UNION ALL SELECT right_id, left_id, score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS rank FROM both_)
SELECT q AS query_index, n AS neighbor_index, CAST(rank AS INTEGER) AS rank, score FROM ranked WHERE rank <= 3""")
def nearest_neighbors_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return views.nearest_neighbors(_cosines(spark, d, pairs.nearest(3)), 3)


def _index(spark: SparkSession, d: str, k: int) -> neighbours.Index:
    return neighbours.build(_table(spark, d, "embeddings"), "vec_id", "embedding", k)


@_query(f"""{_COSINES}, both_ AS (SELECT left_id AS q, right_id AS n, score FROM scored UNION ALL SELECT right_id, left_id, score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS rank FROM both_ WHERE q % 50 = 0)
SELECT q AS query_index, n AS neighbor_index, CAST(rank AS INTEGER) AS rank, score FROM ranked WHERE rank <= 3""")
def indexed_neighbors_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, 3).search(_table(spark, d, "embeddings").filter("vec_id % 50 = 0"), "vec_id", "embedding", exact=True)


@_query(f"{_COSINES} SELECT left_id AS left_index, right_id AS right_index, score FROM scored ORDER BY score DESC, left_id, right_id LIMIT 10")
def indexed_top_pairs_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, 10).top_pairs(10)


@_query("SELECT 3 * count(*) AS n_wanted, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0")
def neighbor_recall_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Of the cells that the index visits by itself: is the recall 0.95 or more, against exact search?"""
    index, asked = _index(spark, d, 3), _table(spark, d, "embeddings").filter("vec_id % 50 = 0")
    exact, some = (index.search(asked, "vec_id", "embedding", e) for e in (True, False))
    return neighbours.recall(some, exact).select("n_wanted", (F.col("recall") >= 0.95).alias("reached"))


@_query(f"""{_COSINES}, best AS (SELECT * FROM scored ORDER BY score DESC, left_id, right_id LIMIT 10)
SELECT left_id AS left_index, right_id AS right_index, score, l.label AS left_label, r.label AS right_label FROM best JOIN embeddings l ON left_id = l.vec_id JOIN embeddings r ON right_id = r.vec_id""")
def pair_review_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return views.pair_review_table(_cosines(spark, d, pairs.ends(10, (None, True))), _table(spark, d, "embeddings"), "vec_id", 10, ["label"])


_CURVE = """, counts AS (SELECT score, CAST(sum(target) AS DOUBLE) AS p, CAST(sum(1 - target) AS DOUBLE) AS n FROM scored GROUP BY score
), cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM counts WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
), points AS (SELECT *, tp / (tp + fp) AS precision, tp / pos AS recall FROM cum
), scores AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM points)"""


@_query(f"{_COSINES}{_CURVE} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM scores")
def pr_curve_embeddings(spark: SparkSession, d: str) -> DataFrame:
    points = metrics.curve(metrics.score_counts(_counted(spark, d), count="n"))
    return points.select("score", "tp", "fp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@_query(f"""{_COSINES}{_CURVE}, best AS (SELECT f1, score FROM scores ORDER BY f1 DESC, score LIMIT 1)
SELECT CAST(max(pos) + max(neg) AS BIGINT) AS n_pairs, round(max(pos) / (max(pos) + max(neg)), 9) AS prevalence, round(sum(p * precision) / max(pos), 9) AS pr_auc, round(sum(n * (tp - p + p / 2)) / (max(pos) * max(neg)), 9) AS roc_auc,
  round((SELECT f1 FROM best), 9) AS best_pair_f1, (SELECT score FROM best) AS best_pair_threshold FROM scores""")
def curve_summary_embeddings(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.curve_summary(metrics.score_counts(_counted(spark, d), count="n"))
    return out.select("n_pairs", *[F.round(c, 9).alias(c) for c in ("prevalence", "pr_auc", "roc_auc", "best_pair_f1")], "best_pair_threshold")


@_query(f"""{_COSINES}, c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND target = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND target = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND target = 1) AS fn FROM scored)
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS pair_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS pair_recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS pair_f1 FROM c""")
def threshold_metrics_embeddings(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.threshold_metrics(_counted(spark, d), 0.5, count="n")
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("pair_precision", "pair_recall", "pair_f1")])


_NEAREST = f"""{_COSINES}, nodes AS (SELECT vec_id AS id FROM embeddings), edges AS (SELECT left_id, right_id FROM scored WHERE score >= 0.4),
sym AS (SELECT left_id AS a, right_id AS b FROM edges UNION SELECT right_id, left_id FROM edges)"""
_REACH = """, reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


#: The cosine from which embeddings are linked.
_LINKED = 0.4


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    nodes = _table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), "label")
    return graph.component_labels(nodes, _cosines(spark, d, pairs.from_score(_LINKED)), "record_id")


@_query(_NEAREST.replace("WITH unit", "WITH RECURSIVE unit") + _REACH + " SELECT id AS record_id, label, component_id FROM comp JOIN embeddings ON id = vec_id")
def components_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).select("record_id", "label", "component_id")


@_query(_NEAREST.replace("WITH unit", "WITH RECURSIVE unit") + _REACH + " SELECT id AS node, component_id FROM comp WHERE id IN (SELECT a FROM sym)")
def merged_components_embeddings(spark: SparkSession, d: str) -> DataFrame:
    links = storage.written(_cosines(spark, d, pairs.from_score(_LINKED)).select("left_id", "right_id"), "links")
    return incremental.merged_in_batches(links, (F.col("left_id") + F.col("right_id")) % 3, 3)


@_query(_NEAREST.replace("WITH unit", "WITH RECURSIVE unit") + _REACH + """, lab AS (SELECT label AS t, component_id AS c FROM comp JOIN embeddings ON id = vec_id), cell AS (SELECT t, c, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY t, c),
q AS (SELECT (SELECT sum(n) FROM cell) AS n, (SELECT sum(n * n) FROM cell) AS s, (SELECT sum(n * n) FROM (SELECT sum(n) AS n FROM cell GROUP BY t)) AS a, (SELECT sum(n * n) FROM (SELECT sum(n) AS n FROM cell GROUP BY c)) AS b),
m AS (SELECT s - n AS tp, b - s AS fp, a - s AS fn, n * n - a - b + s AS tn FROM q)
SELECT round(CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 9) AS adjusted_rand FROM m""")
def adjusted_rand_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjusted_rand(_clusters(spark, d), "label", "component_id").select(F.round("adjusted_rand", 9).alias("adjusted_rand"))


@_query(f"""{_COSINES}, b AS (SELECT target, CAST(least(floor(least(greatest(score, 0), 1) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT target, bin, n, round(n / sum(n) OVER (PARTITION BY target) * 30, 9) AS density FROM b""")
def score_histogram_embeddings(spark: SparkSession, d: str) -> DataFrame:
    clipped = _counted(spark, d).withColumn("score", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    return metrics.score_histogram(clipped, count="n").withColumn("density", F.round("density", 9))


@_query("SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM embeddings GROUP BY label) GROUP BY size")
def cluster_sizes_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cluster_sizes(_table(spark, d, "embeddings"), "label")


@_query("SELECT count(*) AS count, avg(size) AS mean, round(stddev_samp(size), 9) AS std, min(size) AS min, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.75) AS q3, max(size) AS max FROM (SELECT count(*) AS size FROM conversations GROUP BY conv_id)")
def cluster_size_summary_conversations(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cluster_size_summary(_table(spark, d, "conversations"), "conv_id").withColumn("std", F.round("std", 9))


@_query(f"""{_COSINES}, keyed AS (SELECT left_id, right_id, target AS label, md5(concat_ws(':', left_id, right_id, '0')) AS k FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, left_id, right_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS total FROM keyed),
edges AS (SELECT CAST(floor(0.6 * max(total)) AS BIGINT) AS a, CAST(floor(0.8 * max(total)) AS BIGINT) AS b, max(total) AS c FROM ranked WHERE label = 1),
q AS (SELECT a, b, c, greatest(0, 3000 - a) AS x, greatest(0, 1000 - (b - a)) AS y, greatest(0, 1000 - (c - b)) AS z FROM edges)
SELECT CASE WHEN label = 1 THEN CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'valid' ELSE 'test' END ELSE CASE WHEN pos < x THEN 'train' WHEN pos < x + y THEN 'valid' ELSE 'test' END END AS split, left_id, right_id, label
FROM ranked, q WHERE label = 1 OR pos < x + y + z""")
def pair_splits_embeddings(spark: SparkSession, d: str) -> DataFrame:
    same, others = (_cosines(spark, d, pairs.of_target(t)).select("left_id", "right_id", F.col("target").alias("label")) for t in (1, 0))
    return pairs.split_pairs(same, {"train": 3000, "valid": 1000, "test": 1000}, others=others).select("split", "left_id", "right_id", "label")


@_query(f"""{_COSINES} SELECT target, count(*) AS count, round(avg(score), 6) AS mean, round(median(score), 6) AS median, min(score) AS min, max(score) AS max FROM scored GROUP BY target""")
def score_stats_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score_stats(_counted(spark, d), ["target"], "n").withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


_EVALUATED = _NEAREST.replace("WITH unit", "WITH RECURSIVE unit") + _REACH + _CURVE + """, lab AS (SELECT label AS t, component_id AS c FROM comp JOIN embeddings ON id = vec_id), cell AS (SELECT t, c, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY t, c),
q AS (SELECT (SELECT sum(n) FROM cell) AS n, (SELECT sum(n * n) FROM cell) AS s, (SELECT sum(n * n) FROM (SELECT sum(n) AS n FROM cell GROUP BY t)) AS a, (SELECT sum(n * n) FROM (SELECT sum(n) AS n FROM cell GROUP BY c)) AS b),
m AS (SELECT s - n AS tp, b - s AS fp, a - s AS fn, n * n - a - b + s AS tn FROM q),
h AS (SELECT CAST(count(*) FILTER (WHERE score >= 0.4 AND target = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE score >= 0.4 AND target = 0) AS fp, count(*) FILTER (WHERE score < 0.4 AND target = 1) AS fn, count(*) FILTER (WHERE score > 0) AS c, count(*) FILTER (WHERE score > 0 AND target = 1) AS ct, count(*) AS n, sum(target) AS t FROM scored),
k AS (SELECT max(pos) / (max(pos) + max(neg)) AS prevalence, sum(p * precision) / max(pos) AS pr_auc, sum(n * (tp - p + p / 2)) / (max(pos) * max(neg)) AS roc_auc FROM scores), best AS (SELECT f1, score FROM scores ORDER BY f1 DESC, score LIMIT 1)
SELECT 'embeddings' AS name, (SELECT count(*) FROM embeddings) AS n_records, (SELECT count(DISTINCT label) FROM embeddings) AS n_entities, round(prevalence, 9) AS prevalence, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc,
  round(coalesce(h.tp / nullif(h.tp + h.fp, 0), 0), 9) AS pair_precision, round(h.tp / (h.tp + h.fn), 9) AS pair_recall, round(2 * h.tp / (2 * h.tp + h.fp + h.fn), 9) AS pair_f1, round(best.f1, 9) AS best_pair_f1, best.score AS best_pair_threshold,
  round(CASE WHEN m.fp = 0 AND m.fn = 0 THEN 1 ELSE 2 * (m.tp * m.tn - m.fn * m.fp) / ((m.tp + m.fn) * (m.fn + m.tn) + (m.tp + m.fp) * (m.fp + m.tn)) END, 9) AS adjusted_rand, h.c AS candidate_pairs, round(h.c / h.n, 9) AS candidate_fraction, round(h.ct / h.t, 9) AS true_pair_candidate_recall
FROM k, best, h, m"""


@_query(_EVALUATED)
def evaluate_embeddings(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.evaluate("embeddings", _table(spark, d, "embeddings"), "vec_id", "label", _cosines(spark, d, pairs.from_score(_LINKED)), _LINKED, counts=_counted(spark, d))
    kept = ("name", "n_records", "n_entities", "best_pair_threshold", "candidate_pairs")
    return out.select(*[c if c in kept else F.round(c, 9).alias(c) for c in out.columns])


def _scope_sql(condition: str) -> str:
    """The evaluation of pairs of a scope; those with a cosine below 0.1 aren't scored."""
    cosine = "round(list_cosine_similarity(l.e, r.e), 6)"
    return _EVALUATED.replace("l.vec_id < r.vec_id", f"l.vec_id < r.vec_id AND {condition}", 1).replace(f"{cosine} AS score", f"CASE WHEN {cosine} >= 0.1 THEN {cosine} ELSE 0 END AS score", 1)


def _evaluated(spark: SparkSession, d: str, scored: DataFrame, totals: tuple[int, int], counts: DataFrame | None = None) -> DataFrame:
    out = metrics.evaluate("embeddings", _table(spark, d, "embeddings"), "vec_id", "label", scored.filter("score >= 0.1"), _LINKED, totals=totals, counts=counts)
    kept = ("name", "n_records", "n_entities", "best_pair_threshold", "candidate_pairs")
    return out.select(*[c if c in kept else F.round(c, 9).alias(c) for c in out.columns])


@_query(_scope_sql("l.vec_id % 3 <> r.vec_id % 3"))
def evaluate_cross_source_embeddings(spark: SparkSession, d: str) -> DataFrame:
    scored, counts = _cosines(spark, d, pairs.from_score(_LINKED), True), _counted(spark, d, True).filter("score >= 0.1")
    return _evaluated(spark, d, scored, tuple(metrics.scope_totals(_sourced(spark, d), "label", "source").first()), counts)


@_query(_scope_sql("l.vec_id // 2 = r.vec_id // 2"))
def evaluate_paired_rows_embeddings(spark: SparkSession, d: str) -> DataFrame:
    sides = _table(spark, d, "embeddings").withColumn("pair_id", F.expr("vec_id div 2")).withColumn("side", F.col("vec_id") % 2)
    universe = pairs.paired_rows(sides, "pair_id", "side", 0, 1, ["vec_id", "label", "embedding"])
    targets = universe.select((F.col("left_label") == F.col("right_label")).cast("int").alias("target"))
    cosine = F.round(C.cosine(F.col("left_embedding"), F.col("right_embedding")), 6)
    scored = universe.select(F.col("left_vec_id").alias("left_id"), F.col("right_vec_id").alias("right_id"), cosine.alias("score"), (F.col("left_label") == F.col("right_label")).cast("int").alias("target"))
    return _evaluated(spark, d, scored, tuple(targets.agg(F.count(F.lit(1)), F.sum("target")).first()))


_ENDS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, row_number() OVER (ORDER BY score {order}, left_id, right_id) AS rank, left_id, right_id, score FROM scored WHERE target = {target}"
    for kind, target, order in (("false_positive", 0, "DESC"), ("weak_positive", 1, ""), ("true_positive", 1, "DESC"), ("true_negative", 0, ""))
)


@_query(f"{_COSINES}, ends AS ({_ENDS}) SELECT kind, CAST(rank AS INTEGER) AS rank, left_id, right_id, score FROM ends WHERE rank <= 10")
def confident_pairs_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confident_pairs(storage.written(_cosines(spark, d, pairs.ends(10, (0, True), (1, False), (1, True), (0, False))), "ends"), 10)


@_query(f"{_COSINES} SELECT left_id, right_id, score FROM scored WHERE target = 0 AND score >= 0.3 ORDER BY score DESC, left_id, right_id LIMIT 20")
def merging_edges_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.merging_edges(_cosines(spark, d, pairs.ends(20, (0, True))), 0.3)


@_query()
def pair_mlp_embeddings(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "embeddings").select("vec_id", "embedding")
    return views.top_pairs(score.PairMLP.random(64).best_pairs(df, "vec_id", 10), 10)


@_query("""WITH p AS (SELECT CAST(l.label = r.label AS INTEGER) AS t FROM embeddings l JOIN embeddings r ON l.vec_id // 40 = r.vec_id // 40 AND l.vec_id < r.vec_id)
SELECT count(*) AS n_pairs, CAST(sum(t) AS BIGINT) AS positives, 12 AS steps, TRUE AS loss_falls FROM p""")
def train_pair_mlp_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Training on the pairs of each forty vectors; the numbers of pairs, and whether the loss falls."""
    df = _table(spark, d, "embeddings").withColumn("block", F.expr("vec_id div 40"))
    found = metrics.with_target(pairs.blocked_pairs(df, "vec_id", ["block"], ["embedding", "label"]), "label")
    batches = training.Batches.write(found, "embedding", size=20_000)
    start = score.PairMLP.random(64)
    model, state = training.train(start, batches, spark, steps=12, rate=3e-3)
    n, positives = (sum(x) for x in zip(*[(n, p) for p, n in batches.counts]))
    return spark.createDataFrame([(n, positives, state.step, training.improved(start, model, batches, spark, 12))], "n_pairs long, positives long, steps int, loss_falls boolean")


# -- entity samples and field types ------------------------------------------------------------------------------


def _sample_sql(variation: bool) -> str:
    having = "count(*) >= 2" + (" AND count(DISTINCT md5(concat_ws(chr(31), role, text))) > 1" if variation else "")
    return f"""WITH e AS (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id HAVING {having}), s AS (SELECT conv_id FROM e ORDER BY md5(conv_id || ':7'), conv_id LIMIT 20)
SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM s)"""


@_query(_sample_sql(False))
def entity_sample(spark: SparkSession, d: str) -> DataFrame:
    return records.sample_entities(_table(spark, d, "conversations"), "conv_id", ["role", "text"], 20, 7)


@_query(_sample_sql(True))
def entity_sample_variation(spark: SparkSession, d: str) -> DataFrame:
    return records.sample_entities(_table(spark, d, "conversations"), "conv_id", ["role", "text"], 20, 7, require_variation=True)


@_query("SELECT * FROM (VALUES (0, 'c_custkey', 'numeric', 'dtype'), (1, 'c_name', 'text', 'fallback'), (2, 'c_nationkey', 'numeric', 'dtype'), (3, 'c_mktsegment', 'text', 'fallback'), (4, 'c_acctbal', 'numeric', 'dtype')) t(position, \"column\", field_type, reason)")
def infer_field_types_customer(spark: SparkSession, d: str) -> DataFrame:
    return records.field_type_table(_table(spark, d, "customer"), order_by="c_custkey", columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"])


@_query("SELECT * FROM (VALUES (0, 'o_orderkey', 'numeric', 'dtype'), (1, 'o_orderdate', 'date', 'dtype')) t(position, \"column\", field_type, reason)")
def infer_field_types_orders(spark: SparkSession, d: str) -> DataFrame:
    return records.field_type_table(_table(spark, d, "orders"), order_by="o_orderkey", columns=["o_orderkey", "o_orderdate"])


@_query("""WITH v AS (SELECT role AS v FROM conversations WHERE regexp_replace(role, '^\\s+|\\s+$', '', 'g') <> '' ORDER BY conv_id, role LIMIT 100), f AS (SELECT avg(CAST(regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS DOUBLE)) AS e, avg(CAST(regexp_matches(regexp_replace(regexp_replace(v, '^\\+', ''), '[\\s().\\-/]', '', 'g'), '^[0-9]{7,15}$') AS DOUBLE)) AS p FROM v)
SELECT 0 AS position, 'role' AS "column", CASE WHEN e >= 0.8 THEN 'email' WHEN p >= 0.8 THEN 'phone' ELSE 'text' END AS field_type, CASE WHEN e >= 0.8 OR p >= 0.8 THEN 'value_pattern' ELSE 'fallback' END AS reason FROM f""")
def infer_field_types_conversations(spark: SparkSession, d: str) -> DataFrame:
    return records.field_type_table(_table(spark, d, "conversations"), order_by="conv_id", columns=["role"])


# -- linkage, scopes, blocking -------------------------------------------------------------------------------------


def _gap(s: float) -> float:
    """The largest difference d for which 1 / (1 + d), rounded to six digits, is s or more."""
    return 1 / (s - 6e-7) - 1 if s > 1e-6 else float("inf")


@_query("""SELECT c_custkey AS left_index, s_suppkey AS right_index, (CAST(c_nationkey = s_nationkey AS INTEGER) + round(1 / (1 + abs(c_acctbal - s_acctbal)), 6)) / 2 AS score, c_nationkey AS left_nation, s_nationkey AS right_nation, c_acctbal AS left_balance, s_acctbal AS right_balance
FROM customer, supplier ORDER BY score DESC, left_index, right_index LIMIT 25""")
def score_linkage_customer_supplier(spark: SparkSession, d: str) -> DataFrame:
    columns = {"nation": ("c_nationkey", "s_nationkey"), "balance": ("c_acctbal", "s_acctbal")}
    value = lambda _: ((F.col("left_nation") == F.col("right_nation")).cast("int") + F.round(1 / (1 + F.abs(F.col("left_balance") - F.col("right_balance"))), 6)) / 2
    return views.score_linkage(_table(spark, d, "customer"), _table(spark, d, "supplier"), value, "c_custkey", "s_suppkey", columns, 25, most=None, near=views.Near("balance", lambda s: _gap(2 * s - 1)))


@_query("""SELECT c_custkey AS left_index, s_suppkey AS right_index, round(1 / (1 + abs(c_acctbal - s_acctbal)), 6) AS score, c_nationkey AS left_nation, s_nationkey AS right_nation, c_acctbal AS left_balance, s_acctbal AS right_balance
FROM customer JOIN supplier ON c_nationkey = s_nationkey ORDER BY score DESC, left_index, right_index LIMIT 25""")
def score_linkage_blocked(spark: SparkSession, d: str) -> DataFrame:
    columns = {"nation": ("c_nationkey", "s_nationkey"), "balance": ("c_acctbal", "s_acctbal")}
    value = lambda _: F.round(1 / (1 + F.abs(F.col("left_balance") - F.col("right_balance"))), 6)
    return views.score_linkage(_table(spark, d, "customer"), _table(spark, d, "supplier"), value, "c_custkey", "s_suppkey", columns, 25, block_on=["nation"], near=views.Near("balance", _gap))


@_query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT CAST((sum(n) * (sum(n) - 1) // 2) - sum(n * (n - 1) // 2) AS BIGINT) AS n_pairs, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS excluded_pairs FROM s")
def pair_scope_counts_documents(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_scope_counts(_table(spark, d, "documents"), "source")


@_query("SELECT l.s_suppkey AS left_id, r.s_suppkey AS right_id, l.s_nationkey AS left_s_nationkey, r.s_nationkey AS right_s_nationkey FROM supplier l JOIN supplier r ON l.s_suppkey < r.s_suppkey AND l.s_nationkey <> r.s_nationkey")
def cross_source_pairs_supplier(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cross_source_pairs(_table(spark, d, "supplier"), "s_suppkey", "s_nationkey", most=None)


@_query("SELECT a.conv_id, a.turn AS left_turn, a.text AS left_text, b.turn AS right_turn, b.text AS right_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' WHERE a.conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = 2)")
def paired_rows_conversations(spark: SparkSession, d: str) -> DataFrame:
    return pairs.paired_rows(_table(spark, d, "conversations"), "conv_id", "role", "user", "assistant", ["turn", "text"])


_BLOCK = "blocked AS (SELECT l.s_suppkey AS left_id, r.s_suppkey AS right_id, CASE WHEN l.s_nationkey = r.s_nationkey THEN 'exact:s_nationkey' ELSE 'exact:bucket' END AS match_key FROM s l JOIN s r ON l.s_suppkey < r.s_suppkey AND (l.s_nationkey = r.s_nationkey OR l.bucket = r.bucket))"
_SUPPLIER = "s AS (SELECT *, CAST(floor(s_acctbal / 500) AS BIGINT) AS bucket FROM supplier)"


@_query(f"WITH {_SUPPLIER}, {_BLOCK} SELECT * FROM blocked")
def blocking_supplier(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "supplier").withColumn("bucket", F.floor(F.col("s_acctbal") / 500))
    return pairs.blocked_pairs(df, "s_suppkey", ["s_nationkey", "bucket"]).select("left_id", "right_id", "match_key")


@_query(f"""WITH {_SUPPLIER}, {_BLOCK}, n AS (SELECT count(*) AS n FROM supplier), t AS (SELECT sum(n * (n - 1) // 2) AS t FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey))
SELECT count(*) AS candidate_pairs, round(count(*) / (SELECT n * (n - 1) // 2 FROM n), 9) AS candidate_fraction, round(coalesce(sum(CAST(a.s_nationkey = b.s_nationkey AS INTEGER)), 0) / greatest(1, (SELECT coalesce(t, 0) FROM t)), 9) AS true_pair_candidate_recall
FROM blocked JOIN supplier a ON left_id = a.s_suppkey JOIN supplier b ON right_id = b.s_suppkey""")
def candidate_stats_supplier(spark: SparkSession, d: str) -> DataFrame:
    df = _table(spark, d, "supplier").withColumn("bucket", F.floor(F.col("s_acctbal") / 500))
    found = metrics.with_target(pairs.blocked_pairs(df, "s_suppkey", ["s_nationkey", "bucket"]), "s_nationkey")
    true = metrics.true_pair_count(df, "s_nationkey").first()[0]
    out = metrics.candidate_stats(found, df.count(), true)
    return out.select("candidate_pairs", *[F.round(c, 9).alias(c) for c in ("candidate_fraction", "true_pair_candidate_recall")])


@_query("SELECT sum(n * (n - 1) // 2)::BIGINT AS n_pairs FROM (SELECT count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey)")
def blocked_pair_count_customer(spark: SparkSession, d: str) -> DataFrame:
    return pairs.blocked_pair_count(_table(spark, d, "customer"), "c_nationkey")


_BLOCKS = r"""blocks AS (SELECT DISTINCT id, token FROM (SELECT item_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM benchmark) WHERE token <> ''),
sizes AS (SELECT token, count(*) AS n FROM blocks GROUP BY token HAVING count(*) >= 2)"""


@_query(f"WITH {_BLOCKS} SELECT token, n FROM sizes")
def token_blocks_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return pairs.block_sizes(pairs.token_blocks(_table(spark, d, "benchmark"), "item_id", ["text"]))


@_query(f"WITH {_BLOCKS} SELECT n, count(*) AS blocks, CAST(n * (n - 1) // 2 * count(*) AS BIGINT) AS comparisons FROM sizes GROUP BY n")
def block_purging_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return pairs.purge_statistics(pairs.token_blocks(_table(spark, d, "benchmark"), "item_id", ["text"]))


_FILTERED = f"""{_BLOCKS}, kept AS (SELECT id, b.token, n FROM blocks b JOIN sizes s ON b.token = s.token), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, token) AS r, count(*) OVER (PARTITION BY id) AS a FROM kept),
filtered AS (SELECT id, token, n FROM ranked WHERE r <= floor(a * 0.9 + 0.5))"""


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    blocks = pairs.token_blocks(_table(spark, d, "benchmark"), "item_id", ["text"])
    return pairs.filter_blocks(blocks.join(pairs.block_sizes(blocks), "token"), 0.9)


@_query(f"WITH {_FILTERED} SELECT id, token, n FROM filtered")
def block_filtering_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d).select("id", "token", "n")


@_query(f"""WITH {_FILTERED}, w AS (SELECT l.id AS left_id, r.id AS right_id, count(*) AS weight FROM filtered l JOIN filtered r ON l.token = r.token AND l.id < r.id GROUP BY 1, 2)
SELECT left_id, right_id, weight FROM w WHERE weight >= (SELECT avg(weight) FROM w)""")
def weighted_edge_pruning_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return pairs.weighted_edge_pruning(pairs.block_pairs(_filtered(spark, d)))


_PURGED = f"""{_BLOCKS}, summed AS (SELECT n, sum(sum(n)) OVER w AS a, sum(sum(n * (n - 1) // 2)) OVER w AS c FROM sizes GROUP BY n WINDOW w AS (ORDER BY n)),
steps AS (SELECT n, CAST(a AS DOUBLE) AS a, CAST(c AS DOUBLE) AS c, CAST(lag(a) OVER (ORDER BY n) AS DOUBLE) AS a1, CAST(lag(c) OVER (ORDER BY n) AS DOUBLE) AS c1 FROM summed),
purged AS (SELECT coalesce(max(n) FILTER (WHERE a1 * c < CAST(1.025 AS DOUBLE) * a * c1), min(n)) AS most FROM steps),
kept AS (SELECT id, b.token, n FROM blocks b JOIN sizes s ON b.token = s.token AND n <= (SELECT most FROM purged)), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, token) AS r, count(*) OVER (PARTITION BY id) AS a FROM kept),
filtered AS (SELECT id, token, n FROM ranked WHERE r <= floor(a * 0.9 + 0.5))"""


def _purged(spark: SparkSession, d: str) -> DataFrame:
    """As _filtered, but blocks are purged by the operator's own rule."""
    return pairs.filter_blocks(pairs.purge_blocks(pairs.token_blocks(_table(spark, d, "benchmark"), "item_id", ["text"])), 0.9)


@_query(f"WITH {_PURGED} SELECT id, token, n FROM filtered")
def purged_block_filtering_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return _purged(spark, d).select("id", "token", "n")


@_query(f"""WITH {_PURGED}, w AS (SELECT l.id AS left_id, r.id AS right_id, count(*) AS weight FROM filtered l JOIN filtered r ON l.token = r.token AND l.id < r.id GROUP BY 1, 2)
SELECT left_id, right_id, weight FROM w WHERE weight >= (SELECT avg(weight) FROM w)""")
def purged_edge_pruning_benchmark(spark: SparkSession, d: str) -> DataFrame:
    return pairs.weighted_edge_pruning(pairs.block_pairs(_purged(spark, d)))


@_query(r"""WITH words AS (SELECT item_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM benchmark),
padded AS (SELECT id, ' ' || w || ' ' AS w FROM words WHERE w <> ''), sized AS (SELECT id, w, unnest([3, 4, 5]) AS n FROM padded),
g AS (SELECT id, substr(w, i, n) AS gram, count(*) AS tf FROM (SELECT id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM sized WHERE length(w) >= n) GROUP BY 1, 2),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY gram),
w AS (SELECT id, gram, tf * idf AS w FROM g JOIN idf USING (gram)), u AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w),
s AS (SELECT l.id AS left_id, r.id AS right_id, sum(l.w * r.w) AS score FROM u l JOIN u r ON l.gram = r.gram GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS rank FROM s)
SELECT left_id, right_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k WHERE rank <= 3""")
def tfidf_neighbours_benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = _table(spark, d, "benchmark")
    return pairs.tfidf_neighbours(b, b, "item_id", "text", "item_id", "text", 3).withColumn("score", F.round("score", 6))


_GRAMS = r"""SELECT id, substr(w, i, n) AS gram, count(*) AS tf FROM (SELECT id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT id, w, unnest([3, 4, 5]) AS n FROM (SELECT id, ' ' || w || ' ' AS w FROM (SELECT {i} AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM {t}) WHERE w <> '')) WHERE length(w) >= n) GROUP BY 1, 2"""


@_query(f"""WITH r AS ({_GRAMS.format(i="item_id", t="benchmark")}), l AS ({_GRAMS.format(i="doc_id", t="documents")}), idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM r GROUP BY gram),
u AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, gram, tf * idf AS w FROM r JOIN idf USING (gram))), v AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT id, gram, tf * idf AS w FROM l JOIN idf USING (gram))),
s AS (SELECT v.id AS left_id, u.id AS right_id, sum(v.w * u.w) AS score FROM v JOIN u ON v.gram = u.gram GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 9) DESC, right_id) AS rank FROM s)
SELECT left_id, right_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k WHERE rank <= 3""")
def tfidf_neighbours_documents(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.tfidf_neighbours(_table(spark, d, "documents"), _table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", 3)
    return found.withColumn("score", F.round("score", 6))


@_query(r"""WITH blocks AS (SELECT DISTINCT id, token FROM (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents) WHERE token <> '') SELECT token, count(*) AS n FROM blocks GROUP BY token HAVING count(*) >= 2""")
def token_blocks_documents(spark: SparkSession, d: str) -> DataFrame:
    return pairs.block_sizes(pairs.token_blocks(_table(spark, d, "documents"), "doc_id", ["text"]))


@_query("""SELECT doc_id AS record_id, min(doc_id) OVER (PARTITION BY text) AS component_id FROM documents""")
def components_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("left_id"))
    edges = docs.join(first, docs["text"].eqNullSafe(first["text"])).select("left_id", F.col("doc_id").alias("right_id"))
    return graph.component_labels(docs.select(F.col("doc_id").alias("record_id")), edges)


_SHINGLES = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
own AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM sh GROUP BY doc_id), cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k, n) AS id FROM own),
rep AS (SELECT sh.doc_id, g, n FROM sh JOIN cls USING (doc_id) WHERE doc_id = id), shared AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, a.n AS an, b.n AS bn, count(*) AS c FROM rep a JOIN rep b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT left_id, right_id, c / (an + bn - c) AS similarity FROM shared WHERE c / (an + bn - c) >= 0.8)"""


def _shingled(documents: DataFrame, record_id: str) -> DataFrame:
    return simjoin.shingle_sets(documents, record_id, "text")


@_query(f"WITH {_SHINGLES} SELECT left_id, right_id, round(similarity, 9) AS similarity FROM near")
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    found, _ = simjoin.class_join(_table(spark, d, "documents"), "doc_id", "s", 0.8, _shingled)
    return found.withColumn("similarity", F.round("similarity", 9))


@_query(f"""WITH RECURSIVE {_SHINGLES}, sym AS (SELECT left_id AS a, right_id AS b FROM near UNION SELECT right_id, left_id FROM near),
reach AS (SELECT DISTINCT id AS a, id AS b FROM cls UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a), comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a), links AS (SELECT a AS id, count(*) AS links FROM sym GROUP BY a)
SELECT d.doc_id, coalesce(c, d.doc_id) AS component_id, coalesce(links, 0) AS links FROM documents d LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.id = cls.id LEFT JOIN links ON links.id = cls.id""")
def near_copy_components_documents(spark: SparkSession, d: str) -> DataFrame:
    return simjoin.near_copies(_table(spark, d, "documents"), "doc_id", "s", 0.8, _shingled)


@_query("SELECT lang, count(*) FILTER (WHERE source = 'src0') AS src0, count(*) FILTER (WHERE source = 'src1') AS src1, count(*) FILTER (WHERE source = 'src2') AS src2 FROM documents GROUP BY lang")
def source_counts_documents(spark: SparkSession, d: str) -> DataFrame:
    return metrics.source_counts(_table(spark, d, "documents"), "lang", "source", ["src0", "src1", "src2"])


@_query("SELECT source, max(n) AS max_per_entity, count(*) FILTER (WHERE n > 1) AS entities_over_one FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source")
def source_count_summary_documents(spark: SparkSession, d: str) -> DataFrame:
    return metrics.source_count_summary(_table(spark, d, "documents"), "lang", "source")


# -- comparisons and Fellegi-Sunter --------------------------------------------------------------------------------


def _brands(spark: SparkSession, d: str) -> DataFrame:
    names = _table(spark, d, "part").select(F.col("p_name").alias("n")).distinct()
    return names.alias("l").join(names.alias("r"), F.col("l.n") < F.col("r.n")).select(F.col("l.n").alias("a"), F.col("r.n").alias("b"))


_NAMES = "names AS (SELECT DISTINCT p_name AS n FROM part), p AS (SELECT l.n AS a, r.n AS b FROM names l JOIN names r ON l.n < r.n)"


@_query(f"WITH {_NAMES} SELECT a, b, CAST(CASE WHEN a = b THEN 3 WHEN levenshtein(a, b) <= 1 THEN 2 WHEN levenshtein(a, b) <= 4 THEN 1 ELSE 0 END AS INTEGER) AS level FROM p")
def levenshtein_levels_part(spark: SparkSession, d: str) -> DataFrame:
    return _brands(spark, d).select("a", "b", C.levenshtein_level("a", "b", (1, 4)).alias("level"))


@_query(f"WITH {_NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS similarity FROM p")
def jaro_winkler_part(spark: SparkSession, d: str) -> DataFrame:
    return _brands(spark, d).select("a", "b", F.round(C.jaro_winkler()("a", "b"), 9).alias("similarity"))


@_query(f"WITH {_NAMES}, t AS (SELECT a, b, list_distinct(regexp_split_to_array(lower(a), '[^a-z0-9]+')) AS x, list_distinct(regexp_split_to_array(lower(b), '[^a-z0-9]+')) AS y FROM p) SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS similarity FROM t")
def jaccard_part(spark: SparkSession, d: str) -> DataFrame:
    return _brands(spark, d).select("a", "b", F.round(C.jaccard(C.tokens("a"), C.tokens("b")), 9).alias("similarity"))


_FS = score.FellegiSunter({"c_mktsegment": [0.1, 0.9], "bucket": [0.2, 0.8]}, {"c_mktsegment": [0.8, 0.2], "bucket": [0.95, 0.05]}, 0.01)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").withColumn("bucket", F.floor(F.col("c_acctbal") / 500)).withColumn("block", F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_acctbal") / 50).cast("string")))


_CUSTOMERS = "c AS (SELECT *, CAST(floor(c_acctbal / 500) AS BIGINT) AS bucket, c_nationkey || '-' || CAST(floor(c_acctbal / 50) AS BIGINT) AS block FROM customer), cp AS (SELECT l.c_custkey AS left_id, r.c_custkey AS right_id, l.c_mktsegment AS left_c_mktsegment, r.c_mktsegment AS right_c_mktsegment, l.bucket AS left_bucket, r.bucket AS right_bucket FROM c l JOIN c r ON l.block = r.block AND l.c_custkey < r.c_custkey)"


@_query(f"""WITH {_CUSTOMERS}, w AS (SELECT left_id, right_id, log2(0.01 / 0.99) + CASE WHEN left_c_mktsegment = right_c_mktsegment THEN log2(0.9 / 0.2) ELSE log2(0.1 / 0.8) END + CASE WHEN left_bucket = right_bucket THEN log2(0.8 / 0.05) ELSE log2(0.2 / 0.95) END AS w FROM cp)
SELECT left_id, right_id, round(w, 6) AS match_weight, round(pow(2, w) / (1 + pow(2, w)), 6) AS score FROM w""")
def fellegi_sunter_customer(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.blocked_pairs(_customers(spark, d), "c_custkey", ["block"], ["c_mktsegment", "bucket"])
    scored = _FS.score_pairs(found, {"c_mktsegment": "categorical", "bucket": "numeric"})
    return scored.select("left_id", "right_id", F.round("match_weight", 6).alias("match_weight"), F.round("score", 6).alias("score"))


@_query(f"""WITH {_CUSTOMERS}, tf AS (SELECT c_mktsegment AS value, count(*) / (SELECT count(c_mktsegment) FROM customer) AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment),
w AS (SELECT left_id, right_id, log2(0.01 / 0.99) + CASE WHEN left_c_mktsegment = right_c_mktsegment THEN log2(0.9 / 0.2) + log2(0.2 / share) ELSE log2(0.1 / 0.8) END + CASE WHEN left_bucket = right_bucket THEN log2(0.8 / 0.05) ELSE log2(0.2 / 0.95) END AS w FROM cp LEFT JOIN tf ON left_c_mktsegment = value)
SELECT left_id, right_id, round(w, 6) AS match_weight, round(pow(2, w) / (1 + pow(2, w)), 6) AS score FROM w""")
def fellegi_sunter_tf_customer(spark: SparkSession, d: str) -> DataFrame:
    df = _customers(spark, d)
    model = replace(_FS, frequencies={"c_mktsegment": score.term_frequencies(df, "c_mktsegment")})
    found = pairs.blocked_pairs(df, "c_custkey", ["block"], ["c_mktsegment", "bucket"])
    scored = model.score_pairs(found, {"c_mktsegment": "categorical", "bucket": "numeric"})
    return scored.select("left_id", "right_id", F.round("match_weight", 6).alias("match_weight"), F.round("score", 6).alias("score"))


def _em_sql() -> str:
    """Fitting in SQL: levels of all pairs, u from all, EM by blocks of each of three columns, 25 rounds of it written out."""
    levels = {"b": 4, "m": 2, "k": 2}  # block, segment, bucket
    parts = [
        """c AS MATERIALIZED (SELECT *, CAST(floor(c_acctbal / 500) AS BIGINT) AS bucket, c_nationkey || '-' || CAST(floor(c_acctbal / 50) AS BIGINT) AS block FROM customer)""",
        """p AS MATERIALIZED (SELECT l.c_custkey AS left_id, r.c_custkey AS right_id, l.c_mktsegment AS seg, l.block = r.block AS same_b, CAST(l.c_mktsegment = r.c_mktsegment AS INTEGER) AS m, CAST(l.bucket = r.bucket AS INTEGER) AS k,
  CASE WHEN l.block = r.block THEN 3 ELSE (SELECT CASE WHEN j >= 0.95 THEN 2 WHEN j >= 0.9 THEN 1 ELSE 0 END FROM (SELECT jaro_winkler_similarity(l.block, r.block) AS j)) END AS b FROM c l JOIN c r ON l.c_custkey < r.c_custkey)""",
        "v AS MATERIALIZED (SELECT same_b, m, k, b, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL)",
        "tot AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE same_b OR m = 1 OR k = 1) AS agreed FROM v)",
        "prior AS MATERIALIZED (SELECT least(greatest(agreed / 0.7 / t, 1e-9), 0.5) AS prior FROM tot)",
        "u AS MATERIALIZED (SELECT " + ", ".join(f"(coalesce(sum(n) FILTER (WHERE {x} = {g}), 0) + 0.5) / (sum(n) + {0.5 * size}) AS u{x}{g}" for x, size in levels.items() for g in range(size)) + " FROM v)",
    ]
    for rule, condition in (("b", "same_b"), ("m", "m = 1"), ("k", "k = 1")):
        own = [x for x in levels if x != rule]
        state = [f"m{x}{g}" for x in own for g in range(levels[x])]
        parts.append(f"n{rule} AS MATERIALIZED (SELECT {', '.join(own)}, sum(n) AS n FROM v WHERE {condition} GROUP BY ALL)")
        start = [f"CAST({0.1 / (levels[x] - 1) if g < levels[x] - 1 else 0.9} AS DOUBLE) AS m{x}{g}" for x in own for g in range(levels[x])]
        parts.append(f"{rule}0 AS (SELECT greatest(prior, 1e-4) AS share, FALSE AS done, {', '.join(start)} FROM prior)")
        ratios = " + ".join("CASE " + x + " " + " ".join(f"WHEN {g} THEN ln(greatest(m{x}{g}, 1e-12)) - ln(greatest(u{x}{g}, 1e-12))" for g in range(levels[x])) + " END" for x in own)
        for i in range(25):
            weights = [f"(coalesce(sum(p * n) FILTER (WHERE {x} = {g}), 0) + 1e-6) AS w{x}{g}" for x in own for g in range(levels[x])]
            parts.append(f"{rule}w{i} AS (SELECT share, done, {', '.join(state)}, sum(p * n) / sum(n) AS new, {', '.join(weights)} FROM (SELECT s.*, q.*, 1 / (1 + exp(-(ln(share / (1 - share)) + {ratios}))) AS p FROM {rule}{i} s, n{rule} q, u) GROUP BY ALL)")
            moved = [f"CASE WHEN done THEN m{x}{g} ELSE w{x}{g} / ({' + '.join(f'w{x}{h}' for h in range(levels[x]))}) END AS m{x}{g}" for x in own for g in range(levels[x])]
            parts.append(f"{rule}{i + 1} AS MATERIALIZED (SELECT CASE WHEN done THEN share ELSE least(greatest(new, 1e-9), 1 - 1e-9) END AS share, done OR abs(new - share) < 1e-4 AS done, {', '.join(moved)} FROM {rule}w{i})")
    means = [f"({' + '.join(f'{rule}25.m{x}{g}' for rule in levels if rule != x)}) / 2 AS m{x}{g}" for x in levels for g in range(levels[x])]
    parts.append(f"fit AS MATERIALIZED (SELECT prior, u.*, {', '.join(means)} FROM prior, u, b25, m25, k25)")
    weigh = " + ".join("CASE " + x + " " + " ".join(f"WHEN {g} THEN log2(greatest(m{x}{g}, 1e-12) / greatest(u{x}{g}, 1e-12))" for g in range(levels[x])) + " END" for x in levels)
    parts.append("tf AS (SELECT c_mktsegment AS value, count(*) / (SELECT count(c_mktsegment) FROM customer) AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)")
    parts.append(f"scored AS (SELECT left_id, right_id, log2(prior / (1 - prior)) + {weigh} + CASE WHEN m = 1 THEN log2(greatest(um1, 1e-12) / share) ELSE 0 END AS w FROM p JOIN tf ON seg = value, fit WHERE same_b)")
    return f"WITH {', '.join(parts)} SELECT left_id, right_id, round(w, 4) AS match_weight, round(1 / (1 + pow(2, -least(greatest(w, -60), 60))), 4) AS score FROM scored"


@_query(_em_sql())
def fellegi_sunter_em_customer(spark: SparkSession, d: str) -> DataFrame:
    """A model fitted to all pairs of three rules; u comes from the operator's number of pairs, which up to about 1,500 customers is all."""
    kinds = {"c_mktsegment": "categorical", "bucket": "numeric"}
    df = _customers(spark, d)
    model = score.fit_fellegi_sunter(df, "c_custkey", {"block": "identifier", **kinds})
    found = pairs.blocked_pairs(df, "c_custkey", ["block"], list(kinds), most=None)
    scored = model.score_pairs(found, {"block": "identifier", **kinds})
    return scored.select("left_id", "right_id", F.round("match_weight", 4).alias("match_weight"), F.round("score", 4).alias("score"))


_RULED = f"""WITH {_CUSTOMERS}, agreed AS (SELECT count(*) AS k FROM c l JOIN c r ON l.c_custkey < r.c_custkey AND (l.block = r.block OR l.bucket = r.bucket OR l.c_mktsegment = r.c_mktsegment)), n AS (SELECT count(*) AS n FROM customer)"""


@_query(f"{_RULED} SELECT k AS pairs, round(least(greatest(k / 0.7 / (n * (n - 1) / 2), 1e-9), 0.5), 9) AS prior FROM agreed, n")
def match_prior_customer(spark: SparkSession, d: str) -> DataFrame:
    df, rules = _customers(spark, d), ["block", "c_mktsegment", "bucket"]
    return spark.createDataFrame([(pairs.rule_pair_count(df, rules), score.estimate_prior(df, rules))], "pairs long, prior double").withColumn("prior", F.round("prior", 9))


@_query("""WITH s AS (SELECT *, CAST(floor(s_acctbal / 500) AS BIGINT) AS bucket FROM supplier), p AS (SELECT l.s_name AS a, r.s_name AS b, l.s_nationkey AS x, r.s_nationkey AS y, CAST(round(l.s_acctbal) AS VARCHAR) AS u, CAST(round(r.s_acctbal) AS VARCHAR) AS v FROM s l JOIN s r ON l.s_suppkey < r.s_suppkey AND l.bucket = r.bucket)
SELECT CAST(CASE WHEN a = b THEN 4 WHEN jaro_winkler_similarity(a, b) >= 0.95 THEN 3 WHEN jaro_winkler_similarity(a, b) >= 0.9 THEN 2 WHEN jaro_winkler_similarity(a, b) >= 0.8 THEN 1 ELSE 0 END AS INTEGER) AS gamma_s_name, CAST(x = y AS INTEGER) AS gamma_s_nationkey,
  CAST(CASE WHEN u = v THEN 3 WHEN levenshtein(u, v) <= 1 THEN 2 WHEN levenshtein(u, v) <= 2 THEN 1 ELSE 0 END AS INTEGER) AS gamma_balance_date, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def gamma_counts_supplier(spark: SparkSession, d: str) -> DataFrame:
    whole = F.round("s_acctbal").cast("long")
    # what rounds to zero from below keeps its sign
    sign = F.when((whole == 0) & F.col("s_acctbal").cast("string").startswith("-"), "-").otherwise("")
    balance = F.concat(sign, whole.cast("string"), F.lit(".0"))
    df = _table(spark, d, "supplier").withColumn("bucket", F.floor(F.col("s_acctbal") / 500)).withColumn("balance_date", balance)
    plan = C.comparison_plan({"s_name": "text", "s_nationkey": "categorical", "balance_date": "text"})
    return score.block_gamma_counts(df, "bucket", plan)


@_query(f"""WITH {_CUSTOMERS}, e AS (SELECT left_id AS a, right_id AS b FROM cp WHERE left_c_mktsegment = right_c_mktsegment AND left_bucket = right_bucket), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT c_custkey AS a, c_custkey AS b FROM customer UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a) SELECT a AS c_custkey, dense_rank() OVER (ORDER BY m) - 1 AS cluster FROM comp""".replace("WITH c AS", "WITH RECURSIVE c AS", 1))
def linker_clusters_customer(spark: SparkSession, d: str) -> DataFrame:
    df = _customers(spark, d).select("c_custkey", "block", "c_mktsegment", "bucket")
    return api.Linker(score.EvidenceScorer(), 1.0, "block").fit_predict(df, "c_custkey", {"c_mktsegment": "categorical", "bucket": "numeric"})


@_query(f"""WITH {_CUSTOMERS}, m AS (SELECT CAST(left_c_mktsegment = right_c_mktsegment AS INTEGER) + CAST(left_bucket = right_bucket AS INTEGER) AS matching_fields,
  concat_ws(', ', CASE WHEN left_c_mktsegment <> right_c_mktsegment THEN 'c_mktsegment' END, CASE WHEN left_bucket <> right_bucket THEN 'bucket' END) AS differing_fields FROM cp)
SELECT matching_fields, differing_fields, count(*) AS n FROM m GROUP BY 1, 2""")
def agreement_customer(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.blocked_pairs(_customers(spark, d), "c_custkey", ["block"], ["c_mktsegment", "bucket"])
    return metrics.agreement(found, ["c_mktsegment", "bucket"]).groupBy("matching_fields", "differing_fields").agg(F.count(F.lit(1)).alias("n"))


_CONTRAST = f"""WITH {_CUSTOMERS}, t AS (SELECT left_id, CAST(left_c_mktsegment = right_c_mktsegment AS INTEGER) + CAST(left_bucket = right_bucket AS INTEGER) AS matching_fields, (left_id + right_id) % 2 AS target, ((left_id * 31 + right_id * 17) % 1000) / 1000.0 AS score,
  concat_ws(', ', CASE WHEN left_c_mktsegment <> right_c_mktsegment THEN 'c_mktsegment' END, CASE WHEN left_bucket <> right_bucket THEN 'bucket' END) AS differing_fields FROM cp)"""


def _contrast_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.blocked_pairs(_customers(spark, d), "c_custkey", ["block"], ["c_mktsegment", "bucket"])
    marked = found.withColumn("target", ((F.col("left_id") + F.col("right_id")) % 2).cast("int")).withColumn("score", ((F.col("left_id") * 31 + F.col("right_id") * 17) % 1000) / F.lit(1000.0))
    return metrics.agreement(marked, ["c_mktsegment", "bucket"])


@_query(_CONTRAST + """SELECT matching_fields, count(*) FILTER (WHERE target = 0) AS count_negative, round(avg(score) FILTER (WHERE target = 0), 6) AS mean_negative, round(median(score) FILTER (WHERE target = 0), 6) AS median_negative,
  count(*) FILTER (WHERE target = 1) AS count_positive, round(avg(score) FILTER (WHERE target = 1), 6) AS mean_positive, round(median(score) FILTER (WHERE target = 1), 6) AS median_positive,
  round(median(score) FILTER (WHERE target = 1) - median(score) FILTER (WHERE target = 0), 6) AS median_gap FROM t GROUP BY matching_fields""")
def agreement_contrast_customer(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.agreement_contrast(_contrast_pairs(spark, d))
    return out.select("matching_fields", "count_negative", "count_positive", *[F.round(c, 6).alias(c) for c in ("mean_negative", "median_negative", "mean_positive", "median_positive", "median_gap")])


@_query(_CONTRAST + "SELECT differing_fields, count(*) AS count, round(avg(score), 6) AS mean, round(median(score), 6) AS median, CAST(min(score) AS DOUBLE) AS min, CAST(max(score) AS DOUBLE) AS max FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def differing_patterns_customer(spark: SparkSession, d: str) -> DataFrame:
    return metrics.differing_patterns(_contrast_pairs(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@_query(_CONTRAST + "SELECT 0.0::DOUBLE AS missing_cell_rate, count(*) AS n_pairs, round(avg(target), 9) AS prevalence, round(avg(CAST(matching_fields = 2 AS DOUBLE)) FILTER (WHERE target = 1), 9) AS exact_positive_pair_rate FROM t")
def overview_customer(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.overview(_customers(spark, d), ["c_mktsegment", "bucket"], _contrast_pairs(spark, d))
    return out.select("missing_cell_rate", "n_pairs", F.round("prevalence", 9).alias("prevalence"), F.round("exact_positive_pair_rate", 9).alias("exact_positive_pair_rate"))


# -- values ----------------------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_nationkey, round((c_acctbal - avg(c_acctbal) OVER w) / (stddev_pop(c_acctbal) OVER w + 1e-20), 6) AS c_acctbal_z FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def zscores_customer(spark: SparkSession, d: str) -> DataFrame:
    out = records.zscores(_table(spark, d, "customer"), ["c_acctbal"], ["c_nationkey"])
    return out.select("c_custkey", "c_nationkey", F.round("c_acctbal_z", 6).alias("c_acctbal_z"))


@_query("WITH f AS (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY p_brand), c AS (SELECT p_brand, row_number() OVER (ORDER BY f, p_brand) AS code FROM f) SELECT p_partkey, p_brand, code FROM part JOIN c USING (p_brand)")
def categorical_codes_part(spark: SparkSession, d: str) -> DataFrame:
    return records.categorical_codes(_table(spark, d, "part"), "p_brand", "p_partkey").select("p_partkey", "p_brand", "code")


@_query("SELECT o_orderkey, round((year(o_orderdate) - 2000) / 100, 6) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(isodow(o_orderdate) AS INTEGER) AS weekday FROM orders")
def date_parts_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", X.date_parts("o_orderdate").alias("p"))
    return rows.select("o_orderkey", F.round("p.year", 6).alias("year"), "p.month", "p.day", "p.weekday")


@_query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS identifier, TRY_CAST(regexp_extract(text, '[-+]?[0-9]+(?:\.[0-9]+)?') AS DOUBLE) AS number FROM documents""")
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", X.normalize_identifier("text").alias("identifier"), X.clean_numeric_text("text").alias("number"))


@_query(r"""WITH m AS (SELECT doc_id, regexp_extract(text, '\+?[0-9]?[ ]?\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}') AS raw, regexp_extract(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+') AS mail FROM documents), x AS (SELECT *, trim(raw) AS t, regexp_replace(raw, '[^0-9]', '', 'g') AS dg FROM m)
SELECT doc_id, CASE WHEN t NOT LIKE '+%' AND regexp_matches(dg, '^[2-9][0-9]{9}$') THEN '+1' || dg WHEN regexp_matches(dg, '^1[2-9][0-9]{9}$') THEN '+' || dg WHEN dg <> '' THEN CASE WHEN t LIKE '+%' THEN '+' ELSE '' END || dg ELSE lower(t) END AS phone, regexp_matches(regexp_replace(regexp_replace(raw, '^\+', ''), '[\s().\-/]', '', 'g'), '^[0-9]{7,15}$') AS is_phone,
lower(trim(mail)) AS email, regexp_matches(mail, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS is_email FROM x""")
def contact_values_documents(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract("text", "\\+?[0-9]?[ ]?\\(?[0-9]{3}\\)?[-. ][0-9]{3}[-. ][0-9]{4}", 0)
    mail = F.regexp_extract("text", "[A-Za-z0-9._]+@[A-Za-z0-9.]+\\.[a-z]+", 0)
    found = _table(spark, d, "documents").select("doc_id", raw.alias("raw"), mail.alias("mail"))
    return found.select("doc_id", X.normalize_phone("raw").alias("phone"), X.is_phone("raw").alias("is_phone"), X.normalize_email("mail").alias("email"), X.is_email("mail").alias("is_email"))


@_query("SELECT p_partkey, concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(p_brand), '')) AS text, 'part:' || p_partkey AS key, 'COL p_name VAL ' || trim(p_name) || ' COL p_brand VAL ' || trim(p_brand) AS colval, 'p_name: ' || trim(p_name) || '; p_brand: ' || trim(p_brand) AS record FROM part")
def serialize_part(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    return p.select("p_partkey", X.combine_text(p, ["p_name", "p_brand", "absent"]).alias("text"), X.source_key("part", "p_partkey").alias("key"), X.serialize_colval(["p_name", "p_brand"]).alias("colval"), X.serialize_record(["id", "p_name", "p_brand"]).alias("record"))


@_query("SELECT conv_id, turn, CASE WHEN x BETWEEN 1 AND 3 THEN x ELSE 0 END AS prediction, x = 1 AS pair FROM (SELECT conv_id, turn, CAST((conv_id + turn) % 6 AS INTEGER) AS x FROM conversations)")
def parse_predictions(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("record ["), ((F.col("conv_id") + F.col("turn")) % 6).cast("string"), F.lit("] of [9]"))
    return _table(spark, d, "conversations").select("conv_id", "turn", X.parse_prediction(answer, F.lit(3)).alias("prediction"), X.parse_pair_prediction(answer).alias("pair"))


@_query("""SELECT s_suppkey AS record_id, 's_name' AS "column", 'text' AS field_type, s_name IS NULL AS is_missing, NULL::DOUBLE AS number, NULL::VARCHAR AS category, s_name AS text FROM supplier
UNION ALL SELECT s_suppkey, 's_nationkey', 'categorical', s_nationkey IS NULL, NULL, CAST(s_nationkey AS VARCHAR), NULL FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', 'numeric', s_acctbal IS NULL, s_acctbal, NULL, NULL FROM supplier""")
def cells_supplier(spark: SparkSession, d: str) -> DataFrame:
    return records.cells(_table(spark, d, "supplier"), "s_suppkey", {"s_name": "text", "s_nationkey": "categorical", "s_acctbal": "numeric"}).drop("date")


@_query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS pos FROM supplier")
def positions_supplier(spark: SparkSession, d: str) -> DataFrame:
    return records.with_positions(_table(spark, d, "supplier"), ["s_acctbal", "s_suppkey"]).select("s_suppkey", "pos")


@_query("SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix_labels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_matrix(_table(spark, d, "labels"), "quality", "toxic")


@_query("""WITH c AS (SELECT CAST(x AS VARCHAR) AS class, count(*) FILTER (WHERE quality = x) AS support, count(*) FILTER (WHERE toxic = x) AS chosen, count(*) FILTER (WHERE quality = x AND toxic = x) AS hit FROM labels, (VALUES (0), (1)) v(x) GROUP BY x),
s AS (SELECT class, coalesce(hit / nullif(chosen, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2 * hit / nullif(support + chosen, 0), 0) AS f1, support, hit FROM c)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM s
UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), sum(support)::BIGINT FROM s
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM s""")
def classification_report_labels(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.classification_report(_table(spark, d, "labels"), "quality", "toxic")
    return out.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@_query("SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def best_rows_events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_rows(_table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@_query("SELECT event_type, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def mean_by_type_events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_by_step(_table(spark, d, "events"), "event_type", ("event_id", "user_id")).withColumn("value", F.round("value", 6))


# -- conversions and selectors ---------------------------------------------------------------------------------------


@_query("""WITH r AS (SELECT 'A' AS source_table, CAST(s_suppkey AS VARCHAR) AS source_id, s_name AS name, s_nationkey AS n FROM supplier UNION ALL SELECT 'B', CAST(n_nationkey AS VARCHAR), n_name, n_nationkey FROM nation),
k AS (SELECT n, min(source_table || ':' || source_id) AS k FROM r GROUP BY n), e AS (SELECT n, row_number() OVER (ORDER BY k) - 1 AS i FROM k)
SELECT 'sn:' || i AS entity_id, source_table, source_id, name FROM r JOIN e USING (n)""")
def convert_linkage_supplier_nation(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    n = _table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    matches = s.select(F.col("id").alias("left_id"), F.col("s_nationkey").cast("string").alias("right_id"))
    maps = (convert.TableMap("id", {"name": "name"}), convert.TableMap("id", {"name": "name"}))
    return convert.convert_linkage(s, n, matches, "sn", maps)


@_query("SELECT 'part' || (p_size % 3) AS source_table, p_brand AS entity_id, p_brand AS source_id, p_name FROM part")
def convert_snapshots_part(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part")
    return convert.convert_snapshots({f"part{i}": p.filter(F.col("p_size") % 3 == i) for i in range(3)}, "p_brand", ["p_name"]).select("source_table", "entity_id", "source_id", "p_name")


@_query()
def candidate_selector(spark: SparkSession, d: str) -> DataFrame:
    b = _table(spark, d, "benchmark")
    found = pairs.tfidf_neighbours(b, b, "item_id", "text", "item_id", "text", 3)
    chosen = selector.select(selector.candidate_prompts(found, b, b, "item_id", "item_id", ["text"], ["text"]))
    matches = b.select(F.col("item_id").alias("left_id"), F.col("item_id").alias("right_id"))
    return metrics.selector_metrics(selector.judge_selection(chosen, matches))


_FEATURES = "f AS (SELECT c1.c_custkey AS left_id, c2.c_custkey AS right_id, abs(c1.c_acctbal - c2.c_acctbal) AS gap, CAST(c1.bucket = c2.bucket AS INTEGER) AS same_bucket FROM c c1 JOIN c c2 ON c1.block = c2.block AND c1.c_custkey < c2.c_custkey)"


@_query(f"WITH {_CUSTOMERS}, {_FEATURES} SELECT left_id, right_id, round(1 / (1 + exp(-(0.25 - 0.04 * gap + 1.5 * same_bucket))), 9) AS score FROM f")
def logistic_scores_customer(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.blocked_pairs(_customers(spark, d), "c_custkey", ["block"], ["bucket", "c_acctbal"])
    marked = found.select("left_id", "right_id", F.abs(F.col("left_c_acctbal") - F.col("right_c_acctbal")).alias("gap"), (F.col("left_bucket") == F.col("right_bucket")).cast("int").alias("same_bucket"))
    scored = score.LogisticScorer(["gap", "same_bucket"], [-0.04, 1.5], 0.25).score_pairs(marked)
    return scored.select("left_id", "right_id", F.round("score", 9).alias("score"))


@_query()
def logistic_customer(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.blocked_pairs(_customers(spark, d), "c_custkey", ["block"], ["c_mktsegment", "bucket", "c_acctbal"])
    marked = found.select("left_id", "right_id", F.abs(F.col("left_c_acctbal") - F.col("right_c_acctbal")).alias("gap"), (F.col("left_bucket") == F.col("right_bucket")).cast("int").alias("same_bucket"), (F.col("left_c_mktsegment") == F.col("right_c_mktsegment")).cast("int").alias("target"))
    model = score.fit_logistic(marked, ["gap", "same_bucket"])
    return model.score_pairs(marked).select("left_id", "right_id", "score")


@_query()
def transformer_blocks_supplier(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal")
    return neural.score_blocks(s, neural.RecordTransformer.random(), "s_suppkey", {"s_name": "text", "s_acctbal": "numeric"}, "s_nationkey")


# -- synthetic worlds ------------------------------------------------------------------------------------------------


_WORLD = ["first_name", "last_name", "email_address", "phone", "city", "date_of_birth"]


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """A record for each customer; two customers in a row are one entity."""
    return _table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("record"), F.expr("c_custkey div 2").cast("long").alias("entity"))


@_query()
def synthetic_world(spark: SparkSession, d: str) -> DataFrame:
    return synth.generate_world(spark, seed=1337, fields=_WORLD, assigned=_assigned(spark, d)).records


@_query()
def synthetic_world_lookups(spark: SparkSession, d: str) -> DataFrame:
    """As above, with nicknames and area codes from their tables."""
    short = spark.createDataFrame([(a, "has_nickname", b) for a, b in synth.NICKNAMES], "name1 string, relationship string, name2 string")
    codes = lookups.area_codes(spark.createDataFrame([(c, s) for s, c in worldgraph.AREA.items()], "`Area Code` string, Region string"))
    world = synth.generate_world(spark, seed=1337, fields=_WORLD, nicknames=lookups.nickname_aliases(short), assigned=_assigned(spark, d), rules=worldgraph.rules_with_area_codes(codes))
    return world.records


@_query()
def synthetic_worlds(spark: SparkSession, d: str) -> DataFrame:
    """Three worlds, of a third of the customers each."""
    rows = None
    for i in range(3):
        assigned = _assigned(spark, d).filter(F.col("entity") % 3 == i)
        w = synth.generate_world(spark, n_fields=4 + 2 * i, seed=7 + i, assigned=assigned)
        some = w.records.select(F.lit(i).alias("world"), "record_id", "entity_id", F.to_json(F.struct(*w.field_types)).alias("fields"))
        rows = some if rows is None else rows.unionByName(some)
    return rows


@_query()
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """As many entities as there are customers, three in ten of them near-misses of others."""
    rules = worldgraph.choose_rules(worldgraph.ancestors(_WORLD), 5)
    people = synth.entities(spark, _table(spark, d, "customer").count(), _WORLD, 5, rules)
    return synth.add_hard_negatives(people, 0.3, 5, rules).select("entity", "base", "contract", *_WORLD)


@_query("SELECT lower(r_name) AS name, list_sort(list(lower(n_name))) AS aliases FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT lower(n_name), [lower(r_name)] FROM nation JOIN region ON n_regionkey = r_regionkey")
def nickname_aliases_nation(spark: SparkSession, d: str) -> DataFrame:
    n, r = _table(spark, d, "nation"), _table(spark, d, "region")
    triplets = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("name1"), F.lit("has_nickname").alias("relationship"), F.col("n_name").alias("name2"))
    return lookups.nickname_aliases(triplets)


@_query("""SELECT 'COL p_name VAL ' || l.p_name AS "left", 'COL p_name VAL ' || r.p_name AS "right", '1' AS label FROM part l JOIN part r ON l.p_partkey + 1 = r.p_partkey""")
def pair_lines_part(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select("p_partkey", "p_name")
    joined = p.select((F.col("p_partkey") + 1).alias("k"), F.col("p_name").alias("left_p_name")).join(p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("right_p_name")), "k").withColumn("label", F.lit(1))
    return sinks.pair_lines(joined, ["p_name"])


# -- runs and the user's interface ------------------------------------------------------------------------------------


@_query("""WITH b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS f FROM events)
SELECT user_id, max(event_id) FILTER (WHERE r = 1) AS best_step, max(value) FILTER (WHERE r = 1) AS best, max(event_id) FILTER (WHERE f = 1) AS final_step, max(value) FILTER (WHERE f = 1) AS final FROM b GROUP BY user_id""")
def best_and_final_events(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_and_final(_table(spark, d, "events"), "user_id", "value", "event_id")


@_query("SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 9) AS mean_n FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def batch_shapes_conversations(spark: SparkSession, d: str) -> DataFrame:
    sizes = _table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.batch_shapes(sizes, ["n"]).withColumn("mean_n", F.round("mean_n", 9))


@_query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 7 OFFSET 3")
def page_supplier(spark: SparkSession, d: str) -> DataFrame:
    return runs.page(_table(spark, d, "supplier"), ["s_acctbal", "s_suppkey"], 3, 7).select("s_suppkey", "s_name")


@_query("SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || ':3'), c_custkey) AS r FROM customer) WHERE r <= 5")
def cap_per_group_customer(spark: SparkSession, d: str) -> DataFrame:
    return runs.cap_per_group(_table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"], 5, 3).select("c_custkey", "c_nationkey")


@_query("SELECT c_nationkey, max(m) FILTER (WHERE s = 'BUILDING') AS BUILDING, max(m) FILTER (WHERE s = 'MACHINERY') AS MACHINERY FROM (SELECT c_nationkey, c_mktsegment AS s, max(c_acctbal) AS m FROM customer GROUP BY 1, 2) GROUP BY c_nationkey")
def threshold_pivot_customer(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("m"))
    return runs.threshold_pivot(rows, "c_nationkey", "c_mktsegment", "m", ["BUILDING", "MACHINERY"])


@_query("""SELECT 's_name' AS field, 0.0::DOUBLE AS missing_rate, count(DISTINCT s_name) AS distinct_values, count(*) AS records, count(DISTINCT s_nationkey) AS entities FROM supplier UNION ALL SELECT 's_acctbal', 0.0, count(DISTINCT s_acctbal), count(*), count(DISTINCT s_nationkey) FROM supplier""")
def describe_world_supplier(spark: SparkSession, d: str) -> DataFrame:
    return runs.describe_world(_table(spark, d, "supplier"), "s_nationkey", ["s_name", "s_acctbal"])


@_query("SELECT o_custkey AS entity, count(*) AS orders, sum(l_quantity) AS quantity FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY o_custkey")
def joined_history_orders(spark: SparkSession, d: str) -> DataFrame:
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("l_quantity"))
    joined = runs.joined_history(_table(spark, d, "orders"), lines, on="o_orderkey")
    return joined.groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("orders"), F.sum("l_quantity").alias("quantity"))


@_query()
def linker_clusters_supplier(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal")
    return api.Linker(threshold=0.55, block="s_nationkey").fit_predict(s, "s_suppkey", {"s_name": "text", "s_acctbal": "numeric"})


# -- values, profiles and prompts --------------------------------------------------------------------------------------


@_query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN nullif(nullif(lang, ''), 'nan') END AS lang, doc_id % 3 AS kind FROM documents")
def clean_frame_documents(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    rows = _table(spark, d, "documents").select("doc_id", F.when(kind == 0, "").when(kind == 1, "nan").otherwise(F.col("lang")).alias("lang"), kind.alias("kind"))
    return X.clean_frame(rows)


@_query("""SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS filled, lower('A ' || c_mktsegment || ' B') AS identifier, lower(c_mktsegment || '@X.example') AS email, c_mktsegment AS text,
  upper(c_name[1:2]) AS state, trim(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment || ' ' END || c_name) AS person, CASE WHEN c_custkey % 4 = 0 THEN 'the United States' ELSE c_mktsegment || ', ' || c_mktsegment END AS place, c_name AS company FROM customer""")
def identifier_texts_customer(spark: SparkSession, d: str) -> DataFrame:
    some = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return _table(spark, d, "customer").select(
        "c_custkey", X.normalize_id(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("id"), X.fill_missing(some).alias("filled"), X.identifier_text("identifier", F.concat(F.lit("  A\t"), "c_mktsegment", F.lit("  B "))).alias("identifier"),
        X.identifier_text("email", F.concat(F.lit(" "), "c_mktsegment", F.lit("@X.example"))).alias("email"), X.identifier_text("text", "c_mktsegment").alias("text"), X.normalize_state("c_name").alias("state"), X.format_person_name(some, "c_name").alias("person"),
        X.format_location(some, some).alias("place"), X.format_company(F.concat("c_name", F.lit(". ."), F.lit("."))).alias("company_"),
    ).withColumn("company", F.regexp_replace("company_", "\\. $", "")).drop("company_")


@_query(r"""WITH w AS (SELECT doc_id, split_part(coalesce(text, ''), ' ', 1) AS w FROM documents) SELECT doc_id, coalesce(nullif(lower(regexp_replace(strip_accents(w), '[^a-zA-Z0-9]+', '', 'g')), ''), 'user') AS token, coalesce(nullif(upper(regexp_replace(strip_accents(w), '[^a-zA-Z0-9]+', '', 'g')), ''), 'ID') AS upper_token FROM w""")
def name_tokens_documents(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "documents").select("doc_id", F.element_at(F.split(X.fill_missing("text"), " "), 1).alias("w"))
    return words.select("doc_id", X.name_token("w").alias("token"), X.name_token("w", "ID", True).alias("upper_token"))


_PHONES = """WITH p AS (SELECT c_custkey, c_custkey % 5 AS k, CAST(c_nationkey + 10 AS VARCHAR) AS code, CAST(2000000000 + c_custkey * 7919 AS VARCHAR) AS n FROM customer)"""


@_query(f"{_PHONES} SELECT c_custkey, CASE WHEN k < 4 THEN '+' || code || n ELSE '+99' || n END AS e164 FROM p")
def phones_of_all_countries_customer(spark: SparkSession, d: str) -> DataFrame:
    """Numbers made of the customers' keys, written in five ways; the calling codes are those of the nations, and 99 is none."""
    nations = _table(spark, d, "nation")
    codes = nations.select((F.col("n_nationkey") + 10).cast("string").alias("code"), F.col("n_name").alias("region"), F.lit(10).alias("least"), F.lit(10).alias("most"), F.lit("0").alias("trunk"))
    k, n = F.col("c_custkey") % 5, (F.lit(2_000_000_000) + F.col("c_custkey") * 7919).cast("string")
    dash, code = F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 7)), (F.col("c_nationkey") + 10).cast("string")
    phone = F.when(k == 0, F.concat(F.lit("+"), code, F.lit(" "), dash)).when(k == 1, F.concat(F.lit("00 "), code, F.lit("/"), dash)).when(k == 2, F.concat(F.lit("0"), dash)).when(k == 3, F.concat(F.lit("("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 7))).otherwise(F.concat(F.lit("+99 "), dash))
    rows = _table(spark, d, "customer").join(F.broadcast(nations.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", phone.alias("phone"))
    return phones.normalize_phones(rows, "phone", codes, F.col("n_name")).select("c_custkey", "e164")


#: Each part depends on those of a half and a third of its number.
_PARTS = "e AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey >= 3)"


def _part_edges(spark: SparkSession, d: str) -> DataFrame:
    key = _table(spark, d, "part").select(F.col("p_partkey").alias("child"))
    return key.filter("child >= 2").select(F.expr("child div 2").alias("parent"), "child").unionByName(key.filter("child >= 3").select(F.expr("child div 3").alias("parent"), "child"))


@_query(f"WITH RECURSIVE {_PARTS}, w AS (SELECT parent AS node, 0 AS layer FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT e.child, layer + 1 FROM w JOIN e ON w.node = e.parent) SELECT node, max(layer) AS layer FROM w GROUP BY node")
def layers_part(spark: SparkSession, d: str) -> DataFrame:
    return dag.layers(_part_edges(spark, d))


@_query(f"""WITH RECURSIVE {_PARTS}, w AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS distance FROM part WHERE p_size = 50 UNION SELECT start, e.parent, distance + 1 FROM w JOIN e ON w.node = e.child)
SELECT start, node, min(distance) AS distance FROM w WHERE distance > 0 GROUP BY start, node""")
def ancestors_part(spark: SparkSession, d: str) -> DataFrame:
    starts = _table(spark, d, "part").filter("p_size = 50")
    return dag.closure(_part_edges(spark, d), starts, "p_partkey", up=True)


@_query(f"""WITH RECURSIVE {_PARTS}, w AS (SELECT child AS node FROM e WHERE parent IN (2, 3) AND child % 5 <> 0 UNION SELECT e.child FROM w JOIN e ON w.node = e.parent WHERE e.child % 5 <> 0)
SELECT node FROM w WHERE node NOT IN (2, 3)""")
def blocked_descendants_part(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return dag.descendants(_part_edges(spark, d), part.filter("node in (2, 3)"), blocked=part.filter("node % 5 = 0"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%y') AS suffix FROM orders")
def birth_year_suffix_orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", X.birth_year_suffix(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("suffix"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_HEAD = _quoted("\n\nGiven entity record:\n")
_LIST = _quoted("\n\nCandidate records:\n")


@_query(f"""SELECT item_id, {_quoted(X._SELECT + X._MANY)} || {_HEAD} || text || {_LIST} || '[1] ' || reverse(text) || chr(10) || '[2] ' || text || chr(10) AS prompt, {_quoted(X._SELECT + X._ONE)} || {_HEAD} || text || {_LIST} || '[1] ' || text || chr(10) AS pair_prompt FROM benchmark""")
def prompts_benchmark(spark: SparkSession, d: str) -> DataFrame:
    b = _table(spark, d, "benchmark")
    return b.select("item_id", X.make_prompt("text", F.array(F.reverse("text"), F.col("text"))).alias("prompt"), X.make_pair_prompt("text", "text").alias("pair_prompt"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A labelled pair of profiles for each customer."""
    key = F.col("c_custkey").cast("string")
    side = lambda n: F.struct(F.concat("c_name", F.lit(n)).alias("fullname"), F.array(F.concat(key, F.lit("@x.example")), F.lit(""), F.lit(n)).alias("email"), F.array(key).alias("phone"), F.array().cast("array<string>").alias("addr"), F.lit("1990-01-02").alias("dob"))
    return _table(spark, d, "customer").select((F.col("c_custkey") % 2 == 0).alias("match"), side("a").alias("profile1"), side("b").alias("profile2"), F.col("c_custkey").alias("line"))


_SIDES = "sides AS (SELECT c_custkey, c_name, s, n FROM customer, (VALUES ('profile1', 'a'), ('profile2', 'b')) v(s, n))"


@_query(f"""WITH {_SIDES} SELECT 'pair:' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ':' || s END AS entity_id, 'pair:' || c_custkey AS pair_id, s AS source_table, c_custkey % 2 = 0 AS match_label, c_name || n AS fullname, c_custkey || '@x.example | ' || n AS email, CAST(c_custkey AS VARCHAR) AS phone, '' AS addr, '1990-01-02' AS dob FROM sides""")
def profile_records_customer(spark: SparkSession, d: str) -> DataFrame:
    return convert.profile_records(_profiles(spark, d))


@_query(f"""WITH {_SIDES} SELECT c_custkey AS line, 'fullname: ' || c_name || 'a; email: ' || c_custkey || '@x.example |  | a; phone: ' || c_custkey || '; dob: 1990-01-02' AS profile FROM sides WHERE n = 'a'""")
def serialize_profile_customer(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("line", X.serialize_profile("profile1").alias("profile"))


@_query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line, c_custkey % 2 = 0 AS match, c_name || 'a' AS fullname FROM customer")
def read_profile_pairs_customer(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "profiles")
    _profiles(spark, d).orderBy("line").withColumn("match", F.when(F.col("match"), "True").otherwise("False")).drop("line").write.json(path)
    return convert.read_profile_pairs(spark, path).select("line", "match", F.col("profile1.fullname").alias("fullname"))


@_query("(SELECT c_custkey AS line FROM customer WHERE c_custkey % 2 = 0 ORDER BY c_custkey LIMIT 30) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1 ORDER BY c_custkey LIMIT 30)")
def balanced_pairs_customer(spark: SparkSession, d: str) -> DataFrame:
    return convert.balanced_pairs(_profiles(spark, d), 30).select("line")


@_query("""WITH k AS (SELECT p_partkey AS a, row_number() OVER (ORDER BY 'A:' || p_partkey) - 1 AS i FROM part WHERE p_partkey % 2 = 0)
SELECT 'walmart_amazon:' || i AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS source_table, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, p_brand AS brand, p_type AS modelno, CAST(p_size AS DOUBLE) AS price, p_type AS category, p_name || ' ' || p_type AS description FROM part JOIN k ON p_partkey - p_partkey % 2 = a""")
def convert_walmart_amazon_part(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    columns = [F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("modelno"), F.concat(F.lit("$"), "p_size", F.lit(" each")).alias("price"), F.col("p_type").alias("category")]
    a = p.filter("p_partkey % 2 = 0").select("id", *columns, F.col("p_name").alias("shortdescr"), F.concat(F.lit(" "), "p_type").alias("longdescr"))
    b = p.filter("p_partkey % 2 = 1").select("id", *columns, F.col("p_name").alias("proddescrshort"), F.col("p_type").alias("proddescrlong"))
    matches = p.filter("p_partkey % 2 = 0").select(F.col("id").alias("left_id"), (F.col("p_partkey") + 1).cast("string").alias("right_id"))
    return convert.convert_linkage(a, b, matches, "walmart_amazon")


@_query("SELECT p_partkey, 'USD ' || p_size || ',00' AS price_text, CAST(p_size AS DOUBLE) AS price_numeric, CAST(p_size AS DOUBLE) AS price FROM part")
def price_variants_part(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "part").select("p_partkey", F.concat(F.lit("USD "), "p_size", F.lit(",00")).alias("price"))
    return convert.both_prices(p).join(convert.numeric_price(p), "p_partkey")


@_query("SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 <> 0")
def convert_people_customer(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer").withColumn("person", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")))
    return convert.convert_people(c, "person", {"c_name": "name", "c_mktsegment": "segment"})


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ' é' AS n_name FROM nation")
def read_text_csv_nation(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "latin-1")
    _table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(" é")).alias("n_name"), "n_regionkey").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return catalog.read_text_csv(spark, path, ["n_nationkey", "n_name"])


@_query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def remaining_nation(spark: SparkSession, d: str) -> DataFrame:
    path, n = storage.scratch(spark, "done"), _table(spark, d, "nation").select("n_nationkey", "n_name")
    for k in (0, 2):
        some = sinks.remaining(n.filter(F.col("n_nationkey") % 4 == k), path, ["n_nationkey"], "n_nationkey int, n_name string")
        sinks.append_json(some, path)
    return sinks.remaining(n, path, ["n_nationkey"], "n_nationkey int, n_name string")


@_query("""SELECT r_name AS benchmark, 'region' AS kind, 2 AS n_fields, 'vote' AS baseline, n_name AS policy, n_nationkey * 10 AS n_records, CAST(n_nationkey * 10 * (n_nationkey * 10 - 1) // 2 AS BIGINT) AS n_pairs, CASE WHEN n_name = 'NATION_0' THEN 'zero' ELSE 'vote:' || n_name END AS model
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def results_table_nation(spark: SparkSession, d: str) -> DataFrame:
    r, n = _table(spark, d, "region"), _table(spark, d, "nation")
    metadata = r.select(F.col("r_name").alias("benchmark"), F.lit("region").alias("kind"), F.lit(2).alias("n_fields"))
    results = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(F.col("r_name").alias("benchmark"), F.lit("vote").alias("baseline"), F.col("n_name").alias("policy"), (F.col("n_nationkey") * 10).alias("n_records"))
    return catalog.results_table(metadata, results, {"NATION_0": "zero"})


_CODES = f"codes AS (SELECT {list(lookups.STATES)}[1 + n_nationkey % 5] AS state, CAST(200 + n_nationkey AS VARCHAR) AS code FROM nation)"


def _area_codes(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*map(F.lit, lookups.STATES))
    raw = _table(spark, d, "nation").select(F.concat(F.lit(" "), (F.col("n_nationkey") + 200).cast("string")).alias("Area Code"), F.element_at(states, F.col("n_nationkey") % 5 + 1).alias("Region"))
    return lookups.area_codes(raw.unionByName(spark.createDataFrame([("99", "AL"), ("300", "ZZ")], "`Area Code` string, Region string")))


@_query(f"WITH {_CODES} SELECT state, list_sort(list(code)) AS codes FROM codes GROUP BY state")
def area_codes_nation(spark: SparkSession, d: str) -> DataFrame:
    return _area_codes(spark, d)


@_query(f"WITH {_CODES}, s AS (SELECT state, list_sort(list(code)) AS codes FROM codes GROUP BY state) SELECT s_suppkey, coalesce(codes, (SELECT list_sort(list(code)) FROM codes)) AS codes FROM supplier LEFT JOIN s ON state = {list(lookups.STATES)}[1 + s_suppkey % 9]")
def area_code_lookup_supplier(spark: SparkSession, d: str) -> DataFrame:
    codes = _area_codes(spark, d)
    every = F.array(*map(F.lit, lookups.general_area_codes(codes).first()["codes"]))
    state = F.element_at(F.array(*map(F.lit, lookups.STATES)), (F.col("s_suppkey") % 9 + 1).cast("int"))
    return lookups.with_lookup(_table(spark, d, "supplier").select("s_suppkey"), state, codes, "state", "codes", every, "codes")


@_query("SELECT s_suppkey, row_number() OVER (ORDER BY md5(s_suppkey || ':5'), s_suppkey) - 1 AS place FROM supplier")
def shuffled_supplier(spark: SparkSession, d: str) -> DataFrame:
    return runs.shuffled(_table(spark, d, "supplier"), ["s_suppkey"], 5, "place").select("s_suppkey", "place")


@_query("""WITH x AS (SELECT quality = 1 AS m, doc_id % 3 < 2 AS h, CAST(doc_id % 4 AS INTEGER) AS p, quality = 1 AND doc_id % 3 < 2 AND doc_id % 4 = 2 AS c, doc_id % 50 AS t, doc_id % 17 = 0 AS e FROM labels), k AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE c) AS DOUBLE) AS tp, count(*) FILTER (WHERE p > 0) AS chosen, count(*) FILTER (WHERE m) AS ms, count(*) FILTER (WHERE m AND h) AS hits, sum(t) AS t, count(*) FILTER (WHERE e) AS e FROM x)
SELECT n, round(hits / ms, 9) AS candidate_recall, round(tp / chosen, 9) AS precision, round(tp / ms, 9) AS recall, round(2 * tp / (chosen + ms), 9) AS f1, CAST(t AS BIGINT) AS prompt_tokens, n AS completion_tokens, e AS errors FROM k""")
def selector_metrics_labels(spark: SparkSession, d: str) -> DataFrame:
    m, h, p = F.col("quality") == 1, F.col("doc_id") % 3 < 2, (F.col("doc_id") % 4).cast("int")
    rows = _table(spark, d, "labels").select(m.alias("has_match"), h.alias("candidate_hit"), p.alias("prediction"), (m & h & (p == 2)).alias("correct"), (F.col("doc_id") % 50).alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"), F.when(F.col("doc_id") % 17 == 0, "x").alias("error"))
    out = metrics.selector_metrics(rows)
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("candidate_recall", "precision", "recall", "f1")], "prompt_tokens", "completion_tokens", "errors")


@_query(_CONTRAST + """SELECT left_id % 3 AS benchmark, count(*) AS n_pairs, round(avg(target), 9) AS prevalence, round(median(score) FILTER (WHERE target = 1), 9) AS median_positive, round(median(score) FILTER (WHERE target = 0), 9) AS median_negative,
  round(avg(CAST(matching_fields = 2 AS DOUBLE)) FILTER (WHERE target = 1), 9) AS exact_positive_rate, round(avg(CAST(matching_fields = 2 AS DOUBLE)) FILTER (WHERE target = 0), 9) AS exact_negative_rate FROM t GROUP BY 1""")
def benchmark_diagnostics_customer(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.benchmark_diagnostics(_contrast_pairs(spark, d).withColumn("benchmark", F.col("left_id") % 3), "benchmark", 2)
    return out.select("benchmark", "n_pairs", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@_query("SELECT round(avg(f1), 9) AS f1, round(avg(recall), 9) AS recall FROM (SELECT event_type AS name, avg(value) AS f1, max(value) AS recall FROM events GROUP BY 1)")
def mean_metrics_events(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("f1"), F.max("value").alias("recall"))
    return metrics.mean_metrics(rows).select(F.round("f1", 9).alias("f1"), F.round("recall", 9).alias("recall"))


@_query("SELECT quality AS split, count(*) AS pairs, CAST(sum(toxic) AS BIGINT) AS positives, CAST(sum(1 - toxic) AS BIGINT) AS negatives FROM labels GROUP BY 1")
def split_counts_labels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.split_counts(_table(spark, d, "labels").select(F.col("quality").alias("split"), F.col("toxic").alias("label")))
