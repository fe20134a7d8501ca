"""Evaluation of scored pairs and of clusters.

Curves are made from counts per distinct score, so what windows and sums run over is one row per score. Scored pairs
have columns score and target (0 or 1). A pair that blocking left out has score 0 and is brought in as a count. Where
`count` names a column, a row stands for so many pairs of its score and target: all pairs of a large table are counted
where they are made (see pairs.cosine_counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.storage import written


def with_target(pairs: DataFrame, entity: str = "entity_id") -> DataFrame:
    """target: 1 if both sides have the same entity."""
    return pairs.withColumn("target", F.coalesce((F.col(f"left_{entity}") == F.col(f"right_{entity}")).cast("int"), F.lit(0)))


def _weight(count: str | None) -> Column:
    return F.col(count).cast("long") if count else F.lit(1).cast("long")


def score_counts(scored: DataFrame, digits: int | None = None, missing_positives: int = 0, missing_negatives: int = 0, count: str | None = None) -> DataFrame:
    """score, p, n: positives and negatives of each distinct score; pairs that were not generated are added at score 0."""
    score = F.col("score") if digits is None else F.round("score", digits)
    rows = scored.select(score.alias("score"), (F.col("target") * _weight(count)).cast("long").alias("p"), ((1 - F.col("target")) * _weight(count)).cast("long").alias("n"))
    if missing_positives or missing_negatives:
        rows = rows.unionByName(scored.sparkSession.createDataFrame([(0.0, missing_positives, missing_negatives)], "score double, p long, n long"))
    return rows.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def cumulative(counts: DataFrame) -> DataFrame:
    """Add tp and fp (counts of this score and all higher ones) to score counts, without a window over all rows.

    Scores are range-partitioned from high to low and written once; each part is summed by a window of its own, and
    what the parts before it hold is added from a small table.
    """
    order = F.col("score").desc()
    dealt = written(counts.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "cumulative")
    sums = dealt.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # a row for each part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_part", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_fp"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("tp", F.sum("p").over(within)).withColumn("fp", F.sum("n").over(within)).join(F.broadcast(carried), "_part")
    return summed.select("score", "p", "n", (F.col("tp") + F.col("_tp")).alias("tp"), (F.col("fp") + F.col("_fp")).alias("fp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def curve(counts: DataFrame) -> DataFrame:
    """score, precision, recall, f1, and totals of the curve that a threshold at each score gives."""
    summed = cumulative(counts)
    totals = summed.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    rows = summed.crossJoin(F.broadcast(totals))  # a single row
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("positives"))
    return rows.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)))


def curve_summary(counts: DataFrame) -> DataFrame:
    """One row: n_pairs, prevalence, pr_auc, roc_auc, best_pair_f1, best_pair_threshold; areas are null with one class only."""
    points = curve(counts)
    p, n, tp = F.col("p"), F.col("n"), F.col("tp")
    # a score's step in recall is p / positives
    sums = points.agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.sum(p * F.col("precision")).alias("ap"),
        F.sum(n * (tp - p + p / 2)).alias("rank"),
        F.max(F.struct("f1", (-F.col("score")).alias("t"))).alias("best"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        (F.col("positives") + F.col("negatives")).alias("n_pairs"),
        (F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("prevalence"),
        F.when(both, F.col("ap") / F.nullif("positives", F.lit(0))).alias("pr_auc"),
        F.when(both, F.col("rank") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("roc_auc"),
        F.col("best.f1").alias("best_pair_f1"),
        (-F.col("best.t")).alias("best_pair_threshold"),
    )


def threshold_metrics(scored: DataFrame, threshold: float = 0.5, missing_positives: int = 0, count: str | None = None) -> DataFrame:
    """One row: tp, fp, fn, pair_precision, pair_recall, pair_f1 at a threshold (inclusive); no denominator gives 0."""
    hit = F.col("score") >= threshold
    positives, negatives = F.col("target") * _weight(count), (1 - F.col("target")) * _weight(count)
    sums = scored.agg(
        F.coalesce(F.sum(F.when(hit, positives)), F.lit(0)).cast("long").alias("tp"),
        F.coalesce(F.sum(F.when(hit, negatives)), F.lit(0)).cast("long").alias("fp"),
        (F.coalesce(F.sum(F.when(~hit, positives)), F.lit(0)) + missing_positives).cast("long").alias("fn"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("pair_precision", precision).withColumn("pair_recall", recall).withColumn("pair_f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def adjusted_rand(labels: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row, adjusted_rand, of two labellings of the same records; 1 if they are equal."""
    table = labels.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    square = lambda df: df.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("t"))
    rows = square(table.groupBy(truth).agg(F.sum("n").alias("n"))).select(F.col("s").alias("a"))
    columns = square(table.groupBy(predicted).agg(F.sum("n").alias("n"))).select(F.col("s").alias("b"))
    all_ = square(table).crossJoin(rows).crossJoin(columns)  # single rows
    n, s, a, b = F.col("t"), F.col("s"), F.col("a"), F.col("b")
    tp, fp, fn, tn = s - n, b - s, a - s, n * n - a - b + s
    below = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    return all_.select(F.when((fp == 0) & (fn == 0), F.lit(1.0)).otherwise(2 * (tp * tn - fn * fp) / F.nullif(below, F.lit(0.0))).alias("adjusted_rand"))


def candidate_stats(candidates: DataFrame, n_records: int, true_pairs: int, n_pairs: int | None = None, count: str | None = None) -> DataFrame:
    """One row: candidate_pairs, candidate_fraction (of n_pairs; of all pairs, if not given), true_pair_candidate_recall."""
    every = n_records * (n_records - 1) // 2 if n_pairs is None else n_pairs
    sums = candidates.agg(F.coalesce(F.sum(_weight(count)), F.lit(0).cast("long")).alias("candidate_pairs"), F.coalesce(F.sum(F.col("target") * _weight(count)), F.lit(0)).alias("_true"))
    return sums.select("candidate_pairs", (F.col("candidate_pairs") / F.lit(max(every, 1))).alias("candidate_fraction"), (F.col("_true") / F.lit(max(true_pairs, 1))).alias("true_pair_candidate_recall"))


def true_pair_count(records: DataFrame, entity: str) -> DataFrame:
    """One row, true_pairs, from entity sizes."""
    sizes = records.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("true_pairs"))


def scope_totals(records: DataFrame, entity: str, source: str | None = None) -> DataFrame:
    """One row, n_pairs and true_pairs: of all pairs of records, or of those whose sources differ; from counts alone.

    Records without a source are in no pair across sources, those without an entity in no true pair.
    """
    of = F.expr("n * (n - 1) div 2")
    cells = records.select(F.col(entity).alias("e"), (F.col(source) if source else F.lit(0)).alias("s")).filter("s is not null").groupBy("e", "s").agg(F.count(F.lit(1)).alias("n"))

    def made(by: list[str], name: str) -> DataFrame:
        sizes = (cells.filter("e is not null") if "e" in by else cells).groupBy(*by).agg(F.sum("n").alias("n"))
        return sizes.agg(F.coalesce(F.sum(of), F.lit(0)).alias(name))

    both = made([], "n_pairs").crossJoin(made(["e"], "true_pairs"))  # single rows
    if not source:
        return both
    within = made(["s"], "_pairs").crossJoin(made(["e", "s"], "_true"))
    return both.crossJoin(within).select((F.col("n_pairs") - F.col("_pairs")).alias("n_pairs"), (F.col("true_pairs") - F.col("_true")).alias("true_pairs"))


def evaluate(name: str, records: DataFrame, record_id: str, entity: str, scored: DataFrame, threshold: float = 0.5, clusters: DataFrame | None = None, all_pairs: bool = True, digits: int | None = None, totals: tuple[int, int] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row with all metrics of a benchmark.

    scored: left_id, right_id, score, target. totals: pairs and true pairs of the benchmark's scope (see scope_totals); if
    not given, those of all pairs of records, or, without all_pairs, of the scored ones. Pairs of the scope that are not
    scored count as score 0. clusters: record_id and component_id (found from the pairs at the threshold if not given).
    One class only is an error. counts: score, target and n of all scored pairs; scored then needs no pairs below the
    threshold.
    """
    from kindred.operators.graph import component_labels

    scored = written(scored.select("left_id", "right_id", "score", "target"), "scored")  # several aggregations read it
    count = "n" if counts is not None else None
    each = written(counts.select("score", "target", "n"), "score-counts") if counts is not None else scored
    size = records.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("e")).first()
    found = each.agg(F.coalesce(F.sum(_weight(count)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("target") * _weight(count)), F.lit(0)).alias("p")).first()
    every, true_pairs = totals or (tuple(scope_totals(records, entity).first()) if all_pairs else (found["n"], found["p"]))
    if found["p"] > true_pairs or found["n"] - found["p"] > every - true_pairs:
        raise ValueError(f"benchmark {name!r} has scored pairs that are not in its scope")
    if true_pairs in (0, every):
        raise ValueError(f"benchmark {name!r} has pairs of one class only")
    lost_p, lost_n = true_pairs - found["p"], (every - true_pairs) - (found["n"] - found["p"])
    if clusters is None:
        clusters = component_labels(records.select(F.col(record_id).alias("record_id")), scored.filter(F.col("score") >= threshold))
    joined = records.select(F.col(record_id).alias("record_id"), F.col(entity).alias("_truth")).join(clusters.select("record_id", "component_id"), "record_id")
    row = F.lit(name).alias("name")
    summary = curve_summary(score_counts(each, digits, lost_p, lost_n, count)).crossJoin(threshold_metrics(each, threshold, lost_p, count)).crossJoin(adjusted_rand(joined, "_truth", "component_id")).crossJoin(candidate_stats(each.filter("score > 0"), size["n"], true_pairs, every, count))
    return summary.select(row, F.lit(size["n"]).alias("n_records"), F.lit(size["e"]).alias("n_entities"), "prevalence", "roc_auc", "pr_auc", "pair_precision", "pair_recall", "pair_f1", "best_pair_f1", "best_pair_threshold", "adjusted_rand", "candidate_pairs", "candidate_fraction", "true_pair_candidate_recall")


def mean_metrics(rows: DataFrame, skip: tuple[str, ...] = ("name", "n_records", "n_entities")) -> DataFrame:
    """The mean of each metric over benchmarks."""
    return rows.agg(*[F.avg(c).alias(c) for c in rows.columns if c not in skip])


# -- tables about pairs and clusters ---------------------------------------------------------------------------------


def agreement(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Add matching_fields and differing_fields; two missing values agree."""
    same = [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in columns]
    return pairs.withColumn("matching_fields", sum((s.cast("int") for s in same), F.lit(0))).withColumn("differing_fields", F.concat_ws(", ", *[F.when(~s, F.lit(c)) for s, c in zip(same, columns)]))


def grouped_quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5,), count: str | None = None) -> DataFrame:
    """The columns `by` and q_0, q_1, ...: exact quantiles (interpolated) of a value in each group, however large it is.

    Values are counted, sorted over the whole table in ranges and summed up within each; a row for each range and group that
    meet tells what the ranges before hold. So a group is spread over many tasks. Nulls are left out, NaN is the largest value,
    and groups without values are missing.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(_weight(count)).alias("_n"))
    order = [*by, "_v"]
    dealt = written(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "quantiles")
    met = dealt.groupBy("_part", *by).agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = met.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], before.alias("_before"), F.sum("_s").over(group).alias("_total"))
    within = Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    stop = F.col("_to") + F.col("_before")
    summed = dealt.withColumn("_to", F.sum("_n").over(within)).join(carried, same).select(*by, "_v", "_total", (stop - F.col("_n")).alias("_from"), stop.alias("_stop"))
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in shares]
    covers = lambda place: (F.col("_from") <= place) & (place < F.col("_stop"))
    ends = [(F.floor(x), F.ceil(x)) for x in at]
    some = summed.filter(sum((covers(x).cast("int") for pair in ends for x in pair), F.lit(0)) > 0)
    found = some.groupBy(*by).agg(F.max("_total").alias("_total"), *[F.max(F.when(covers(x), F.col("_v"))).alias(f"_{k}_{i}") for i, pair in enumerate(ends) for k, x in zip("lh", pair)])
    low, high = (lambda i: F.col(f"_l_{i}")), (lambda i: F.col(f"_h_{i}"))
    between = [F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * (x - F.floor(x))) for i, x in enumerate(at)]
    return found.select(*by, *[x.alias(f"q_{i}") for i, x in enumerate(between)])


def _with_median(stats: DataFrame, rows: DataFrame, by: list[str], value: str, name: str, count: str | None = None) -> DataFrame:
    """Add the median of a value to a row for each group."""
    medians = grouped_quantiles(rows, by, value, count=count).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("q_0").alias(name))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return stats.join(medians, same, "left").drop(*[f"_by_{c}" for c in by])


def score_stats(pairs: DataFrame, by: list[str], count: str | None = None) -> DataFrame:
    """count, mean, median, min, max of the score by columns."""
    pairs = written(pairs.select(*by, "score", *[count] * bool(count)), "scores")  # read for the groups and for their medians
    mean = F.sum(F.col("score") * _weight(count)) / F.sum(F.when(F.col("score").isNotNull(), _weight(count))) if count else F.avg("score")
    stats = pairs.groupBy(*by).agg(F.sum(_weight(count)).alias("count"), mean.alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))
    return _with_median(stats, pairs, by, "score", "median", count).select(*by, "count", "mean", "median", "min", "max")


def confident_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """kind, rank, left_id, right_id, score: for review, the k pairs at each end of each class.

    Kinds: false_positive (highest scores of negatives), weak_positive (lowest of positives), true_positive (highest of
    positives), true_negative (lowest of negatives). Pairs without a score are in none.
    """
    scored = pairs.filter(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    out = None
    for kind, target, order in (("false_positive", 0, F.col("score").desc()), ("weak_positive", 1, F.col("score")), ("true_positive", 1, F.col("score").desc()), ("true_negative", 0, F.col("score"))):
        best = scored.filter(F.col("target") == target).orderBy(order, "left_id", "right_id").limit(k)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(order, "left_id", "right_id")))  # over k rows
        some = ranked.select(F.lit(kind).alias("kind"), "rank", "left_id", "right_id", "score")
        out = some if out is None else out.unionByName(some)
    return out


def merging_edges(pairs: DataFrame, threshold: float, k: int = 20) -> DataFrame:
    """The k strongest false links at a threshold: left_id, right_id, score."""
    return pairs.filter((F.col("target") == 0) & (F.col("score") >= threshold)).orderBy(F.col("score").desc(), "left_id", "right_id").limit(k).select("left_id", "right_id", "score")


def benchmark_diagnostics(pairs: DataFrame, benchmark: str, n_fields: int) -> DataFrame:
    """A row per benchmark: pairs, prevalence, median score of positives and negatives, and shares of pairs that agree in all fields.

    pairs have the benchmark's name, score, target and matching_fields (see agreement).
    """
    of = lambda t, c: F.when(F.col("target") == t, c)
    pairs = written(pairs.select(benchmark, "score", "target", "matching_fields"), "scores")
    exact = (F.col("matching_fields") == n_fields).cast("double")
    stats = pairs.groupBy(benchmark).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("target").alias("prevalence"), F.avg(of(1, exact)).alias("exact_positive_rate"), F.avg(of(0, exact)).alias("exact_negative_rate"))
    for t, name in ((1, "median_positive"), (0, "median_negative")):
        stats = _with_median(stats, pairs.filter(F.col("target") == t), [benchmark], "score", name)
    return stats.select(benchmark, "n_pairs", "prevalence", "median_positive", "median_negative", "exact_positive_rate", "exact_negative_rate")


def differing_patterns(pairs: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent differing_fields with their score statistics."""
    return score_stats(pairs, ["differing_fields"]).orderBy(F.col("count").desc(), "differing_fields").limit(k)


def agreement_contrast(pairs: DataFrame) -> DataFrame:
    """By matching_fields: count, mean and median of negatives and positives, and the gap of medians."""
    of = lambda t, c: F.when(F.col("target") == t, c)
    pairs = written(pairs.select("score", "target", "matching_fields"), "scores")
    kinds = ((0, "negative"), (1, "positive"))
    stats = pairs.groupBy("matching_fields").agg(*[x for t, n in kinds for x in (F.count(of(t, F.lit(1))).alias(f"count_{n}"), F.avg(of(t, F.col("score"))).alias(f"mean_{n}"))])
    for t, n in kinds:
        stats = _with_median(stats, pairs.filter(F.col("target") == t), ["matching_fields"], "score", f"median_{n}")
    named = [f"{x}_{n}" for _, n in kinds for x in ("count", "mean", "median")]
    return stats.select("matching_fields", *named).withColumn("median_gap", F.col("median_positive") - F.col("median_negative"))


def score_histogram(pairs: DataFrame, bins: int = 30, count: str | None = None) -> DataFrame:
    """target, bin, n, density of scores on [0, 1]."""
    binned = pairs.select("target", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"), _weight(count).alias("n")).groupBy("target", "bin").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("target"))
    return binned.withColumn("density", F.col("n") / total * bins)


def cluster_sizes(labels: DataFrame, label: str) -> DataFrame:
    """size and how many clusters have it."""
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def cluster_size_summary(labels: DataFrame, label: str) -> DataFrame:
    """One row that describes cluster sizes: count, mean, std (of a sample), min, quartiles, max."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    q = lambda p: F.expr(f"percentile(size, {p})")
    return sizes.agg(F.count(F.lit(1)).alias("count"), F.avg("size").alias("mean"), F.stddev("size").alias("std"), F.min("size").alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("size").alias("max"))


def source_counts(records: DataFrame, entity: str, source: str, sources: list[str] | None = None) -> DataFrame:
    """A row per entity with the number of its records in each source."""
    pivot = records.groupBy(entity).pivot(source, sources) if sources else records.groupBy(entity).pivot(source)
    return pivot.count().na.fill(0)


def source_count_summary(records: DataFrame, entity: str, source: str) -> DataFrame:
    """source, max_per_entity, entities_over_one."""
    sizes = records.groupBy(entity, source).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(source).agg(F.max("n").alias("max_per_entity"), F.count_if(F.col("n") > 1).alias("entities_over_one"))


def overview(records: DataFrame, columns: list[str], pairs: DataFrame) -> DataFrame:
    """One row: missing_cell_rate, n_pairs, prevalence, exact_positive_pair_rate; pairs have matching_fields and target."""
    missing = records.agg((sum((F.sum(F.col(c).isNull().cast("int")) for c in columns), F.lit(0)) / (F.count(F.lit(1)) * len(columns))).alias("missing_cell_rate"))
    exact = F.when(F.col("target") == 1, (F.col("matching_fields") == len(columns)).cast("double"))
    return missing.crossJoin(pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("target").alias("prevalence"), F.avg(exact).alias("exact_positive_pair_rate")))


def classification_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support for each class, and rows for accuracy, macro avg and weighted avg."""
    table = rows.groupBy(F.col(label).cast("string").alias("l"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    named = table.select(F.explode(F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("chosen")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("chosen")))).alias("x"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    each = named.groupBy("x.class").agg(F.sum("x.support").alias("support"), F.sum("x.chosen").alias("chosen"), (F.sum(F.when(F.col("x.support") > 0, F.col("hit")).otherwise(0))).alias("hit"))
    scored = each.select("class", _ratio(F.col("hit"), F.col("chosen")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"), _ratio(2 * F.col("hit"), F.col("support") + F.col("chosen")).alias("f1"), "support", "hit")
    weigh = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    macro = scored.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    weighted = scored.agg(F.lit("weighted avg").alias("class"), *[weigh(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    accuracy = scored.agg(F.lit("accuracy").alias("class"), *[(F.sum("hit") / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return scored.drop("hit").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def confusion_matrix(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def selector_metrics(rows: DataFrame) -> DataFrame:
    """One row about a candidate selector's answers.

    rows: has_match and candidate_hit (booleans: a true partner exists, and is among the candidates), prediction (0:
    none chosen), correct (the chosen one is a true partner), prompt_tokens, completion_tokens, error.
    """
    n = F.count(F.lit(1))
    tp, chosen, matches = F.count_if("correct"), F.count_if(F.col("prediction") > 0), F.count_if("has_match")
    precision, recall = _ratio(F.col("tp"), F.col("chosen")), _ratio(F.col("tp"), F.col("matches"))
    sums = rows.agg(n.alias("n"), tp.alias("tp"), chosen.alias("chosen"), matches.alias("matches"), F.count_if(F.col("has_match") & F.col("candidate_hit")).alias("_hits"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count("error").alias("errors"))
    return sums.select("n", _ratio(F.col("_hits"), F.col("matches")).alias("candidate_recall"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * F.col("tp"), F.col("chosen") + F.col("matches")).alias("f1"), "prompt_tokens", "completion_tokens", "errors")


def best_rows(history: DataFrame, by: str, metric: str, order: str) -> DataFrame:
    """For each group the row with the largest metric; the first in order on ties."""
    columns = [c for c in history.columns if c != by]
    best = history.groupBy(by).agg(F.max_by(F.struct(*columns), F.struct(F.col(metric), -F.col(order))).alias("r"))
    return best.select(by, "r.*")


def mean_by_step(history: DataFrame, step: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The mean of numeric columns at each step."""
    numbers = [f.name for f in history.schema if f.name not in (step, *skip) and f.dataType.typeName() in ("integer", "long", "double", "float")]
    return history.groupBy(step).agg(*[F.avg(c).alias(c) for c in numbers])


def split_counts(pairs: DataFrame) -> DataFrame:
    """split, pairs, positives, negatives."""
    return pairs.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), F.sum("label").cast("long").alias("positives"), F.sum(1 - F.col("label")).cast("long").alias("negatives"))
