import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from kindred.llm import queries, toxicity

from ..oracle import connect, table
from .test_decontaminate import brute
from .test_dedup import components, exact, fingerprint
from .test_tokens import plain  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    found = queries.queries()[name](spark, DATA).toPandas()
    wanted = connect(DATA).execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns) and table(found) == table(wanted)


def test_pipeline_against_brute_force(spark, plain):  # noqa: F811
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter("score >= 0.7").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] not in toxic]
    kept = {x[0] for x in exact(rows) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    first = {min(own) for own in components([fingerprint(t) for _, t in rows]).values()}
    rows = [r for i, r in enumerate(rows) if i in first]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(i, t) for i, t in rows if not brute_fast(t, items)]
    ids = {i: len(x) + 1 for (i, _), x in zip(rows, plain([t for _, t in rows]))}
    out = P.run(spark, DATA)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert toxic and got == ids


def brute_fast(text, items):
    """brute() on the items that share a word pair with the text."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    pairs = set(zip(words, words[1:]))
    some = [(n, t) for n, t in items if (w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())) and (len(w) < 2 or sum(p in pairs for p in zip(w, w[1:])) >= min(12, len(w) - 1))]
    return brute(text, some, 13)[4] if some else False


def test_stages_keep_columns_and_clashing_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("x")).withColumn("component_id", F.lit(1))
    docs = docs.withColumn("_row_key", F.lit(2)).withColumn("_toxic_score", F.lit(3)).withColumn("_match", F.lit(4)).withColumn("_metadata", F.lit(5))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_stages_keep_columns_that_differ_in_case(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({n: F.lit(i) for i, n in enumerate(("_ROW_KEY", "_Toxic_Score", "_MATCH", "_Maybe", "FP", "ID", "_TEXT"))})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_stages_on_odd_rows(spark):
    """Each row is judged on its own text, also where ids are missing or shared; nothing gives nothing."""
    passage = " ".join(spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"].split())
    rows = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, "alpha beta  gamma delta epsilon zeta"), (None, "no id here at all"), (None, "no id  here at all"), (None, None), (3, ""), (4, None), (5, "one own text here now"), (5, "quite another text of that id"), (5, passage), (None, passage + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    out = texts(P.drop_copies(spark, docs, DATA))
    assert out == sorted([(1, rows[0][1]), (2, rows[2][1]), (0, "no id  here at all"), (0, ""), (5, rows[8][1]), (5, rows[9][1]), (5, passage), (0, passage + " more")])
    assert texts(P.drop_contaminated(spark, docs, DATA)) == texts(docs.filter(~F.coalesce(F.col("text").startswith(passage), F.lit(False))))
    near = texts(P.drop_near_copies(spark, docs, DATA))
    assert (0, "no id here at all") in near and len([x for x in near if x[1].strip() == ""]) == 1
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        assert {r["doc_id"] for r in stage(spark, docs, DATA).collect()} >= {None, 1, 5}
