import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text, items, window):
    words = WORD.findall((text or "").translate(LOWER))
    hit, who = set(), set()
    for name, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    who.add("" if name is None else str(name))
    digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
    return len(words), len(hit), len(who), digest, bool(hit) and 20 * len(hit) >= len(words)


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    return d, spark.createDataFrame(items, "item_id long, text string")


def check(spark, docs, items, window, **options):
    d, b = tables(spark, docs, items)
    out = {r["doc_id"]: tuple(r)[1:] for r in D.judge(D.match(d, b, window, **options)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert out == {i: brute(t, items, window) for i, t in enumerate(docs)}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    g = random.Random(seed)
    text = lambda n: " ".join(g.choice("abc") for _ in range(n))
    items = [(g.choice([None, i, 3]), text(g.randrange(0, 12))) for i in range(8)]
    docs = [text(g.randrange(0, 60)) for _ in range(40)] + [None, "", "...", "A b-C! a"]
    check(spark, docs, items, 5)
    check(spark, docs, items, 5, shard_words=7)


def test_words_and_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    items = [(1, "Ünïcode über Ünïcode"), (2, "one two"), (2, "one two"), (10, " ".join(f"w{i}" for i in range(5, 25))), (11, None), (12, "!!")]
    docs = ["say ÜnÏcode", "Ünïcode, über; Ünïcode", "ONE-two three", "one two three " * 40, long, None, ""]
    check(spark, docs, items, 13)


def test_empty_tables_and_clashing_columns(spark):
    check(spark, ["a b"], [], 13)
    d, b = tables(spark, [], [(1, "a")])
    assert D.judge(D.match(d, b)).count() == 0
    d, b = tables(spark, ["x a y"], [(1, "a")])
    d = d.withColumn("spans", F.lit(1)).withColumn("id", F.lit("z")).withColumn("items", F.lit(2)).withColumn("item_id", F.lit(3))
    assert D.judge(D.match(d, b)).first()["n_hit"] == 1


def test_excise(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(300))
    d, b = tables(spark, [f"{filler} {passage}, {filler}", passage, filler, None], [(1, passage)])
    out = {r["doc_id"]: (r["text"], r["removed_words"]) for r in D.excise(d, b).collect()}
    assert out == {0: (f"{filler} , {filler}".replace(" ,", " ,"), 13), 2: (filler, 0), 3: (None, 0)}


def test_shards_of_a_large_benchmark(spark):
    """Many shards, an item longer than a shard, texts of any length, items that share ids and windows."""
    g = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    passage = lambda n: " ".join(g.choice(words) for _ in range(n))
    items = [(g.choice([i, 1, None]), passage(g.randrange(1, 40))) for i in range(15)] + [(99, passage(150))]
    docs = [f"{passage(30)} {g.choice(items)[1]} {passage(g.randrange(100))}" for _ in range(12)] + ["x " * 3000 + items[0][1], None]
    check(spark, docs, items, 13, shard_words=100)


def test_automaton_states_are_arrays():
    g = random.Random(3)
    a = D.SuffixAutomaton([(str(i), [b"w%d" % g.randrange(300) for _ in range(100)]) for i in range(50)], 13)
    n = len(a.link)
    assert n <= 2 * 5000 and all(len(x) == n and x.itemsize == 4 for x in (a.link, a.length, a.word, a.next, a.cut, a.holder))
