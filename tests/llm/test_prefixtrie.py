"""The prefix tree against one made of dictionaries."""

import hashlib
import random
import zlib

import pytest

from kindred.llm import prefixtrie


def brute(rows, rebuild):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    if rebuild:
        given = {}
        for c, x in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            donor = c - (c % 100 if c >= 0 else -(-c % 100))
            given[c] = own.get(donor, [])[:h] + x[h:]
        own = given
    members = {}
    for c, x in own.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    out = []
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(own[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below(p) if q)
        leaves = sum(not children[q] for q in below(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def check(spark, rows, rebuild, schema="conv_id long, turn long, role string, text string", parts=5):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    turns = prefixtrie.ordered(df)
    found = prefixtrie.with_ends(*prefixtrie.tree(*(prefixtrie.rebuilt if rebuild else prefixtrie.as_given)(turns))).select(COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, rebuild)


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_brute_force(spark, rebuild):
    rng = random.Random(rebuild)
    rows = []
    for c in rng.sample(range(-30, 420), 160):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]) if t % 3 == 0 else "user", rng.choice(["a", "bb", "é😀", None])))
    rng.shuffle(rows)
    check(spark, rows, rebuild)


def test_deep_chains_and_a_hot_conversation(spark):
    # conversation 40 - k shares k turns with the next one: a tree of chains as high as it is deep; conversation 50 is long
    rows = [(40 - k, t, "user", "x" if t < k else f"own{k}") for k in range(40) for t in range(k + 1)]
    rows += [(50, t, "user", "x" * (t % 4)) for t in range(700)]
    rows += [(60 + c, t, "user", "same") for c in range(200) for t in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        check(spark, rows, False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pos string, node int"
    check(spark, [], True, schema)
    rows = [(None, 1, "a", "b", "x", 1), (100, 1, "", "", "x", 1), (100, None, None, None, None, None), (100, 1, "", "", "x", 1), (7, 3, "user", "w" * 100_000, "", 0), (103, 1, "r", "t", "", 0), (104, 1, "r", "t", "", 0)]
    check(spark, rows, True, schema)
    check(spark, rows, False, schema)
    check(spark, [(205, t, "r", "t", "", 0) for t in range(2)], True, schema)
