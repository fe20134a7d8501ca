import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kindred.llm import exactdedup, simhash


def exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is not None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        out.append((i, keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\u00a0b"), (5, None), (6, ""), (7, " \n\t"), (8, "x" * 100_000), (9, "x" * 50_000 + "\r\n" + "x" * 50_000), (10, "A b"), (11, "solo"), (12, "ab "), (12, "ab "), (None, "solo"), (13, "é"), (14, "e\u0301")]


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_groups(spark, rows, bits):
    """With digests of 8 bits many texts collide, and must still be told apart."""
    data = ROWS + [(100 + i, f"t{i % 150}") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumn("digest", F.lit(1)).withColumn("rows", F.lit(2)).withColumn("id", F.lit(3))
    assert rows(exactdedup.dedup(df, bits=bits)) == exact(data)


def test_exact_of_one_large_group(spark, rows):
    data = [(i, "same  text" if i % 2 else "sametext") for i in range(3000)] + [(5000 + i, f"own {i}") for i in range(500)]
    assert rows(exactdedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6))) == exact(data)


def test_exact_of_nothing(spark):
    assert exactdedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_merges_batches(spark):
    index = exactdedup.MergeIndex(spark)
    index.flush(spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string"))
    index.compact()
    index.flush(spark.createDataFrame([(2, "a"), (7, " c ")], "doc_id long, text string"))
    out = {r["keep_id"]: r["rows"] for r in index.compact().collect()}
    assert out == {2: 2, 6: 1, 7: 1}
    assert [r["keep_id"] for r in index.probe([hashlib.sha256(b"c").digest()]).collect()] == [7]


def test_index_goes_through_levels(spark):
    """Runs become fewer by the fan-out at each level; each level's runs hold a digest once."""
    data = [(i, f"t{i % 70}") for i in range(400)]
    index = exactdedup.MergeIndex(spark, fanout=3)
    for at in (0, 200):
        index.flush(spark.createDataFrame(data[at : at + 200], "doc_id long, text string").repartition(7))
    assert index.runs == 14 and {r["keep_id"] for r in index.probe([hashlib.sha256(b"t3").digest()]).collect()} == set(range(3, 400, 70))
    merged = index.compact()
    assert index.history == [14, 5, 2, 1]
    assert {(r["keep_id"], r["rows"]) for r in merged.collect()} == {(i, len(range(i, 400, 70))) for i in range(70)}
    assert sorted(r["keep_id"] for r in index.probe([hashlib.sha256(b"t3").digest()]).collect()) == [3]


@pytest.mark.parametrize("fanout", [2, 16])
def test_exact_with_equal_rows_of_a_heavy_key(spark, rows, fanout):
    """Most rows are equal in all columns; a heavy key's rows stay where they are."""
    data = [(7, "same text")] * 2500 + [(None, None)] * 1500 + [(8, "same  text")] + [(i, f"own {i}") for i in range(300)]
    assert rows(exactdedup.dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6), fanout=fanout)) == exact(data)


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", "One", "one two three four", "Ab é\u00a0x ß ab ab ab ab ab\tab\nab", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == fingerprint(text)


def test_code_covers_and_visits():
    g = np.random.default_rng(0)
    for width in (21, 22):
        x = g.integers(0, 1 << width, 300)
        home = simhash.homes(x, 15)
        assert (np.bitwise_count(x ^ home) <= 1).all() and (simhash._syndromes(home, 15) == 0).all()
        row, anchor = simhash.anchors_within(x, width, 15, 2)
        assert (np.bitwise_count(x[row] ^ anchor) <= 2).all() and (simhash._syndromes(anchor, 15) == 0).all()
        visited = {}
        for r, a in zip(row.tolist(), anchor.tolist()):
            assert a not in visited.setdefault(r, set())
            visited[r].add(a)
        for i in range(300):  # all codewords within 2, found by trying every flip
            near = {int(x[i]), *(int(x[i]) ^ 1 << a for a in range(width)), *(int(x[i]) ^ 1 << a ^ 1 << b for a in range(width) for b in range(a))}
            assert visited[i] == {v for v in near if simhash._syndromes(np.array([v]), 15)[0] == 0}


def test_fine_code_visits_all_within_three():
    g = np.random.default_rng(1)
    x = g.integers(0, 1 << 32, 20)
    x[0] = 0  # a codeword
    row, anchor = simhash.anchors_within(x, 32, 31, 3)
    visited = list(zip(row.tolist(), anchor.tolist()))
    flips = [sum(1 << b for b in bits) for n in range(4) for bits in itertools.combinations(range(32), n)]
    near = [(i, int(v) ^ f) for i, v in enumerate(x) for f in flips]
    zero = simhash._syndromes(np.array([v for _, v in near]), 31) == 0
    assert len(set(visited)) == len(visited) and set(visited) == {v for v, z in zip(near, zero) if z}


def components(prints, most=4):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {root(i): [j for j in range(len(prints)) if root(j) == root(i)] for i in range(len(prints))}


@pytest.mark.parametrize(("chunk", "held", "layout"), [(2048, 500_000, simhash.COARSE), (5, 500_000, simhash.COARSE), (5, 40, simhash.COARSE), (2048, 500_000, simhash.FINE_LAYOUT), (3, 40, simhash.FINE_LAYOUT)])
def test_links_connect_what_is_near(spark, chunk, held, layout, monkeypatch):
    g = random.Random(chunk)
    prints = [g.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        x = g.choice(prints)
        for _ in range(g.choice([1, 2, 3, 4, 4, 5, 6])):
            x ^= 1 << g.randrange(64)
        prints.append(x)
    prints = sorted(set(prints))
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "HELD", held)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    if chunk < 2048:  # many that differ in one block only
        extra = {prints[0] ^ (i << 43) for i in range(300)}
        prints = sorted({*prints, *extra})
        signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    out = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3), layout=layout)
    found = [(r[0] % 2**64, r[1] % 2**64) for r in out.collect()]
    at = {p: i for i, p in enumerate(prints)}
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in found:
        up[root(at[a])] = root(at[b])
    assert len({root(i) for i in range(len(prints))}) == len(components(prints))
    for own in components(prints).values():
        assert len({root(i) for i in own}) == 1


@pytest.mark.parametrize("most", [0, 5, 8])
def test_links_of_other_thresholds(spark, most):
    g = random.Random(most)
    prints = [g.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        x = g.choice(prints)
        for b in g.sample(range(64), g.randrange(1, 11)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    out = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3), most)
    at = {p: i for i, p in enumerate(prints)}
    found = [(at[r[0] % 2**64], at[r[1] % 2**64]) for r in out.collect()]
    own = {i: root for root, group in components(prints, most).items() for i in group}
    up = list(range(len(prints)))
    for _ in up:
        for a, b in found:
            up[a] = up[b] = min(up[a], up[b])
    assert all(own[a] == own[b] for a, b in found) and len(set(up)) == len(set(own.values()))
    with pytest.raises(ValueError, match="8 bits"):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 9)


def test_near_duplicates_of_a_table(spark):
    g = random.Random(3)
    base = [" ".join(g.choice("abcdefgh") + str(g.randrange(99)) for _ in range(g.choice([3, 40, 300]))) for _ in range(20)]
    texts = base + [b.replace("a1", "zz", 1) for b in base] + base[:5] * 4 + [None, "", "  ", "AA b c"]
    df = spark.createDataFrame([(10 + i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp int").repartition(4)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = [fingerprint(t) for t in texts]
    want = {}
    for own in components(prints).values():
        for i in own:
            want[10 + i] = (f"{prints[i]:016x}", 10 + min(own))
    assert out == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
