import random

from pyspark.sql import functions as F

from kindred.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def convert(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumn("hash", F.lit(1)).withColumn("place", F.lit(2))
    return {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df).collect()}


def test_reply_order_and_texts(spark):
    data = [
        (1, 0, "a", "Where shall\nwe MEET?"),
        (1, 1, "b", "Is it raining?"),
        (1, 2, "c", "> where shall we   meet?\nAt noon."),
        (1, 3, "d", "> Is it raining?\n\nYes."),
        (1, 4, "e", ">> Where shall we meet?\n> At noon.\nFine.\n> never said"),
        (2, 0, "a", "> At noon.\nother conversation"),
        (3, 0, "a", None),
        (3, 1, "b", ""),
        (None, 0, "a", "> x"),
    ]
    out = convert(spark, data)
    assert [out[1, t]["parent_turn"] for t in range(5)] == [None, None, 0, 1, 2]
    assert [out[1, t]["thread_turn"] for t in range(5)] == [0, 1, 0, 1, 0]
    assert [out[1, t]["depth"] for t in range(5)] == [0, 0, 1, 1, 2]
    assert [out[1, t]["place"] for t in range(5)] == [0, 3, 1, 4, 2]
    assert [out[1, t]["text"] for t in (2, 3, 4)] == ["At noon.", "Yes.", "Fine."]
    assert out[2, 0]["parent_turn"] is None and out[3, 0]["text"] == "" and out[None, 0]["parent_turn"] is None


def brute(messages):
    """Replies by comparing every quoted passage with every earlier passage."""

    def passages(text):
        out = []
        for line in text.split("\n"):
            level = 0
            while line.lstrip(" ").startswith(">"):
                line = line.lstrip(" ")[1:]
                level += 1
            out.append((level, line)) if not out or out[-1][0] != level else out.__setitem__(-1, (level, out[-1][1] + " " + line))
        return [(n, " ".join(t.split()).lower()) for n, t in out]

    parent = {}
    for turn, text in messages:
        found = [s for s, other in messages if s < turn for n, p in passages(text) if n and p and (n - 1, p) in passages(other)]
        if found:
            parent[turn] = max(found)
    return parent


def test_against_brute_force(spark):
    g = random.Random(4)
    data, want = [], {}
    for conv in range(15):
        messages = []
        for turn in range(g.randrange(1, 14)):
            lines = []
            for _ in range(g.randrange(3)):
                if messages and g.random() < 0.7:
                    lines += ["> " + x for x in g.choice(messages)[1].split("\n")]
                lines.append(g.choice(["yes", "no", "so be it", "when", "Why?"]) + str(g.randrange(9)))
            messages.append((turn, "\n".join(lines)))
        data += [(conv, t, "r", x) for t, x in messages]
        want |= {(conv, t): p for t, p in brute(messages).items()}
    out = convert(spark, data)
    assert {k: r["parent_turn"] for k, r in out.items() if r["parent_turn"] is not None} == want
    for conv in range(15):
        own = sorted((r for (c, _), r in out.items() if c == conv), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: (r["thread_turn"], r["turn"]))


def test_repeats_long_chains_and_nothing(spark):
    chain = [(1, 0, "a", "m0")] + [(1, i, "a", f"> m{i - 1}\nm{i}") for i in range(1, 40)]
    out = convert(spark, chain + chain[:1])
    assert out[1, 39]["thread_turn"] == 0 and out[1, 39]["depth"] == 39
    assert quotes.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_partial_and_interleaved_quotes(spark):
    data = [
        (1, 0, "a", "First point\nin two lines.\n\nSecond point.\n\nThird point."),
        (1, 1, "b", "Something else."),
        (1, 2, "c", "> first point\n> in two   lines.\n\nyes"),
        (1, 3, "d", "> Second point.\nno\n> Third point.\nwell"),
        (1, 4, "e", "> First point\n> in two lines.\n>\n> Third point.\n\nboth"),
        (1, 5, "f", "> in two lines.\nshort"),
        (1, 6, "g", ">> Second point.\n> no\nnested"),
        (1, 7, "h", "> first\nhalf a line"),
        (2, 0, "a", "ok\nthanks"),
        (2, 1, "b", "ok\n\nmore"),
        (2, 2, "c", "> ok\n> thanks\nfound whole, so not by its lines"),
        (2, 3, "d", "> ok\n\nthe paragraph"),
        (2, 4, "e", "> ok\n> never said\nthe line"),
        (3, 0, "a", "> me first"),
        (3, 1, "b", "me first"),
    ]
    out = convert(spark, data)
    assert [out[1, t]["parent_turn"] for t in range(8)] == [None, None, 0, 0, 0, 0, 3, None]
    assert [out[2, t]["parent_turn"] for t in range(5)] == [None, None, 0, 1, 1]
    assert out[3, 0]["parent_turn"] is None and out[1, 6]["thread_turn"] == 0 and out[1, 4]["text"] == "both"


def test_parts_against_brute_force(spark):
    """Quotes of random slices of earlier messages, with blank lines in them."""

    def runs(text):
        out = []
        for line in text.split("\n"):
            level = 0
            while line.lstrip(" ").startswith(">"):
                line, level = line.lstrip(" ")[1:], level + 1
            if not out or out[-1][0] != level:
                out.append((level, []))
            out[-1][1].append(" ".join(line.split()).lower())
        return out

    def paragraphs(lines):
        return [p.split("\1") for p in "\1".join(lines).replace("\1\1", "\2").split("\2") if p.strip("\1")] if any(lines) else []

    def parts(level_lines):
        level, lines = level_lines
        paras = [[x for x in p if x] for p in paragraphs(lines)]
        return level, " ".join(x for x in lines if x), [(" ".join(p), p) for p in paras]

    def parent_of(messages, turn, text):
        cut = {s: [parts(r) for r in runs(x)] for s, x in messages if s < turn}
        latest = lambda hit: max((s for s, own in cut.items() if any(hit(*r) for r in own)), default=None)
        found = []
        for level, whole, paras in map(parts, runs(text)):
            if not level or not whole:
                continue
            p = latest(lambda n, w, _: n == level - 1 and w == whole)
            if p is None:
                for joined, lines in paras:
                    q = latest(lambda n, _, ps: n == level - 1 and any(joined == j for j, _ in ps))
                    found += [q] if q is not None else [latest(lambda n, _, ps: n == level - 1 and any(x in ls for _, ls in ps)) for x in lines]
            found.append(p)
        return max((x for x in found if x is not None), default=None)

    g = random.Random(9)
    data, want = [], {}
    for conv in range(15):
        messages = []
        for turn in range(g.randrange(2, 12)):
            lines = []
            for _ in range(g.randrange(1, 4)):
                if messages and g.random() < 0.7:
                    old = g.choice(messages)[1].split("\n")
                    a = g.randrange(len(old))
                    lines += ["> " + x for x in old[a : a + g.randrange(1, 5)]]
                lines += [g.choice(["yes", "no", "", "when", "Why?"]) + g.choice(["", "1", "2", "3", "4"]) for _ in range(g.randrange(1, 4))]
                lines += [""] * g.randrange(3)
            messages.append((turn, "\n".join(lines)))
        data += [(conv, t, "r", x) for t, x in messages]
        want |= {(conv, t): parent_of(messages, t, x) for t, x in messages}
    out = convert(spark, data)
    assert {k: r["parent_turn"] for k, r in out.items()} == want
    assert sum(p is not None for p in want.values()) > 30


def test_one_passage_quoted_by_every_turn(spark, monkeypatch):
    """Turns that all quote and repeat one passage: rows stay linear, and slots change nothing."""
    monkeypatch.setattr(quotes, "SLOT", 16)
    data = [(1, 3 * t, "a", "> ok\nok" if t % 4 else "ok") for t in range(400)] + [(1, 601, "b", "> ok")] * 5
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    replies = {r["turn"]: r["parent"] for r in quotes.link(df).collect()}
    turns = sorted({t for _, t, _, x in data if x != "> ok"})
    assert replies == {t: max(s for s in turns if s < t) for _, t, _, x in data if x.startswith(">")}
    assert len(convert(spark, [(c, t, r, x) for c, t, r, x in data])) == 401


def test_long_text_and_turns_that_are_strings(spark):
    long = "\n".join(f"line {i}" for i in range(20_000))
    out = convert(spark, [(1, 0, "a", long), (1, 1, "b", "> " + long.replace("\n", "\n> ") + "\nso")])
    assert out[1, 1]["parent_turn"] == 0 and out[1, 1]["text"] == "so"
    named = spark.createDataFrame([("c", "t1", "a", "hello"), ("c", "t2", "b", "> hello\nyes")], "conv_id string, turn string, role string, text string")
    assert [(r["turn"], r["parent"]) for r in quotes.link(named).collect()] == [("t2", "t1")]
