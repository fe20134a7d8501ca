import random
import zlib

import numpy as np
import pytest

from kindred.llm import packing, tokenbits, tokencount, tokens

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXTS = ["Hello, world! It's 2024.", None, "", "  \n", "don't I'LL", "Ünïcode ÇA 日本語 İstanbul Σς ŉ ſ", "<|endoftext|> tail", "a\x1cb c\xa0d\x85e", "x" * 3000, "same text", "same text", "é e\u0301", "word " * 5000]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(plain):
    g = random.Random(2)
    alphabet = "aAbéÉÈßøØÿŸİıſŉ'’s.,!?0159<|>_ \t\n\x1c\x85\xa0\u2009\u200b\u0301日Σς½²ﬁ-×÷"
    texts = TEXTS + ["".join(g.choice(alphabet) for _ in range(g.randrange(60))) for _ in range(3000)]
    e = tokens.WordEncoder(tokens.default_path())
    assert [x.tolist() for x in e.encode(texts)] == plain(texts)
    assert [x.tolist() for x in e.encode(texts[:50], 1)] == [x + [1] for x in plain(texts[:50])]


def test_other_tokenizers_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokens.default_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    wanted = [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]
    assert tokens.by_words(tokens.default_path()) and not tokens.by_words(path)
    assert [x.tolist() for x in tokens.encoder(path).encode(TEXTS)] == wanted
    assert isinstance(tokens.encoder(tokens.default_path()), tokens.WordEncoder)
    df = docs(spark, TEXTS)
    crcs = {i * 7: crc([*x, 50256]) for i, x in enumerate(wanted)}
    read = tokenbits.round_trip(df, tokenizer=path, end=50256).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in read} == {i * 7: (len(x) + 1, crcs[i * 7]) for i, x in enumerate(wanted)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_documents(df, tokenizer=path, end=50256).collect()} == {i * 7: len(x) + 1 for i, x in enumerate(wanted)}
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(df, tokenizer=path, end=50256).collect()} == {i * 7: len(x) + 1 for i, x in enumerate(wanted)}


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i * 7, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(parts)


def test_packing_covers_every_id_once(spark, plain):
    ids = [x + [1] for x in plain(TEXTS)]
    rows = packing.pack(docs(spark, TEXTS), block=3000).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"] // 7, []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, own in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(own[at : at + r["length"]])
            at += r["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["sequence_tokens"] <= 2048 and at & (at - 1) == 0  # no padding
    assert packing.pack(docs(spark, TEXTS).filter("doc_id < 0")).count() == 0


def test_tiers_fill_windows():
    g = random.Random(1)
    p = packing.TierPacker((64, 32, 16))
    sizes = [g.choice([1, 3, 9, 20, 40, 70, 200]) for _ in range(400)]
    for i, n in enumerate(sizes):
        p.add(i, n)
    p.pack()
    p.finish()
    assert sum(x for x, _ in p.windows) == sum(sizes) == sum(piece[2] for _, w in p.windows for piece in w)
    assert sum(x < 16 for x, _ in p.windows) <= 4
    groups = packing.step_groups([x for x, _ in p.windows], 512)
    totals = [sum(x for (x, _), k in zip(p.windows, groups) if k == j) for j in set(groups)]
    assert max(totals) - min(totals) <= 64


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    words = tokenbits.pack_bits(ids, bits)
    assert len(words) == 16 * bits and (tokenbits.unpack_bits(words, bits)[:1000] == ids).all()


def test_bits_file_random_access(tmp_path):
    g = np.random.default_rng(0)
    own = [g.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 130, 5000, 64, 0)]
    w = tokenbits.PackedWriter(open(tmp_path / "f", "wb"), 16, 128)
    for i, x in enumerate(own):
        w.add(i * 10, x)
    w.close()
    f = tokenbits.PackedFile(str(tmp_path / "f"))
    assert all((f.document(i) == x).all() for i, x in enumerate(own)) and f.names.tolist() == [0, 10, 20, 30, 40, 50]
    flat = np.concatenate(own)
    assert (f.ids(100, 333) == flat[100:333]).all()


def test_token_bits_of_a_table(spark, plain):
    ids = [x + [1] for x in plain(TEXTS)]
    starts = np.cumsum([0] + [len(x) for x in ids])
    out = {r["doc_id"]: tuple(r)[1:] for r in tokenbits.round_trip(docs(spark, TEXTS), block=256).collect()}
    assert out == {i * 7: (starts[i], len(x), crc(x)) for i, x in enumerate(ids)}
    odd = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in tokenbits.round_trip(odd).orderBy("start").collect()] == [(None, 0), (5, 2), (5, 4)]
    assert tokenbits.round_trip(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_scan_of_flat_files(spark, tmp_path, block):
    g = random.Random(block)
    paths, wanted = [], set()
    for k, last in enumerate([True, False, True]):
        ids = [g.choice([9, 1, 2, 3]) for _ in range(40)] + ([9] if last else [1, 2])
        ids = ids if k < 2 else [9, 9]
        path = str(tmp_path / f"{k}")
        np.array(ids, "<u2").tofile(path)
        paths.append(path)
        start = n = 0
        for i, x in enumerate(ids):
            if x == 9 or i == len(ids) - 1:
                wanted.add((path, n, start, i + 1 - start, x == 9))
                start, n = i + 1, n + 1
    open(tmp_path / "empty", "w").close()
    out = tokencount.scan(spark, [*paths, str(tmp_path / "empty")], end=9, block=block)
    assert {tuple(r) for r in out.select("path", "ordinal", "start", "n_tokens", "terminated").collect()} == wanted


def test_counts_of_a_table(spark, plain):
    out = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_documents(docs(spark, TEXTS), block=64).collect()}
    assert out == {i * 7: len(x) + 1 for i, x in enumerate(plain(TEXTS))}
    assert tokencount.count_documents(docs(spark, TEXTS).limit(0)).count() == 0


def test_bits_of_one_heavy_id(spark, plain):
    """Rows of one id, of no id, and equal rows are cut over files; ids ascend and each row is there once."""
    data = [(3, f"text {i % 40}") for i in range(900)] + [(None, "none")] * 500 + [(i, "own") for i in range(10, 20)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = tokenbits.write(df, tokenbits.scratch(spark, "heavy"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(p.documents for p in parts) < 0.6 * len(data)
    out = tokenbits.read(spark, parts, read_ids=50).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None] * 500 + [3] * 900 + list(range(10, 20))
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    want = sorted(crc(x + [1]) for x in plain([t for _, t in data]))
    assert sorted(r["ids_crc32"] for r in out) == want


def test_bits_want_integer_ids(spark):
    with pytest.raises(ValueError, match="integers"):
        tokenbits.round_trip(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(Exception, match="stands for null"):
        tokenbits.round_trip(spark.createDataFrame([(-(1 << 63), "b")], "doc_id long, text string"))


def test_counts_with_options(spark, plain):
    """A separator and a width of one's own reach the scan; what can't be told apart is an error."""
    texts = ["one two", "three", None]
    one_file = docs(spark, texts, 1)
    for options in ({"end": 1}, {"width": 4}, {"end": 1, "width": 4, "block": 2}, {"end": 70_000, "width": 4}):
        out = tokencount.count_documents(one_file, **options).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in out} == {i * 7: len(x) + 1 for i, x in enumerate(plain(texts))}
        assert len({r["path"] for r in out}) == 1
    own = plain(["three"])[0][0]
    with pytest.raises(Exception, match="separator"):
        tokencount.count_documents(one_file, end=own)
    with pytest.raises(ValueError, match="fit"):
        tokencount.count_documents(one_file, end=70_000)


def test_counts_of_equal_rows_and_ids(spark, plain):
    data = [(1, "a b")] * 30 + [(None, "c")] * 20 + [(2, "d " * 9000)]
    out = tokencount.count_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(3), block=100).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == sorted((i or 0, len(x) + 1) for (i, _), x in zip(data, plain([t for _, t in data])))


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    from kindred.llm.shared import slices

    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["x" * 5, None, "", "y" * 100, "z", "ü" * 3, "w"]}).slice(1)
    cut = [[r["i"] for r in s.to_pylist()] for s in slices(batch, 1, rows=3, size=8)]
    assert cut == [[1, 2], [3], [4, 5, 6]] and list(slices(batch.slice(0, 0), 1)) == []


def test_forgetting_changes_nothing(plain):
    e = tokens.encoder(tokens.default_path())
    first = [x.tolist() for x in e.encode(TEXTS)]
    tokens.forget()
    assert not e.words.number and [x.tolist() for x in e.encode(TEXTS)] == first == plain(TEXTS)
