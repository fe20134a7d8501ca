"""Language identification by the nearest of several centroids per language.

Texts become L2-normalised TF-IDF vectors of hashed character n-grams. Document frequencies come from all texts with
a known language (and outside the held-out fold); centroids come from spherical k-means on a bounded sample of each
language, about `sample` texts or fewer, chosen by a hash of id and text: that bound is this classifier's parameter. A
text gets the language of the centroid with the largest cosine, and is marked as rejected if that cosine is below what
the `quantile` lowest of the language's own sample reach.

Definitions for odd input: null texts and texts without a letter get `und` and score 0; a text whose n-grams were
never seen gets the first language in order, score 0, rejected; of equal cosines the first centroid's language wins
(languages in order); with nothing to learn from every language is `und`; rows without an id are learned from, equal
rows once; of more than LANGUAGES languages the most frequent are learned (of equally frequent ones the first in order); rows with equal ids are judged each on its own; texts of any length are read whole, as counts of 2 ** BITS
buckets; an empty table gives an empty result; columns besides those named are not read, so their names may clash.
The model grows with the number of languages (128 KB each), not with the corpus. What is learned from a language goes to a
task of its own, as counted vectors and not as texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.ngrams import buckets, code_points
from kindred.llm.shared import add_arrow, held_out, map_arrow, slices, written

SIZES, BITS = (1, 2, 3), 13
CENTROIDS = 4
#: Texts of each language that centroids are fitted on, at most about so many, and the most languages.
SAMPLE, LANGUAGES = 1000, 500


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: Runs of letters; digits, signs and marks between them tell no language.
_LETTERS = re.compile(r"[^\W\d_]+")


def counts(text: str | None) -> np.ndarray:
    letters = " ".join(_LETTERS.findall(text)) if text else ""
    return np.bincount(buckets(code_points(letters), SIZES, BITS), minlength=1 << BITS)


def vector(text: str | None, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text)).astype(np.float32) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def spherical_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids; the first is the mean's nearest row, each further one the row farthest from those before."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    means = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ means.T).argmax(1)
        for j in range(len(means)):
            if (own == j).any():
                m = x[own == j].mean(0)
                means[j] = m / max(np.sqrt(m @ m), 1e-12)
    return means


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS, quantile: float = 0.01, fold: bool = True, languages: int = LANGUAGES) -> dict:
    """The model: languages in order, idf, centroids, the language of each, the least cosine of each language."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    if fold:
        known = known.filter(~F.coalesce(held_out("id"), F.lit(False)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), Counter()
        for batch in batches:
            n.update(batch.column(1).to_pylist())
            for value in batch.column(0):
                total += counts(value.as_py()) > 0
        at, names = np.flatnonzero(total), sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(at) + names, pa.string()), pa.array([*at, *[-1] * len(names)], pa.int64()), pa.array([*total[at], *[n[x] for x in names]], pa.int64())], names=["lang", "bucket", "n"])

    # a row for each bucket and language and task, added up
    rows = written(map_arrow(known.select("text", "lang"), frequencies, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    df = np.zeros(1 << BITS)
    for r in rows.filter("lang is null").collect():  # a row a bucket at most
        df[r["bucket"]] = r["n"]
    sizes = {r["lang"]: r["n"] for r in rows.filter("lang is not null").orderBy(F.desc("n"), "lang").limit(languages).collect()}
    total = rows.filter("lang is not null").agg(F.sum("n")).first()[0] or 0
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0).astype(np.float32)
    if not sizes:
        return {"languages": [], "idf": idf, "means": np.zeros((0, 1 << BITS), np.float32), "of": np.zeros(0, int), "least": np.zeros(0)}
    shares = known.sparkSession.createDataFrame([(name, int(min(1.0, sample / n) * (1 << 20)) + 1) for name, n in sizes.items()], "lang string, share long")
    some = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id", "text", F.lit(29)), F.lit(1 << 20)) < F.col("share"))
    chosen = some.select("lang", F.col("id").cast("string").alias("id"), "text").dropDuplicates(["lang", "id", "text"])
    given = known.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, rows=100):
                found = [vector(x.as_py(), given.value) for x in part.column(2)]
                at = [np.flatnonzero(v).astype(np.int16) for v in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(at, pa.list_(pa.int16())), pa.array([v[i] for v, i in zip(found, at)], pa.list_(pa.float32()))], names=["lang", "id", "hash", "at", "weights"])

    def learn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, order = [], []
        for batch in batches:
            order += zip(*(batch.column(c).to_pylist() for c in ("id", "hash")))
            for at, weights in zip(batch.column("at"), batch.column("weights")):
                v = np.zeros(1 << BITS, np.float32)
                v[at.values.to_numpy()] = weights.values.to_numpy()
                x.append(v)
        x = np.stack([x[i] for i in sorted(range(len(x)), key=lambda i: (order[i][0] or "", order[i][1]))])
        own = spherical_means(x, k)
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "means": [own.astype(np.float32).tobytes()], "least": [float(np.quantile((x @ own.T).max(1), quantile))]})

    hashed = chosen.select("lang", "id", "text", F.xxhash64("text").alias("hash"))
    learned = map_arrow(hashed, vectors, "lang string, id string, hash long, at array<short>, weights array<float>").groupBy("lang").applyInArrow(learn, "lang string, means binary, least double")
    found = sorted(learned.collect(), key=lambda r: r["lang"])  # a row a language
    means = [np.frombuffer(r["means"], np.float32).reshape(-1, 1 << BITS) for r in found]
    return {"idf": idf, "languages": [r["lang"] for r in found], "means": np.concatenate(means), "of": np.repeat(np.arange(len(found)), list(map(len, means))), "least": np.array([r["least"] for r in found])}


def identify(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, held_out, lang_pred, score (the cosine), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x 32 KB, whatever the corpus

    def work(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for array in arrays:
            names, scores, rejected = [], [], []
            for at in range(0, len(array), 256):
                texts = array.slice(at, 256).to_pylist()
                letters = [has_letter(t) and bool(m["languages"]) for t in texts]
                if not any(letters):
                    cosines = np.zeros((len(texts), 1))
                else:
                    cosines = np.stack([vector(t, m["idf"]) for t in texts]) @ m["means"].T
                for known, row in zip(letters, cosines):
                    best = int(row.argmax())
                    lang = int(m["of"][best]) if known else -1
                    value = min(max(float(row[best]), 0.0), 1.0) if known else 0.0
                    names.append(m["languages"][lang] if known else "und")
                    scores.append(value)
                    rejected.append(not known or value < m["least"][lang] or value == 0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    out = add_arrow(rows, "found", work, "lang_pred string, score double, rejected boolean", F.col("text"))
    return out.select(F.col("id").alias(doc_id), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "found.lang_pred", "found.score", "found.rejected")
