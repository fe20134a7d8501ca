"""URL filters: rules on hosts and paths, and a logistic regression on hashed character n-grams for the rest.

The regression is trained on a small table of labelled URLs (TRAINING, made by a rule from names in general use; or the
caller's). Features are the hashed
n-grams of host and path, each counted once; features, gradients, and scores are all DataFrame expressions. Training
is a fixed number of steps of gradient descent: each is one aggregation over the small table, whose result, the
gradient of at most 2 ** bits buckets, goes to the driver. Scores of the corpus need no join and no shuffle.

A rule names a host and the start of a path, like `example.net/en/`. It fits its host and all subdomains if the URL's
path starts with the rule's; the longest rule wins. Host: after the first `://` up to `/`, `?`, `#` or the end, with
A-Z lower-cased; path: what follows, up to `?`, `#` or the end.

Definitions for odd input: a null URL, or one without `://`, has an empty host and path, fits no rule, and is judged
by the regression's intercept alone; equal rows are judged alike; of rules of equal length that fit, the first given wins;
a score that equals the threshold blocks; URLs of any length are read whole; an empty table gives an empty result, and
an empty training table a score of 0.5; other columns are not read, so their names may clash.
"""

from __future__ import annotations

import math
import string
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: What unwanted and other sites call themselves, and what their paths are like. Chosen from general knowledge.
UNWANTED = tuple(
    """casino poker slots jackpot betting roulette bingo lottery pills viagra pharma steroids replica fake payday loans debt xxx porn cams escort hookup
    warez torrent keygen cracked spam scam phish malware click popup banner adserver ads tracker track pixel affiliate promo coupon deals cheap discount
    bonus winner prize giveaway cash rich profits miracle slim diet hack cheats followers backlinks""".split()
)
WANTED = tuple(
    """library museum university school college journal science research health hospital weather news daily times gazette recipes kitchen garden travel
    guide history archive maps city council parliament law books poetry music theatre film photo gallery nature wildlife forest river mountain village
    community charity football cycling chess astronomy physics biology software docs wiki forum blog tutorial opinion market sports teacher""".split()
)
_ANY_PATHS = ("/", "/{n}", "/en/{b}-{n}", "/fr/{b}", "/de/{n}.html", "/index.html?lang=es", "/a/b/{n}")
UNWANTED_PATHS = ("/click?id={n}", "/track/{n}", "/offer/{b}", "/go/{n}", "/win-{b}-now", "/banner/{n}.gif", "/buy-{b}-online.html", *_ANY_PATHS)
WANTED_PATHS = ("/articles/{b}", "/about", "/{b}/{n}.html", "/2019/04/{b}", "/wiki/{b}", "/docs/{b}/index.html", "/category/{b}", *_ANY_PATHS)
_SYLLABLES = ("ba", "cor", "dil", "en", "fa", "gru", "hol", "is", "jo", "ken", "lum", "mi", "nor", "ost", "pel", "qua", "ri", "sol", "ter", "um", "vel", "wy", "ver", "zan")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: 1 for URLs to block.

    Names come alone and in pairs, with the usual tops and paths of their kind; as most sites' names mean nothing,
    as many more are made of syllables, and labelled 0.
    """
    rows = []
    hosts = ("{a}.com", "www.{a}-{b}.com", "{a}{b}.net", "best-{a}.info", "{b}.{a}.org", "www.{b}{a}.example.com")
    nonsense = tuple("".join(_SYLLABLES[zlib.crc32(f"{i} {k}".encode()) % len(_SYLLABLES)] for k in range(2 + i % 3)) for i in range(len(WANTED)))
    for names, paths, label in ((UNWANTED, UNWANTED_PATHS, 1), (WANTED, WANTED_PATHS, 0), (nonsense, WANTED_PATHS, 0)):
        for i, a in enumerate(names):
            for j, host in enumerate(hosts):
                b = names[(i * 7 + j * 11 + 5) % len(names)]
                path = paths[(i + j * 3) % len(paths)].format(b=b, n=100 + 37 * i + 11 * j)
                rows.append((f"{'https' if j % 2 else 'http'}://{host.format(a=a, b=b)}{path}", label))
    return rows


TRAINING = labelled_urls()

N_GRAMS, BITS = (3, 4, 5), 12


def _split(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    value = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(value, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(value, pattern, 2)


def _buckets(host: Column, path: Column, sizes: tuple[int, ...], bits: int) -> Column:
    """The distinct buckets of the n-grams of host and path, each with its marks of begin and end."""

    def grams(text: Column, kind: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        size = F.length(marked)

        def cut(n: int) -> Column:
            places = F.when(size >= n, F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.concat(F.lit(kind), F.substring(marked, i, F.lit(n))))

        parts = [cut(n) for n in sizes]
        return F.when(size > 2, F.concat(*parts)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.transform(F.concat(grams(host, "h"), grams(path, "p")), lambda g: F.pmod(F.xxhash64(g), F.lit(1 << bits)).cast("int")))


def _margin(features: Column, weights: Column, bias: Column) -> Column:
    """Mean-free sum: weights of the features by the root of their number, and the intercept."""
    total = F.aggregate(features, F.lit(0.0), lambda a, b: a + F.element_at(weights, b + 1))
    return total / F.sqrt(F.greatest(F.size(features), F.lit(1))) + bias


def _array(values: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f"{v:.6g}" for v in values) + "]"), "array<double>")


def train(spark: SparkSession, rows: list[tuple[str, int]] = TRAINING, sizes: tuple[int, ...] = N_GRAMS, bits: int = BITS, steps: int = 12, rate: float = 4.0, penalty: float = 1e-4) -> tuple[list[float], float]:
    """Weights and intercept; an empty table gives zeros."""
    weights, bias = [0.0] * (1 << bits), 0.0
    if not rows:
        return weights, bias
    table = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows)], "row int, url string, label int")
    host, path = _split(F.col("url"))
    found = table.select("row", "label", _buckets(host, path, sizes, bits).alias("features"))
    # a row for each URL and feature, and its share in the margin; bucket -1 stands for the intercept
    parts = found.select("row", "label", F.size("features").alias("n"), F.explode(F.concat(F.array(F.lit(-1)), F.col("features"))).alias("bucket"))
    share = F.when(F.col("bucket") < 0, F.lit(1.0)).otherwise(1 / F.sqrt(F.greatest(F.col("n"), F.lit(1))))
    parts = parts.select("row", "label", "bucket", share.alias("share")).coalesce(1).cache()
    speed = [0.0] * (1 + (1 << bits))
    for _ in range(steps):
        margin = F.sum(F.col("share") * F.element_at(_array([bias, *weights]), F.col("bucket") + 2))
        residual = parts.groupBy("row", "label").agg(margin.alias("m")).select("row", (1 / (1 + F.exp(-F.col("m"))) - F.col("label")).alias("e"))
        for bucket, e in parts.join(residual, "row").groupBy("bucket").agg(F.sum(F.col("e") * F.col("share"))).collect():  # 2 ** bits rows at most
            gradient = e / len(rows) if bucket < 0 else e / math.sqrt(len(rows)) + penalty * weights[bucket]
            speed[bucket + 1] = 0.8 * speed[bucket + 1] - rate * gradient
            if bucket < 0:
                bias += speed[0]
            else:
                weights[bucket] += speed[bucket + 1]
    parts.unpersist()
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url", sizes: tuple[int, ...] = N_GRAMS, threshold: float = 0.5) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, score (that the regression would block it)."""
    weights, bias = model
    bits = len(weights).bit_length() - 1
    host, path = _split(F.col(url))
    rows = pages.select(F.col(page_id), host.alias("host"), path.alias("path"))
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        at = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith("/" + rest)
        fits.append((at, rule, verdict))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, name, verdict in reversed(fits):
        rule = F.when(at, F.lit(name)).otherwise(rule)
        by_rule = F.when(at, F.lit(verdict)).otherwise(by_rule)
    score = 1 / (1 + F.exp(-_margin(_buckets(F.col("host"), F.col("path"), sizes, bits), _array(weights), F.lit(bias))))
    judged = rows.withColumn("rule", rule).withColumn("_by_rule", by_rule).withColumn("score", score)
    return judged.withColumn("verdict", F.coalesce("_by_rule", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))).select(page_id, "host", "path", "rule", "verdict", "score")


def filter_urls(pages: DataFrame, rows: list[tuple[str, int]] = TRAINING, rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Train on the labelled URLs and judge every page."""
    return judge(pages, train(pages.sparkSession, rows), rules, page_id, url)
