"""Comparisons of two values: similarities and agreement levels."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.text import ColumnLike, _col


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(a: ColumnLike) -> Column:
    """A vector divided by its length; a zero vector stays."""
    length = F.sqrt(dot(a, a))
    return F.transform(_col(a), lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(c: ColumnLike) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(c).cast("string")), "[^a-z0-9]+"), lambda t: t != ""))


def jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union > 0, F.size(F.array_intersect(_col(a), _col(b))) / union).otherwise(F.lit(0.0))


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four common first characters, if over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    others = [c for c, t in zip(b, taken) if t]
    turns = sum(x != y for x, y in zip(matched, others)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turns) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winkler_texts(pairs: list[tuple[str, str]]) -> list[float]:
    """jaro_winkler_text of many pairs, compared place by place for all pairs of about one length at once."""
    out = np.zeros(len(pairs))
    longest = np.array([max(len(a), len(b)) for a, b in pairs], int)
    for least, most in ((0, 8), (8, 16), (16, 32), (32, 64)):
        own = np.flatnonzero((longest > least) & (longest <= most))
        if len(own):
            out[own] = _jaro_winkler([pairs[i][0] for i in own], [pairs[i][1] for i in own], most)
    for i in np.flatnonzero(longest > 64):
        out[i] = jaro_winkler_text(*pairs[i])
    return out.tolist()


def _jaro_winkler(left: list[str], right: list[str], width: int) -> np.ndarray:
    a, b = (np.array(x, f"<U{width}").view(np.uint32).reshape(-1, width) for x in (left, right))
    m, n = (np.array(list(map(len, x))) for x in (left, right))
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    used, taken = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    far = int(reach.max())
    for i in range(width):
        open_ = i < m
        for j in range(max(0, i - far), min(width, i + far + 1)):
            hit = open_ & (abs(i - j) <= reach) & (j < n) & ~taken[:, j] & (a[:, i] == b[:, j])
            used[:, i] |= hit
            taken[:, j] |= hit
            open_ &= ~hit
    common = used.sum(1)
    first, second = (np.take_along_axis(x, np.argsort(~marked, axis=1, kind="stable"), 1) for x, marked in ((a, used), (b, taken)))
    turns = ((first != second) & (np.arange(width) < common[:, None])).sum(1) // 2
    safe = np.maximum(common, 1)
    jaro = np.where(common > 0, (common / np.maximum(m, 1) + common / np.maximum(n, 1) + (common - turns) / safe) / 3, 0.0)
    prefix = np.cumprod((a[:, :4] == b[:, :4]) & (np.arange(min(4, width)) < np.minimum(m, n)[:, None]), axis=1).sum(1)
    return np.where((m == n) & (a == b).all(1) & (m > 0), 1.0, np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro))


def jaro_winkler_to(a: str, texts: list[str]) -> Callable[[str], np.ndarray]:
    """Function of one text: its jaro_winkler_text with each of `texts`, of 64 characters at most, all of which begin with a.

    Sets of places are bits of a number. Common first characters always match each other in turn, so they are left out; the
    greedy choice is the same from either side, so the order of the two texts doesn't matter.
    """
    skip, number = len(a), np.uint32 if max(map(len, texts), default=0) <= 32 else np.uint64
    length = np.array([len(t) for t in texts], np.int64)
    letters = sorted(set("".join(texts)))
    place = {c: i for i, c in enumerate(letters)}
    at = np.zeros((len(letters) + 1, len(texts)), number)  # where a letter is in each text; the last row for letters of none
    for j, t in enumerate(texts):
        for i, c in enumerate(t[skip:], skip):
            at[place[c], j] |= number(1 << i)
    begins = [np.array([t[i : i + 1] for t in texts]) for i in range(4)]
    bits, one = number(0).itemsize * 8, number(1)
    everything = (1 << bits) - 1

    def similarity(text: str) -> np.ndarray:
        own = [at[place.get(c, -1)] for c in text[skip:]]
        reaches = np.maximum(np.maximum(length, len(text)) // 2 - 1, 0)
        kinds = np.unique(reaches)
        free = np.full(len(texts), everything, number)
        hits = []
        for i, row in enumerate(own, skip):
            windows = [number(((1 << min(bits, i + int(r) + 1)) - 1) & ~((1 << max(0, i - int(r))) - 1) & everything) for r in kinds]
            hit = row & free
            hit &= windows[0] if len(kinds) == 1 else np.array(windows, number)[np.searchsorted(kinds, reaches)]
            hit &= ~hit + one  # the first place
            free ^= hit
            hits.append(hit != 0)
        taken, common, turns = ~free, np.full(len(texts), skip, np.int64), np.zeros(len(texts), np.int64)
        for row, hit in zip(own, hits):
            first = taken & (~taken + one)
            common += hit
            turns += hit & ((row & first) == 0)
            taken ^= np.where(hit, first, number(0))
        turns //= 2
        jaro = np.where(common > 0, (common / max(len(text), 1) + common / np.maximum(length, 1) + (common - turns) / np.maximum(common, 1)) / 3, 0.0)
        same, prefix = np.ones(len(texts), bool), np.zeros(len(texts))
        for i, c in enumerate(text[:4]):
            same &= begins[i] == c
            prefix += same
        return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)

    return similarity


def levenshtein_to(a: str, texts: list[str]) -> Callable[[str], np.ndarray]:
    """Function of one text: its edit distance to each of `texts`, all of which begin with a."""
    skip, n = len(a), len(texts)
    length = np.array([len(t) - skip for t in texts], np.int64)
    width = int(length.max(initial=0))
    codes = np.zeros((width, n), np.int64)
    for j, t in enumerate(texts):
        codes[: len(t) - skip, j] = [ord(c) + 1 for c in t[skip:]]

    def distance(text: str) -> np.ndarray:
        row = np.repeat(np.arange(width + 1)[:, None], n, 1)
        for i, c in enumerate(text[skip:], 1):
            cost, before = codes != ord(c) + 1, row
            row = np.empty_like(before)
            row[0] = i
            for j in range(1, width + 1):
                row[j] = np.minimum(np.minimum(row[j - 1], before[j]) + 1, before[j - 1] + cost[j - 1])
        return row[length, np.arange(n)]

    return distance


def level_matrix(kind: str, thresholds: tuple[float, ...], left: list[str], right: list[str]) -> np.ndarray:
    """The agreement levels of each text of the left with each of the right, as gamma() has them."""
    out = np.zeros((len(left), len(right)), np.int8)
    if not out.size:
        return out
    if kind == "email":
        part = lambda t, i: t.split("@")[i] if t.count("@") >= i else None
        low = [[x.lower() for x in side] for side in (left, right)]
        for level, of in ((1, lambda t: part(t, 1)), (2, lambda t: part(t, 0)), (3, lambda t: t)):
            a, b = (np.array([of(x) for x in side], object) for side in low)
            out[(a[:, None] == b[None, :]) & (a != None)[:, None]] = level  # noqa: E711
        return out
    if kind == "exact":
        return (np.array(left, object)[:, None] == np.array(right, object)[None, :]).astype(np.int8)
    if kind not in ("levenshtein", "jaro_winkler"):
        raise ValueError(f"unknown comparison: {kind!r}")
    begin = os.path.commonprefix([min(left), max(left), min(right), max(right)])
    short = np.array([kind == "levenshtein" or len(t) <= 64 for t in right])
    some, long = [t for t, s in zip(right, short) if s], [t for t, s in zip(right, short) if not s]
    known, place = {t: i for i, t in enumerate(right)}, np.flatnonzero(short)
    of = (levenshtein_to if kind == "levenshtein" else jaro_winkler_to)(begin, some) if some else None
    for i, text in enumerate(left):
        if kind == "levenshtein":
            found = of(text)
            for t in sorted(thresholds, reverse=True):
                out[i][found <= t] += 1
        else:
            found = np.zeros(len(right))
            if len(text) > 64:
                found[:] = [jaro_winkler_text(text, t) for t in right]
            else:
                if some:
                    found[place] = of(text)
                found[~short] = [jaro_winkler_text(text, t) for t in long]
            for t in thresholds:
                out[i][found >= t] += 1
        if text in known:
            out[i, known[text]] = len(thresholds) + 1
    return out


def jaro_winkler() -> Callable[[ColumnLike, ColumnLike], Column]:
    """An Arrow function of two text columns; Spark has no such expression. Each pair of values in a batch is compared once."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b))
        there = list({p for p in pairs if p[0] is not None and p[1] is not None})
        known = dict(zip(there, jaro_winkler_texts(there)))
        return pd.Series([known.get(p) for p in pairs], dtype="float64")

    return lambda a, b: similarity(_col(a), _col(b))


def jaro_winkler_bound(a: ColumnLike, b: ColumnLike) -> Column:
    """No less than the Jaro-Winkler similarity of two texts, from the characters that occur in both and their common begin."""
    a, b = _col(a), _col(b)
    m, n = (F.greatest(F.length(x), F.lit(1)).cast("double") for x in (a, b))
    left = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    shared = F.least(left(a, b), left(b, a))
    jaro = F.least((shared / m + shared / n + 1) / 3, F.lit(1.0))
    begin = sum(((F.substring(a, 1, i) == F.substring(b, 1, i)).cast("int") for i in range(1, 5)), F.lit(0))
    return jaro + begin * 0.1 * (1 - jaro)


def levenshtein_level(a: ColumnLike, b: ColumnLike, thresholds: tuple[int, ...] = (1, 2)) -> Column:
    """Highest for equal values, one less within each threshold, 0 beyond, null if a side is null."""
    a, b = _col(a), _col(b)
    distance = F.levenshtein(a, b, max(thresholds))
    level = F.when(a == b, F.lit(len(thresholds) + 1))
    for i, t in enumerate(thresholds):
        level = level.when((distance >= 0) & (distance <= t), F.lit(len(thresholds) - i))
    return F.when(a.isNotNull() & b.isNotNull(), level.otherwise(F.lit(0)))


def similarity_level(a: ColumnLike, b: ColumnLike, score: Column, thresholds: tuple[float, ...]) -> Column:
    """Highest for equal values, one less from each threshold up, 0 below, null if a side is null."""
    a, b = _col(a), _col(b)
    level = F.when(a == b, F.lit(len(thresholds) + 1))
    for i, t in enumerate(thresholds):
        level = level.when(score >= t, F.lit(len(thresholds) - i))
    return F.when(a.isNotNull() & b.isNotNull(), level.otherwise(F.lit(0)))


def exact_level(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("int"))


def email_level(a: ColumnLike, b: ColumnLike) -> Column:
    """3 equal, 2 same name before the at sign, 1 same domain, 0 else."""
    a, b = F.lower(_col(a)), F.lower(_col(b))
    part = lambda c, i: F.try_element_at(F.split(c, "@"), F.lit(i))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 3).when(part(a, 1) == part(b, 1), 2).when(part(a, 2) == part(b, 2), 1).otherwise(0))


def comparison_plan(field_types: dict[str, str]) -> dict[str, tuple[str, tuple[float, ...]]]:
    """Which comparison a column gets, and its thresholds, by field type and name."""
    plan: dict[str, tuple[str, tuple[float, ...]]] = {}
    for column, kind in field_types.items():
        name = column.lower()
        if kind in ("categorical", "numeric"):
            plan[column] = ("exact", ())
        elif kind == "email" or kind in ("identifier", "phone") and "email" in name:
            plan[column] = ("email", ())
        elif kind in ("identifier", "phone"):
            plan[column] = ("jaro_winkler", (0.95, 0.9))
        elif kind == "date" or "dob" in name or "date" in name:
            plan[column] = ("levenshtein", (1, 2))
        else:
            plan[column] = ("jaro_winkler", (0.95, 0.9, 0.8))
    return plan


def levels_of(kind: str, thresholds: tuple[float, ...]) -> int:
    """How many agreement levels a comparison has."""
    return {"exact": 2, "email": 4}.get(kind, len(thresholds) + 2)


def gamma(kind: str, thresholds: tuple[float, ...], a: Column, b: Column) -> Column:
    """The agreement level of two columns."""
    a, b = a.cast("string"), b.cast("string")
    if kind == "exact":
        return exact_level(a, b)
    if kind == "email":
        return email_level(a, b)
    if kind == "levenshtein":
        return levenshtein_level(a, b, tuple(map(int, thresholds)))
    if kind == "jaro_winkler":
        return similarity_level(a, b, jaro_winkler()(a, b), thresholds)
    raise ValueError(f"unknown comparison: {kind!r}")
