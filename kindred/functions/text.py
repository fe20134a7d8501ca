"""Column expressions that clean, normalise, serialise and parse values; all of them stay in the JVM."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Without white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(_col(c).cast("string"), "^\\s+|\\s+$", "")


# -- missing values ---------------------------------------------------------------------------------------------


def clean_missing(c: ColumnLike) -> Column:
    """Exactly "" and "nan" become null."""
    c = _col(c)
    return F.when(~c.cast("string").isin("", "nan"), c)


def clean_frame(df: DataFrame) -> DataFrame:
    """clean_missing on every string column."""
    return df.select(*[clean_missing(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def fill_missing(c: ColumnLike) -> Column:
    """As a string, "" for null."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def is_missing(c: ColumnLike, data_type: str = "string") -> Column:
    c = _col(c)
    return c.isNull() | F.isnan(c) if data_type in ("float", "double") else c.isNull()


# -- combining and ids -------------------------------------------------------------------------------------------


def combine_text(df: DataFrame, columns: list[str]) -> Column:
    """The columns that exist, stripped, without blanks, joined by spaces; null if nothing is left."""
    parts = F.array(*[strip(c) for c in columns if c in df.columns]).cast("array<string>")
    return F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "), F.lit(""))


def clean_numeric_text(c: ColumnLike) -> Column:
    """The first number in a text as a double; commas end it."""
    return F.regexp_extract(_col(c).cast("string"), "[-+]?[0-9]+(?:\\.[0-9]+)?", 0).try_cast("double")


def source_key(table: str, c: ColumnLike) -> Column:
    """`table:id`; a null id becomes the text nan."""
    return F.concat(F.lit(table + ":"), F.coalesce(_col(c).cast("string"), F.lit("nan")))


def normalize_id(c: ColumnLike) -> Column:
    """Null becomes "", and a final `.0` goes."""
    return F.regexp_replace(fill_missing(c), "\\.0$", "")


def join_values(c: ColumnLike) -> Column:
    """A list's non-empty items, joined by ` | `."""
    return F.array_join(F.filter(_col(c).cast("array<string>"), lambda x: x.isNotNull() & (x != "")), " | ")


# -- field values -------------------------------------------------------------------------------------------------


def is_email(c: ColumnLike) -> Column:
    return _col(c).cast("string").rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$")


#: What Python takes for a digit: decimal digits of any script, and such signs as superscripts.
_DIGITS = "[\\p{Nd}" + "".join(chr(i) for i in range(0x10000) if chr(i).isdigit() and not chr(i).isdecimal()) + "]"


def is_phone(c: ColumnLike) -> Column:
    """7 to 15 digits (of any script), with a plus in front and the usual separators."""
    bare = F.regexp_replace(F.regexp_replace(_col(c).cast("string"), "^\\+", ""), "[\\s().\\-/]", "")
    return bare.rlike(f"^{_DIGITS}{{7,15}}$")


def normalize_identifier(c: ColumnLike) -> Column:
    return F.regexp_replace(strip(F.lower(_col(c).cast("string"))), "\\s+", " ")


def normalize_email(c: ColumnLike) -> Column:
    return F.lower(strip(c))


def normalize_phone(c: ColumnLike) -> Column:
    """E.164 for North American numbers; else the plus and the digits; else the lower-cased text."""
    text = strip(c)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (
        F.when(~text.startswith("+") & digits.rlike("^[2-9][0-9]{9}$"), F.concat(F.lit("+1"), digits))
        .when(digits.rlike("^1[2-9][0-9]{9}$"), F.concat(F.lit("+"), digits))
        .when(digits != "", F.concat(F.when(text.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits))
        .otherwise(F.lower(text))
    )


def identifier_text(field_type: str, c: ColumnLike, normalize: bool = True) -> Column:
    """A value as the encoder takes it, by its field type."""
    if not normalize:
        return _col(c).cast("string")
    return {"identifier": normalize_identifier, "email": normalize_email, "phone": normalize_phone}.get(field_type, lambda x: _col(x).cast("string"))(c)


def sigmoid(c: ColumnLike) -> Column:
    return 1 / (1 + F.exp(-_col(c)))


def logit(c: ColumnLike, floor: float = 1e-6) -> Column:
    p = F.least(F.greatest(_col(c), F.lit(floor)), F.lit(1 - floor))
    return F.log(p / (1 - p))


#: Date formats that are tried in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "d MMM yyyy", "MMM d, yyyy")


def parse_date(c: ColumnLike) -> Column:
    return F.coalesce(*[F.try_to_date(_col(c).cast("string"), f) for f in DATE_FORMATS])


def date_parts(c: ColumnLike) -> Column:
    """year (from 2000, in centuries), month, day, weekday (Monday is 1) of a date."""
    c = _col(c)
    return F.struct(((F.year(c) - 2000) / 100).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), (F.weekday(c) + 1).alias("weekday"))


# -- tokens -------------------------------------------------------------------------------------------------------

#: Characters whose compatibility decomposition (NFKD) has ASCII in it, by what is left of them in ASCII: one character, or several.
_FOLDED = {chr(i): x for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and (x := unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode())}
_FOLDED_SHORT = {c: x for c, x in _FOLDED.items() if len(x) == 1}
_FOLDED_LONG = {c: x for c, x in _FOLDED.items() if len(x) > 1}


def ascii_fold(c: ColumnLike) -> Column:
    """Characters (of the basic plane) as NFKD takes them apart, of which ASCII stays."""
    short = F.translate(_col(c).cast("string"), "".join(_FOLDED_SHORT), "".join(_FOLDED_SHORT.values()))
    table = F.from_json(F.lit(json.dumps(_FOLDED_LONG)), "map<string,string>")
    # few texts have characters that become several: those are taken character by character
    spell = lambda t: F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    long = F.transform(F.array(short), lambda t: F.when(t.rlike("[" + "".join(_FOLDED_LONG) + "]"), spell(t)).otherwise(t))
    return F.regexp_replace(F.element_at(long, 1), "[^\\x00-\\x7F]", "")


def name_token(c: ColumnLike, default: str = "user", upper: bool = False, fold: bool = True) -> Column:
    """Letters and digits only, in one case; the default if none are left. fold: accents go first (not needed for ASCII)."""
    token = F.regexp_replace(ascii_fold(c) if fold else _col(c).cast("string"), "[^a-zA-Z0-9]+", "")
    token = F.upper(token) if upper else F.lower(token)
    return F.coalesce(F.nullif(token, F.lit("")), F.lit(default))


def birth_year_suffix(c: ColumnLike) -> Column:
    """The last two digits of the first year of the 1900s or 2000s; "" without one."""
    return F.regexp_extract(fill_missing(c), "(?:19|20)([0-9]{2})", 1)


def normalize_state(c: ColumnLike) -> Column:
    """The first two letters in a row."""
    return F.regexp_extract(F.upper(strip(c)), "[A-Z]{2}", 0)


#: Words that a company's domain leaves out (fixed values).
DOMAIN_STOP_WORDS = ("and", "the", "llc", "inc", "corp", "co", "company")
WORK_TLDS = ("com", "co", "net", "io")


def company_domain(c: ColumnLike, seed: ColumnLike, fold: bool = True) -> Column:
    """An e-mail domain: up to three words with hyphens, run together, or the first alone, by the seed."""
    words = F.filter(F.split(F.lower(ascii_fold(c) if fold else _col(c).cast("string")), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*DOMAIN_STOP_WORDS))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("example")))
    draw, style = F.pmod(F.xxhash64(_col(seed), F.lit("style")), F.lit(10)), F.slice(words, 1, 3)
    stem = F.when((F.size(words) > 1) & (draw < 4), F.array_join(style, "-")).when((F.size(words) > 1) & (draw < 7), F.array_join(style, "")).otherwise(F.element_at(words, 1))
    return F.concat(stem, F.lit("."), F.element_at(F.array(*map(F.lit, WORK_TLDS)), F.pmod(F.xxhash64(_col(seed), F.lit("tld")), F.lit(len(WORK_TLDS))).cast("int") + 1))


def format_person_name(first: ColumnLike, last: ColumnLike) -> Column:
    return strip(F.concat_ws(" ", F.nullif(fill_missing(first), F.lit("")), F.nullif(fill_missing(last), F.lit(""))))


def format_location(city: ColumnLike, state: ColumnLike) -> Column:
    city, state = F.nullif(fill_missing(city), F.lit("")), F.nullif(fill_missing(state), F.lit(""))
    return F.coalesce(F.concat(city, F.lit(", "), state), city, state, F.lit("the United States"))


def format_company(c: ColumnLike) -> Column:
    return F.regexp_replace(strip(c), "\\.+$", "")


# -- serialising ---------------------------------------------------------------------------------------------------


def serialize_colval(columns: list[str]) -> Column:
    """`COL name VAL value ...`; tabs and line breaks become spaces, nulls are empty."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"COL {c} VAL "), strip(F.translate(fill_missing(c), "\t\n", "  "))) for c in columns])


def serialize_record(columns: list[str], skip: tuple[str, ...] = ("id",)) -> Column:
    """`name: value; ...` of the values that are there."""
    parts = [F.when(strip(c) != "", F.concat(F.lit(f"{c}: "), strip(c))) for c in columns if c not in skip]
    return F.concat_ws("; ", *parts) if parts else F.lit("")


PROFILE_KEYS = ("fullname", "email", "phone", "addr", "dob")


def serialize_profile(profile: ColumnLike, lists: tuple[str, ...] = ("email", "phone", "addr")) -> Column:
    """`key: value; ...` of a profile struct, lists joined by ` | `."""
    profile, parts = _col(profile), []
    for key in PROFILE_KEYS:
        value = F.array_join(profile[key], " | ") if key in lists else profile[key]
        parts.append(F.when(value != "", F.concat(F.lit(f"{key}: "), value)))
    return F.concat_ws("; ", *parts)


#: Texts that a selector's answers depend on (fixed values).
_SELECT = "Select a record from the following candidates that refers to the same real-world entity as the given record. "
_MANY = 'Answer with the corresponding record number surrounded by "[]" or "[0]" if there is none.'
_ONE = 'Answer with "[1]" if the candidate is the same entity, or "[0]" if there is none.'


def make_prompt(anchor: ColumnLike, candidates: ColumnLike) -> Column:
    """A question about a record and a list of candidates, which are numbered from 1."""
    listed = F.array_join(F.transform(_col(candidates), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return F.concat(F.lit(f"{_SELECT}{_MANY}\n\nGiven entity record:\n"), _col(anchor), F.lit("\n\nCandidate records:\n"), listed, F.lit("\n"))


def make_pair_prompt(anchor: ColumnLike, candidate: ColumnLike) -> Column:
    return F.concat(F.lit(f"{_SELECT}{_ONE}\n\nGiven entity record:\n"), _col(anchor), F.lit("\n\nCandidate records:\n[1] "), _col(candidate), F.lit("\n"))


def parse_prediction(answer: ColumnLike, candidates: ColumnLike) -> Column:
    """The first number in brackets; 0 if there is none or no such candidate."""
    n = F.regexp_extract(fill_missing(answer), "\\[([0-9]+)\\]", 1).try_cast("int")
    return F.when(n.between(1, _col(candidates)), n).otherwise(0)


def parse_pair_prediction(answer: ColumnLike) -> Column:
    return parse_prediction(answer, F.lit(1)) == 1


def hashed_ngrams(c: ColumnLike, dimensions: int = 64, n: int = 3) -> Column:
    """A text's hashed character n-grams as an L2-normalised array; the offline stand-in for a text embedding."""
    text = F.concat(F.lit(" "), normalize_identifier(c), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.pmod(F.crc32(F.substring(text, i, F.lit(n))), F.lit(dimensions)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(_col(c).isNotNull(), F.transform(counts, lambda x: x / F.greatest(norm, F.lit(1e-12))))
