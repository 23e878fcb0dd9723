"""Column functions for text, values and keys."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

#: A key that contains one of these hides its value.
SECRET_KEYS = ("password", "secret", "token", "api_key", "apikey", "credential", "auth", "private_key", "access_key")
IDENTIFIER = "^[a-z][a-z0-9_]+$"


@F.pandas_udf(StringType())
def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC form, case-folded; Spark has no function for it."""
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def mixed_tokens(text: Column) -> Column:
    """Latin words and runs of CJK characters of a lower-cased text, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+|[一-鿿]+)"), F.lit(1))))


def alias_score(question: Column, alias: Column) -> Column:
    """2 plus a length bonus if the alias occurs in the question; less if all its tokens do; else 0."""
    q, a = F.lower(question), F.lower(F.trim(alias))
    inside = 2.0 + F.least(F.char_length(a), F.lit(16)) / 16.0
    words = mixed_tokens(a)
    subset = (F.size(words) > 0) & (F.size(F.array_except(words, mixed_tokens(q))) == 0)
    return F.when((a != "") & q.contains(a), inside).when(subset, 0.75 + F.least(F.char_length(a), F.lit(12)) / 48.0).otherwise(0.0)


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def redact(values: Column) -> Column:
    """A string map with the values of secret keys replaced."""
    pattern = "|".join(map(re.escape, SECRET_KEYS))
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit("[REDACTED]")).otherwise(v))


_SECRET = re.compile("|".join(map(re.escape, SECRET_KEYS)), re.IGNORECASE)
_HIDDEN = "[REDACTED]"
#: What parsing cannot reach: secrets in text that only looks like JSON. A value that is open to the end hides the rest.
_PLAIN = re.compile(rf'"([^"\\]*(?:{_SECRET.pattern})[^"\\]*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,}}\]\s"\[{{]+)', re.IGNORECASE)
_INSIDE = re.compile(rf'\\+"([^"\\]*(?:{_SECRET.pattern})[^"\\]*)\\+"\s*:\s*(\\+"[^"\\]*\\+"|[^,}}\]\s"\\\[{{]+)', re.IGNORECASE)
_OPEN = re.compile(rf'(\\*")([^"\\]*(?:{_SECRET.pattern})[^"\\]*)\\*"\s*:\s*(?:[\[{{]|\\*"[^"]*$).*', re.IGNORECASE | re.DOTALL)
_DECODER = json.JSONDecoder()
#: Brackets that begin no JSON, after which the rest of a text is left to the patterns.
_TRIES = 1000


def _clean(value: object) -> object:
    """A JSON value with the whole values of secret keys replaced, whatever their type, also in JSON inside strings."""
    if isinstance(value, dict):
        return {k: _HIDDEN if _SECRET.search(k) else _clean(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v) for v in value]
    return scrub(value) if isinstance(value, str) and _SECRET.search(value) else value


def scrub(text: str) -> str:
    """Text with secrets replaced in every JSON value that it holds; other text stays as it is."""
    out, done, tries = [], 0, 0
    at = re.search(r"[\[{]", text)
    while at and tries < _TRIES:
        try:
            value, end = _DECODER.raw_decode(text, at.start())
            cleaned = _clean(value)
        except RecursionError:
            return "".join(out) + text[done : at.start()] + _HIDDEN
        except json.JSONDecodeError:
            tries, end = tries + 1, at.start() + 1
        else:
            whole = text[at.start() : end] if cleaned == value else json.dumps(cleaned, ensure_ascii=False, separators=(",", ":"))
            out += [text[done : at.start()], whole]
            done = end
        at = re.compile(r"[\[{]").search(text, end)
    rest = "".join(out) + text[done:]
    rest = _INSIDE.sub(lambda m: f'\\"{m[1]}\\":\\"{_HIDDEN}\\"', _PLAIN.sub(lambda m: f'"{m[1]}":"{_HIDDEN}"', rest))
    return _OPEN.sub(lambda m: f"{m[1]}{m[2]}{m[1]}:{m[1]}{_HIDDEN}{m[1]}" if _HIDDEN not in m[0][:80] else m[0], rest)


@F.pandas_udf(StringType())
def _scrub(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else scrub(x))


def redact_json(text: Column) -> Column:
    """Text with the values of secret keys replaced in all JSON that it holds. Only texts that name such a key leave the JVM."""
    named = F.when(F.lower(text).rlike("|".join(map(re.escape, SECRET_KEYS))), text)
    return F.coalesce(_scrub(named), text)


def snippet(text: Column, term: str, around: int = 60) -> Column:
    """`around` characters on both sides of the first occurrence, case ignored, with an ellipsis where text was left out."""
    at = F.locate(term.lower(), F.lower(text))
    begin, end = F.greatest(at - around, F.lit(1)), F.least(at + len(term) + around, F.char_length(text) + 1)
    cut = F.substr(text, begin, end - begin)
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(end <= F.char_length(text), "…").otherwise("")))


def strict_int(text: Column) -> Column:
    """struct(value, bad): empty is null, anything else that is no integer is bad."""
    t = F.trim(text)
    value = F.try_to_number(F.when(t.rlike(r"^[+-]?\d{1,18}$"), F.regexp_replace(t, r"^\+", "")), F.lit("S999999999999999999")).cast("long")
    return F.struct(value.alias("value"), ((t != "") & value.isNull()).alias("bad"))


def strict_decimal(text: Column) -> Column:
    """struct(value, bad): two places, rounded once, half to even. Plain and exponent notation."""
    t = F.trim(text)
    plain = F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?$"), t)
    # Digits beyond the 17th place count only as more than nothing, so that the cast rounds nothing.
    short = F.regexp_replace(F.regexp_replace(plain, r"^([+-]?\d*\.\d{17})\d*[1-9]\d*$", "$11"), r"^([+-]?\d*\.\d{17})0+$", "$1")
    value = F.bround(short.try_cast("decimal(38,18)"), 2).try_cast("decimal(14,2)")
    return F.struct(value.alias("value"), ((t != "") & value.isNull()).alias("bad"))


def strict_timestamp(text: Column) -> Column:
    t = F.trim(text)
    value = F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.struct(value.alias("value"), ((t != "") & value.isNull()).alias("bad"))


def strict_state(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.struct(F.when(t.rlike("^[A-Z]{2}$"), t).alias("value"), (~t.rlike("^[A-Z]{2}$")).alias("bad"))


def requested_range(question: Column) -> Column:
    """struct(start, end) of ISO dates: an explicit range, else the whole of the one year that is named, else null."""
    date = r"(\d{4}-\d{2}-\d{2})"
    pair = rf"{date}\s*(?:to|until|~|至|到|-)\s*{date}"
    start, end = F.regexp_extract(question, pair, 1), F.regexp_extract(question, pair, 2)
    years = F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?<!\d)((?:19|20)\d{2})(?![\d-])"), F.lit(1)))
    year = F.when(F.size(years) == 1, F.get(years, F.lit(0)))
    return F.when(start != "", F.struct(start.alias("start"), end.alias("end"))).when(year.isNotNull(), F.struct(F.concat(year, F.lit("-01-01")).alias("start"), F.concat(year, F.lit("-12-31")).alias("end")))


def format_value(metric_id: Column, value: Column) -> Column:
    """Rates as percent, days with their unit, counts whole, money with two places; null as 'no data'."""
    value = value.cast("double")
    return (
        F.when(value.isNull(), "no data")
        .when(metric_id.endswith("_rate"), F.concat(F.format_string("%.2f", value * 100), F.lit("%")))
        .when(metric_id.endswith("_days"), F.concat(F.format_string("%.2f", value), F.lit(" days")))
        .when(metric_id.endswith("_count"), value.cast("long").cast("string"))
        .otherwise(F.format_string("%.2f", value))
    )


def json_safe(value: Column, kind: DataType | None = None) -> Column:
    """A value for JSON by its type (a double if none is given): numbers without NaN or infinity at six places, at most 160 characters of
    text, ISO dates and times; whole numbers and booleans as they are, anything else as text."""
    if kind is None or isinstance(kind, DoubleType | FloatType):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.round(value, 6))
    if isinstance(kind, DecimalType):
        return F.round(value.cast("double"), 6)
    if isinstance(kind, DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(kind, TimestampType | TimestampNTZType):
        micros = F.when(F.date_format(value, "SSSSSS") != "000000", F.date_format(value, ".SSSSSS")).otherwise("")
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), micros)
    if isinstance(kind, IntegralType | BooleanType):
        return value
    return F.left(value.cast("string"), F.lit(160))


#: Error categories by pattern, in order, and whether one repair may be tried.
ERROR_CATEGORIES = (
    ("timeout", r"timeout|canceling statement|cancelled", False),
    ("permission", r"permission denied|insufficient_permissions|not allowed|42501", False),
    ("connection", r"connection|could not connect|refused", False),
    ("unknown_column", r"unresolved_column|column .* does not exist|no such column|42703", True),
    ("unknown_table", r"table_or_view_not_found|relation .* does not exist|no such table|42p01", True),
    ("syntax", r"parse_syntax_error|syntax error|42601", True),
    ("type_mismatch", r"datatype_mismatch|cast_invalid_input|invalid input syntax|operator does not exist|42804", True),
)


#: A number that names something, as in "event 42501": no error code, unless it is said to be one.
_NUMBERED = r"\b(?!(?:sqlstate|errcode|error|code|state)\b)([a-z_]+) \d+\b"


def error_category(message: Column) -> Column:
    """struct(category, retryable) of an error text. Digits after a noun ("event 42501") are no code."""
    said = F.regexp_replace(F.lower(message), _NUMBERED, "$1")
    out = F.struct(F.lit("unknown").alias("category"), F.lit(False).alias("retryable"))
    for name, pattern, retry in reversed(ERROR_CATEGORIES):
        out = F.when(said.rlike(pattern), F.struct(F.lit(name).alias("category"), F.lit(retry).alias("retryable"))).otherwise(out)
    return out


#: Where SQL stands in a model's answer, in order of preference; the last match counts.
SQL_PATTERNS = (r"(?is)\b(CREATE\s+TABLE\b.*?\bAS\b.*?;)", r"(?is)\b(WITH\b .*?;)", r"(?is)\b(SELECT\b .*?;)", r"(?is)```sql\s*\n(.*?)```", r"(?is)```(.*?)```")


def extract_sql(text: Column) -> Column:
    """SQL inside a model's answer: a statement up to its semicolon, else a fenced block, else the whole text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in SQL_PATTERNS]
    return F.coalesce(*[F.when(F.size(x) > 0, F.regexp_replace(F.element_at(x, -1), r"^\s+|\s+$", "")) for x in found], text)


#: Names of result files that charts may read, and the largest table that makes a chart.
RESULT_FILE, CHART_ROWS, CHART_COLUMNS = r"^query_results_[0-9a-f]{8}\.csv$", 200, 3


def chartable(name: Column, rows: Column, columns: Column) -> Column:
    """Whether a result file may be charted: its name is that of a result, and it is small."""
    return name.rlike(RESULT_FILE) & (rows <= CHART_ROWS) & (columns <= CHART_COLUMNS)
