"""Scalar expressions shared by the operators. Every one is a plain Column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space around a text value.
WHITE_SPACE = (
    " \t\n\u000b\u000c\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# A plain decimal number and the accepted time layouts.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
RFC3339_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
MINUTE_PATTERN = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"
DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
RFC3339_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(value: Column | str) -> Column:
    """Text without white space at either end."""
    return F.btrim(_col(value), F.lit(WHITE_SPACE))


def clean_lower(value: Column | str) -> Column:
    return F.lower(clean(value))


def present(value: Column | str) -> Column:
    """Trimmed text, with blank text turned into null."""
    return F.nullif(clean(value), F.lit(""))


def first_present(*values: Column | str) -> Column:
    """First value that is not blank, trimmed; null when all are blank."""
    return F.coalesce(*[present(v) for v in values])


def equal_fold(left: Column | str, right: Column | str) -> Column:
    return F.lower(_col(left)) == F.lower(_col(right))


def strip_quotes(value: Column | str) -> Column:
    """A literal without surrounding white space and quote characters."""
    return F.btrim(clean(value), F.lit("'\""))


def blank_to(value: Column | str, default: str) -> Column:
    """SQL ``COALESCE(NULLIF(TRIM(x), ''), default)``."""
    return F.coalesce(F.nullif(F.trim(_col(value)), F.lit("")), F.lit(default))


def text_number(value: Column | str) -> Column:
    """Double from loosely typed text; null unless the whole text is a decimal number."""
    text = clean(value)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """Numeric reading of a column: a cast for numbers, a guarded parse for text."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(df.schema[name].dataType, T.StringType):
        return text_number(name)
    return F.lit(None).cast("double")


def utc_clock(instant: Column) -> Column:
    """Zone-free UTC clock time of an instant, whatever the session zone is."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def rfc3339_time(value: Column | str) -> Column:
    """UTC clock time of RFC 3339 text, else null."""
    text = clean(value)
    return F.when(text.rlike(RFC3339_PATTERN), utc_clock(text.try_cast("timestamp")))


def parse_time(value: Column | str) -> Column:
    """UTC clock time from RFC 3339, ``yyyy-MM-dd HH:mm`` or ``yyyy-MM-dd``, else null."""
    text = clean(value)
    plain = F.when(text.rlike(MINUTE_PATTERN) | text.rlike(DAY_PATTERN), text.try_cast("timestamp_ntz"))
    return F.coalesce(rfc3339_time(text), plain)


def json_text(payload: Column | str, path: str) -> Column:
    """Field of a JSON document as text, null when absent."""
    return F.get_json_object(_col(payload), path)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Exact elapsed seconds as a double, for clock times and instants alike."""
    span = (_col(end) - _col(start)).cast("interval second")
    return span.cast("decimal(18,6)").cast("double")


def token(value: Column | str, salt: str) -> Column:
    """Stable pseudonym: salted SHA-256, first eight bytes in hex."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit(":"), _col(value)), 256)
    return F.concat(F.lit("token_"), F.substring(digest, 1, 16))


def random_token(value: Column | str, salt: str) -> Column:
    """Unlinkable pseudonym: equal values get different tokens."""
    digest = F.sha2(F.concat_ws(":", F.lit(salt), _col(value), F.uuid()), 256)
    return F.concat(F.lit("token_"), F.substring(digest, 1, 16))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def last_part(value: Column | str, separator: str = "/") -> Column:
    return F.substring_index(_col(value), separator, -1)


def title_case(value: Column | str) -> Column:
    return F.initcap(_col(value))


def slug(value: Column | str, default: str = "cohort-export") -> Column:
    """File-name form: a-z, 0-9, ``-`` and ``_``; everything else becomes ``-``."""
    text = F.regexp_replace(clean_lower(value), r"[^a-z0-9_-]", "-")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def utc_text(value: Column | str) -> Column:
    return F.date_format(_col(value), RFC3339_FORMAT)


def export_text(df: DataFrame, name: str) -> Column:
    """CSV text of a column: six decimals, UTC times, JSON for nested values, empty for null."""
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.format_string("%.6f", value)
    elif isinstance(kind, T.TimestampNTZType):
        text = utc_text(value)
    elif isinstance(kind, T.TimestampType):
        text = utc_text(utc_clock(value))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(text)


def all_of(predicates: Iterable[Column]) -> Column:
    """Conjunction; an empty list holds for every row."""
    result = F.lit(True)
    for predicate in predicates:
        result = result & predicate
    return result
