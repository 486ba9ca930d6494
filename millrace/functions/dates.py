"""Dates, times and typed parsing as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Date patterns in the order of trial: fixed values.
DATE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSZ", "yyyy-MM-dd HH:mm:ss.SSSXXX",
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyyMMdd HH:mm:ss", "EEE, MMM d, ''yy", "EEE, MMM d, yyyy", "yyyy.MM.dd", "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "dd-MM-yyyy", "dd/MM/yyyy",
    "MM.dd.yyyy", "MM-dd-yyyy", "MM/dd/yyyy", "dd.MM.yy", "dd-MM-yy", "dd/MM/yy", "MM.dd.yy", "MM-dd-yy", "MM/dd/yy", "dd/MMM/yy", "yyyy-MM-dd'T'HH", "yyyy-MM-dd HH",
    "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss Z",
)
#: Patterns that are tried after those.
MORE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssX", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d yyyy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyyMMddHHmmss", "yyyyMMdd",
)
#: Words for true and false: fixed values.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")


def to_time(col: Column, pattern: str) -> Column:
    """Timestamp by a pattern; hours of one digit pass where the pattern says HH; null if it doesn't fit."""
    return F.try_to_timestamp(col, F.lit(re.sub("(?<!d)HH", "H", pattern)))


def format_date(col: Column, pattern: str) -> Column:
    """A text date as yyyy-MM-dd."""
    return F.date_format(to_time(col, pattern), "yyyy-MM-dd")


def format_date_time(col: Column, pattern: str) -> Column:
    """A text date as yyyy-MM-dd HH:mm:ss."""
    return F.date_format(to_time(col, pattern), "yyyy-MM-dd HH:mm:ss")


def epoch_seconds(col: Column, pattern: str) -> Column:
    return F.unix_seconds(to_time(col, pattern))


def epoch_millis(col: Column, pattern: str) -> Column:
    return F.unix_millis(to_time(col, pattern))


def parse_boolean(col: Column) -> Column:
    """true, t, yes, y, on, 1 and their opposites, in any case; else null."""
    word = F.lower(F.trim(col))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_date(col: Column, patterns: tuple[str, ...] = DATE_PATTERNS + MORE_PATTERNS) -> Column:
    """First pattern that fits; days and months may have one digit, a leading weekday is ignored.

    Years of two digits lie from 1950 to 2049.
    """
    plain = F.regexp_replace(F.trim(col), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")

    def one(pattern: str) -> Column:
        t = to_time(plain, _lenient(pattern))
        short = "yy" in pattern and "yyyy" not in pattern
        return F.when(F.year(t) >= 2050, t - F.expr("interval 100 years")).otherwise(t) if short else t

    return F.coalesce(*map(one, dict.fromkeys(patterns)))


def _lenient(pattern: str) -> str:
    if re.match("yyyyMM", pattern):
        return pattern
    return re.sub(r"(?<!M)MM(?!M)", "M", pattern.removeprefix("EEE, ").replace("dd", "d"))


#: Parsers by type name.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "boolean": parse_boolean,
    "date": lambda c: parse_date(c).cast("date"),
    "timestamp": parse_date,
    "int": lambda c: F.trim(c).try_cast("int"),
    "long": lambda c: F.trim(c).try_cast("long"),
    "double": lambda c: F.trim(c).try_cast("double"),
    "string": lambda c: c,
}


def not_after(a: Column, b: Column) -> Column:
    return a <= b


def not_before(a: Column, b: Column) -> Column:
    return a >= b


def register(spark: SparkSession) -> None:
    """hashKey(text) and convertStringToTimestamp(text, pattern) for SQL; Catalyst puts their bodies in place."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hashKey(k STRING) RETURNS STRING RETURN md5(k)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION convertStringToTimestamp(s STRING, pattern STRING) RETURNS TIMESTAMP RETURN try_to_timestamp(s, replace(pattern, 'HH', 'H'))")
