"""String functions: config keys, templates and text columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def camelize(text: str | None, start_upper: bool = False) -> str:
    """foo_bar and foo-bar become fooBar, or FooBar; runs of separators count once; None gives ''."""
    words = [w for w in re.split(r"[_-]+", text or "") if w]
    if not words:
        return ""
    first = words[0] if not start_upper else words[0][:1].upper() + words[0][1:]
    return first + "".join(w[:1].upper() + w[1:] for w in words[1:])


def camelize_column(col: Column, start_upper: bool = False) -> Column:
    """camelize() as a column expression."""
    words = F.filter(F.split(F.coalesce(col, F.lit("")), "[_-]+"), lambda w: w != "")
    upper = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(words, lambda w, i: F.when((i == 0) & F.lit(not start_upper), w).otherwise(upper(w))), "")


def underscore(col: Column) -> Column:
    """White space runs as single underscores."""
    return F.regexp_replace(col, r"\s+", "_")


def count_substring(col: Column, part: str) -> Column:
    """Occurrences of part that don't overlap; 0 for null and for an empty part."""
    if not part:
        return F.lit(0)
    return F.coalesce(((F.length(col) - F.length(F.replace(col, F.lit(part), F.lit("")))) / len(part)).cast("int"), F.lit(0))


def parameterize(conf: Mapping) -> dict[str, str]:
    """Camelized keys and text values, for templates."""
    return {camelize(k): str(v) for k, v in conf.items()}


def is_number(text: str) -> bool:
    """Whether a text is a numeric literal."""
    return bool(re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", text.strip()))


_VARIABLE = re.compile(r"(?<!\$)\$(?:\{(\w+)\}|(\w+))")


def template(text: str, variables: Mapping[str, object]) -> str:
    """Puts variables in place of $name and ${name}; unknown names and $$name stay as they are."""

    def put(found: re.Match) -> str:
        name = found[1] or found[2]
        return str(variables[name]) if name in variables else found[0]

    return _VARIABLE.sub(put, text)


def paths(events: Column, field: str = "event_type") -> Column:
    """Event types of an array of events, joined by commas."""
    return F.array_join(F.transform(events, lambda e: e[field]), ",")


unique_paths = paths
