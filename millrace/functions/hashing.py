"""Keys and change hashes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "\x1f"


def hash_key(col: Column) -> Column:
    """MD5 as 32 lower-case hex digits."""
    return F.md5(col.cast("string").cast("binary"))


def sha256_key(col: Column) -> Column:
    """SHA-256 as 64 lower-case hex digits."""
    return F.sha2(col.cast("string").cast("binary"), 256)


@F.pandas_udf(T.StringType())
def fast_hash(text: pd.Series) -> pd.Series:
    """64-bit xxHash (seed 0) over the UTF-16 code units, as a signed decimal number; null stays null.

    Spark's own xxhash64 has another seed and hashes UTF-8, so it can't give these values; for change detection
    use change_hash, which needs no Python.
    """

    def one(t):
        if t is None:
            return None
        h = xxhash.xxh64_intdigest(t.encode("utf-16-le", "surrogatepass"))
        return str(h - (1 << 64) if h >> 63 else h)

    return text.map(one)


def entity_key(id_type: str, ids: Sequence[str | Column]) -> Column:
    """MD5 over the id type and the id fields, without separators; null if an id is null."""
    return F.md5(F.concat(F.lit(id_type), *(_col(c).cast("string") for c in ids)))


def change_hash(cols: Sequence[str | Column]) -> Column:
    """64-bit hash of columns with nulls told apart from empty texts and neighbours kept apart."""
    tagged = [F.when(_col(c).isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), _col(c).cast("string"))) for c in cols]
    return F.xxhash64(F.concat_ws(UNIT, *tagged)) if tagged else F.lit(0).cast("long")


def _col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c
