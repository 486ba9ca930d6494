"""Star schemas: dimensions with history and facts with looked-up keys."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.model import OPEN_END

UNKNOWN = "unknown"
UNKNOWN_ID = -1
BROADCAST_ROWS = 500_000
_OPEN = OPEN_END


def member_key(fields: Sequence[str]) -> Column:
    """MD5 over the dimension fields as text, nulls as unknown."""
    return F.md5(F.concat(*(F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN)) for f in fields)))


def dim_members(df: DataFrame, fields: Sequence[str], attrs: Sequence[str] = ()) -> DataFrame:
    """Distinct members with hashed_key and hashed_value; of several attribute rows of a member the least."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c.lower()) for c in (*fields, *attrs)]
    rows = df.select(*text).distinct()
    low, low_attrs = [f.lower() for f in fields], [a.lower() for a in attrs]
    if attrs:
        rows = rows.groupBy(*low).agg(F.min(F.struct(*low_attrs)).alias("a")).select(*low, *(F.col(f"a.{a}").alias(a) for a in low_attrs))
    value = F.md5(F.concat_ws("\x1f", *low_attrs)) if attrs else F.md5(F.lit(""))
    return rows.withColumn("hashed_key", F.md5(F.concat(*low))).withColumn("hashed_value", value)


def unknown_member(members: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The row for missing members: every field unknown."""
    text = [c for c in members.columns if c not in ("hashed_key", "hashed_value")]
    return members.sparkSession.range(1).select(*(F.lit(UNKNOWN).alias(c) for c in text), F.md5(F.lit(UNKNOWN * len(fields))).alias("hashed_key"), F.md5(F.lit("")).alias("hashed_value"))


def numbered(rows: DataFrame, start: int | Column) -> DataFrame:
    """Ids after start in the order of hashed_key.

    Ranks within ranges of the key are added to the sizes of the earlier ranges, so no task sees all rows.
    """
    rows = rows.withColumn("_p", F.substring("hashed_key", 1, 2))
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # at most 256 ranges
    sizes = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    at = F.row_number().over(W.partitionBy("_p").orderBy("hashed_key"))
    return rows.join(F.broadcast(sizes), "_p").withColumn("id", (F.lit(start) + F.col("_b") + at).cast("long")).drop("_p", "_b")


def load_dim(df: DataFrame, fields: Sequence[str], attrs: Sequence[str] = (), existing: DataFrame | None = None, load_ts: dt.datetime | str = "2024-01-01 00:00:00", process_id: str = "", user_id: str = "", source: str = "") -> DataFrame:
    """The dimension after a load, history included.

    Members are matched by hashed_key and keep their id; new ones get ids after the greatest; members whose
    hashed_value differs get a new version with the same id, and their old version ends. The unknown member
    has the id -1.
    """
    members = dim_members(df, fields, attrs)
    members = members.where(F.col("hashed_key") != F.md5(F.lit(UNKNOWN * len(fields))))
    now = F.lit(str(load_ts)).cast("timestamp_ntz")
    meta = {"start_time": now, "end_time": F.lit(_OPEN).cast("timestamp_ntz"), "process_id": F.lit(process_id), "user_id": F.lit(user_id), "source": F.lit(source), "rectype": F.lit("I"), "version": F.lit(1)}
    if existing is None:
        unknown = unknown_member(members, fields).withColumn("id", F.lit(UNKNOWN_ID).cast("long"))
        return numbered(members, 0).unionByName(unknown).withColumns(meta)
    open_rows = existing.where(F.col("end_time") == F.lit(_OPEN).cast("timestamp_ntz"))
    top = existing.agg(F.greatest(F.max("id"), F.lit(0)).alias("m")).first()["m"] or 0
    new = numbered(members.join(open_rows.select("hashed_key"), "hashed_key", "left_anti"), top).withColumns(meta)
    old = open_rows.select("hashed_key", F.col("id"), F.col("hashed_value").alias("_old"), F.col("version").alias("_v"))
    changed = members.join(old, "hashed_key").where("hashed_value <> _old").withColumns(meta).withColumns({"rectype": F.lit("U"), "version": F.col("_v") + 1}).drop("_old", "_v")
    ended = existing.join(changed.select("hashed_key", (F.col("version") - 1).alias("version"), F.lit(True).alias("_ends")), ["hashed_key", "version"], "left")
    ended = ended.withColumn("end_time", F.when(F.col("_ends"), now).otherwise(F.col("end_time"))).drop("_ends")
    return ended.unionByName(new, allowMissingColumns=True).unionByName(changed, allowMissingColumns=True)


def load_facts(df: DataFrame, measures: Sequence[str], dims: dict[str, tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """Measures and fk_<dim> of every row; dims: name -> (fields, dimension). Missing members give -1.

    A dimension is broadcast only if a bounded count finds at most BROADCAST_ROWS open members.
    """
    out = df
    for name, (fields, dim) in dims.items():
        keys = dim.where(F.col("end_time") == F.lit(_OPEN).cast("timestamp_ntz")).select(F.col("hashed_key").alias("_k"), F.col("id").alias(f"fk_{name}"))
        if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        out = out.withColumn("_k", member_key(fields)).join(keys, "_k", "left").drop("_k").withColumn(f"fk_{name}", F.coalesce(f"fk_{name}", F.lit(UNKNOWN_ID).cast("long")))
    return out.select(*measures, *(f"fk_{n}" for n in dims))


def write_sample(df: DataFrame, write: Callable[[DataFrame], None], max_rows: int, seed: int = 7) -> None:
    """Hands a Bernoulli sample of about max_rows rows to a writer."""
    n = df.count()
    write(df if n <= max_rows else df.sample(False, max_rows / n, seed))


def dimensionalize(config: dict, read: Callable[[str], DataFrame], write: Callable[[DataFrame, str], None], **meta) -> None:
    """For each table of a configuration: the table, its sample, its dimensions and its facts.

    config: {"sample": rows, "tables": {table: {"source", "dims": [{"fields", "attrs"}], "facts": [...]}}}
    """
    for table, spec in config["tables"].items():
        df = read(spec["source"])
        write(df, table)
        write_sample(df, lambda x, t=table: write(x, f"{t}_sample"), config.get("sample", 100_000))
        dims = {}
        for d in spec.get("dims", ()):
            name = d["fields"][0].lower()
            dims[name] = (d["fields"], load_dim(df, d["fields"], d.get("attrs", ()), source=table, **meta))
            write(dims[name][1], f"dim_{name}")
        if spec.get("facts"):
            write(load_facts(df, spec["facts"], dims), f"fact_{table}")
