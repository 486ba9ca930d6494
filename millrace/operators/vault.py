"""Sequential file update: hubs, satellites, links and mappings with versioned history.

`plan_changes` is a pure plan: one full outer join of a prepared batch with the current rows decides between
insert, update and delete. The loaders prepare batches; `Store` keeps history, current rows, change tables
and the process log as Parquet, written beside the old copy and then swapped.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.config import AppConfig, TableConfig
from millrace.functions.hashing import change_hash, entity_key
from millrace.model import OPEN_END, PROCESS_LOG
from millrace.sources.io import write_table

META = ("start_time", "end_time", "source", "process_type", "process_id", "process_date", "user_id", "rectype", "version")
HASH = "hashed_value"


@dataclass(frozen=True)
class Process:
    """Who loads what, and when: the time is fixed once for a load."""

    load_ts: dt.datetime
    source: str = ""
    process_type: str = ""
    process_id: str = ""
    user_id: str = ""

    @property
    def stamp(self) -> Column:
        return F.lit(self.load_ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


@dataclass(frozen=True)
class Batch:
    """How a source becomes rows of a table."""

    keys: tuple[str, ...] = ("entity_id",)
    projection: tuple[str, ...] = ()
    renames: dict[str, str] = field(default_factory=dict)
    valid_start: tuple[str, str] | None = None
    valid_end: tuple[str, str] | None = None


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key: the greatest valid start, then the least hash."""
    first = [F.desc_nulls_last("valid_start_time")] if "valid_start_time" in rows.columns else []
    order = W.partitionBy(*keys).orderBy(*first, HASH if HASH in rows.columns else F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def prepare(df: DataFrame, ids: dict[str, Column], batch: Batch, process: Process, extra: dict[str, Column] | None = None, key_columns: Sequence[str] = ()) -> DataFrame:
    """Projected, deduplicated and renamed rows with keys, hash and metadata; rows with a null key are refused.

    ids: the key columns; key_columns: source columns that are no attributes.
    """
    rows = df.select(*batch.projection) if batch.projection else df
    rows = rows.dropDuplicates().withColumns(ids)
    rows = rows.withColumns({k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null {k}"))).otherwise(F.col(k)) for k in ids})
    times = {name: F.try_to_timestamp(F.col(spec[0]).cast("string"), F.lit(spec[1])).cast("timestamp_ntz") for name, spec in (("valid_start_time", batch.valid_start), ("valid_end_time", batch.valid_end)) if spec}
    attributes = [c for c in rows.columns if c not in ids and c not in key_columns]
    rows = rows.withColumn(HASH, change_hash(attributes)).withColumns({**times, **(extra or {})}).withColumnsRenamed(batch.renames)
    return one_per_key(
        rows.withColumns({
            "start_time": process.stamp, "end_time": F.lit(OPEN_END).cast("timestamp_ntz"), "source": F.lit(process.source), "process_type": F.lit(process.process_type),
            "process_id": F.lit(process.process_id), "process_date": process.stamp.cast("date"), "user_id": F.lit(process.user_id),
        }),
        list(ids),
    )


def plan_changes(incoming: DataFrame, current: DataFrame | None, keys: Sequence[str], load_ts: Column, *, is_delta: bool, overwrite: bool = False, flag: Column | None = None, track_changes: bool = True) -> DataFrame:
    """Rows to be written: new and changed rows as I and U, deleted ones as D, with versions.

    A key whose current row is D counts as absent and comes back as I with the next version. Append mode gives
    a deleted row the next version; overwrite mode closes it in place, and gives for an update both the
    closed old row and the new one. flag marks rows of the batch that ask for deletion.
    """
    if is_delta and overwrite:
        raise ValueError("a delta can't overwrite")
    rows = incoming.withColumn("_flag", F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False))
    cols = [c for c in incoming.columns if c not in ("rectype", "version")]
    if current is None:
        first = rows.withColumns({"rectype": F.when(F.col("_flag"), "D").otherwise("I"), "version": F.lit(1)})
        return first.withColumn("end_time", F.when(F.col("_flag"), load_ts).otherwise(F.col("end_time"))).select(*cols, "rectype", "version")
    old = current.select(*keys, F.struct(*(c for c in current.columns)).alias("c"))
    new = rows.select(*keys, F.struct(*rows.columns).alias("i"))
    both = new.join(old, list(keys), "left" if is_delta else "full_outer")  # a delta says nothing of the keys it lacks
    live = F.col("c").isNotNull() & (F.col("c.rectype") != "D")
    here = F.col("i").isNotNull()
    asked = here & F.coalesce(F.col("i._flag"), F.lit(False))
    differs = ~F.col(f"i.{HASH}").eqNullSafe(F.col(f"c.{HASH}")) if track_changes else F.lit(False)
    kind = (
        F.when(asked & live, "D").when(asked & F.col("c").isNull(), "D").when(asked, None)
        .when(here & ~F.coalesce(live, F.lit(False)), "I").when(here & live & differs, "U")
        .when(~here & live & F.lit(not is_delta), "D")
    )
    both = both.withColumn("kind", kind).where("kind is not null")
    version = F.coalesce(F.col("c.version"), F.lit(0))
    gone = (F.col("kind") == "D") & F.col("c").isNotNull()

    def field_of(name: str) -> Column:
        if name not in current.columns:
            return F.col(f"i.`{name}`").alias(name)
        return F.when(gone, F.col(f"c.`{name}`")).otherwise(F.col(f"i.`{name}`")).alias(name)

    fresh = both.select(
        *(field_of(c) for c in cols if c != "end_time"),
        F.when(F.col("kind") == "D", load_ts).otherwise(F.col("i.end_time")).alias("end_time"),
        F.col("kind").alias("rectype"),
        F.when(gone & F.lit(overwrite), version).otherwise(version + 1).alias("version"),
    )
    if not overwrite:
        return fresh.select(*cols, "rectype", "version")
    closed = both.where("kind = 'U'").select(*(F.col(f"c.`{c}`").alias(c) if c in current.columns else F.lit(None).alias(c) for c in cols if c != "end_time"), load_ts.alias("end_time"), F.lit("U").alias("rectype"), version.alias("version"))
    return fresh.unionByName(closed).select(*cols, "rectype", "version")


def next_history(history: DataFrame | None, batch: DataFrame, keys: Sequence[str], overwrite: bool) -> DataFrame:
    """History after a batch; in overwrite mode the batch's versions replace those of history."""
    if history is None:
        return batch
    kept = history.join(batch.select(*keys, "version"), [*keys, "version"], "left_anti") if overwrite else history
    return kept.unionByName(batch, allowMissingColumns=True)


def next_current(current: DataFrame | None, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest version of each key, deleted ones included: the batch's where it has the key."""
    new = latest(batch, keys)
    if current is None:
        return new
    return current.join(batch.select(*keys).distinct(), list(keys), "left_anti").select(current.columns).unionByName(new, allowMissingColumns=True)


def latest(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest version of each key of a history."""
    order = W.partitionBy(*keys).orderBy(F.desc("version"))
    return history.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def load_counts() -> Column:
    """Counters of a batch: one pass over its record types."""
    return F.struct(*(F.count(F.when(F.col("rectype") == k, 1)).alias(n) for k, n in (("I", "inserts_count"), ("U", "updates_count"), ("D", "deletes_count"))))


class Store:
    """History and current rows of tables below a folder; the logs there, too, or in a database of the catalog."""

    def __init__(self, spark: SparkSession, base: str, catalog: str | None = None):
        self.spark, self.base, self.catalog = spark, base.rstrip("/"), catalog
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.base}/{name}"))

    def read(self, name: str) -> DataFrame | None:
        self._settle(name)
        return self.spark.read.parquet(f"{self.base}/{name}") if self.exists(name) else None

    def _settle(self, name: str) -> None:
        """Ends a swap that was cut off between its two renames."""
        if not self.exists(name) and self.exists(f"{name}.prev") and self.exists(f"{name}.next/_SUCCESS"):
            self._fs.rename(self._path(f"{self.base}/{name}.next"), self._path(f"{self.base}/{name}"))

    def replace(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
        """Writes beside the old copy, then swaps; the old copy stays as .prev."""
        at = f"{self.base}/{name}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{at}.next")
        if self.exists(name):
            self._fs.delete(self._path(f"{at}.prev"), True)
            self._fs.rename(self._path(at), self._path(f"{at}.prev"))
        self._fs.rename(self._path(f"{at}.next"), self._path(at))

    def read_current(self, table: str, keys: Sequence[str] = ("src_entity_id", "dst_entity_id")) -> DataFrame | None:
        """Current rows; from history where there is no current copy."""
        found = self.read(f"{table}/current.parquet")
        if found is None and (history := self.read(f"{table}/history.parquet")) is not None:
            found = latest(history, keys)
        return found

    def apply(self, table: str, batch: DataFrame, keys: Sequence[str], process: Process, read_count: int, distinct_count: int, *, overwrite: bool = False, partition_by: Sequence[str] = (), change_tables: bool = False, params: dict | None = None) -> DataFrame:
        """Writes a planned batch; returns its process-log row.

        The batch is staged whole, with what is needed to finish it. Should the driver be lost from then on, the
        next load of the table finishes the staged batch first, so no version is lost or written twice.
        """
        batch.write.mode("overwrite").parquet(f"{self.base}/{table}/batch.parquet")  # planned once; history and current read the result
        spec = {"keys": list(keys), "overwrite": overwrite, "partition_by": list(partition_by), "change_tables": change_tables, "read": read_count, "distinct": distinct_count, "params": params or {}, "process": {**process.__dict__, "load_ts": process.load_ts.isoformat()}}
        self._write_text(f"{table}/batch.json", json.dumps(spec, default=str))
        return self._finish(table, spec)

    def recover(self, table: str) -> DataFrame | None:
        """Finishes a staged batch of a load that was cut off; its process-log row."""
        if not self.exists(f"{table}/batch.json"):
            return None
        spec = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.base}/{table}/batch.json").collect()))
        return self._finish(table, spec, again=True)

    def _finish(self, table: str, spec: dict, again: bool = False) -> DataFrame:
        """Brings a staged batch into the tables; again: what an earlier try has written is not written twice."""
        keys, overwrite, partition_by = spec["keys"], spec["overwrite"], spec["partition_by"]
        process = Process(**{**spec["process"], "load_ts": dt.datetime.fromisoformat(spec["process"]["load_ts"])})
        batch = self.spark.read.parquet(f"{self.base}/{table}/batch.parquet")
        history, now = self.read(f"{table}/history.parquet"), self.read(f"{table}/current.parquet")
        if overwrite or history is None:
            self.replace(next_history(history, batch, keys, overwrite), f"{table}/history.parquet", partition_by)
        else:
            rows = batch.join(history.select(*keys, "version"), [*keys, "version"], "left_anti").select(batch.columns) if again else batch
            rows.write.mode("append").partitionBy(*partition_by).parquet(f"{self.base}/{table}/history.parquet")
        self.replace(next_current(now, batch, keys), f"{table}/current.parquet", partition_by)
        if not self.exists(f"{table}/meta.json"):
            self.write_meta(table, spec["params"])
        if spec["change_tables"]:
            for kind, name in (("I", "new"), ("U", "changed"), ("D", "removed")):
                self.write_changes(batch.where(F.col("rectype") == kind), f"{table}/{name}.parquet", process, keys=keys if again else ())
        n = batch.agg(load_counts().alias("c")).first()["c"]
        row = (process.process_id, process.process_type, process.user_id, spec["read"], spec["read"] - spec["distinct"], n["inserts_count"], n["updates_count"], n["deletes_count"], process.load_ts, process.load_ts.date())
        log = self.spark.createDataFrame([row], PROCESS_LOG)
        self._fs.delete(self._path(f"{self.base}/{table}/batch.json"), True)  # from here on the batch is done
        self.write_log(log)
        self._fs.delete(self._path(f"{self.base}/{table}/batch.parquet"), True)
        return log

    def write_log(self, log: DataFrame) -> None:
        if self.catalog:
            write_table(log, f"{self.catalog}.process_log", "parquet", mode="append")
        else:
            log.write.mode("append").parquet(f"{self.base}/process_log.parquet")

    def _write_text(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.base}/{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def write_changes(self, rows: DataFrame, name: str, process: Process, keep_days: int = 3, keys: Sequence[str] = ()) -> None:
        """Appends to a change table by process date and drops days older than keep_days; with keys only what it lacks."""
        if keys and self.exists(name):
            known = self.spark.read.schema(rows.schema).parquet(f"{self.base}/{name}").select(*keys, "version", "process_id")  # it may be empty
            rows = rows.join(known, [*keys, "version", "process_id"], "left_anti").select(rows.columns)
        rows.write.mode("append").partitionBy("process_date").parquet(f"{self.base}/{name}")
        oldest = (process.load_ts.date() - dt.timedelta(days=keep_days)).isoformat()
        for status in self._fs.listStatus(self._path(f"{self.base}/{name}")):
            part = status.getPath().getName()
            if part.startswith("process_date=") and part[13:] < oldest:
                self._fs.delete(status.getPath(), True)

    def write_meta(self, table: str, params: dict) -> None:
        """The parameters of a table's first load, as JSON; with a catalog also as rows of its meta_log."""
        self._write_text(f"{table}/meta.json", json.dumps(params, default=str))
        if self.catalog:
            rows = self.spark.createDataFrame([(table, k, str(v)) for k, v in params.items()], "table_name string, name string, value string")
            write_table(rows, f"{self.catalog}.meta_log", "parquet", mode="append")


class Loader:
    """Loads hubs, satellites, links and mappings into a store."""

    def __init__(self, store: Store):
        self.store = store

    def _load(self, table, df, rows, keys, process, is_delta, overwrite, delete_indicator, track_changes, partition_by=(), change_tables=False) -> DataFrame:
        flag = None
        if delete_indicator:
            flag = F.col(delete_indicator[0]).eqNullSafe(F.lit(delete_indicator[1]))
        self.store.recover(table)
        now = self.store.read_current(table, keys)
        batch = plan_changes(rows, now, keys, process.stamp, is_delta=is_delta, overwrite=overwrite, flag=flag, track_changes=track_changes)
        n = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("read"), F.count(F.lit(1)).alias("distinct")).first()
        return self.store.apply(table, batch, keys, process, n["read"] or 0, n["distinct"], overwrite=overwrite, partition_by=partition_by, change_tables=change_tables, params={"table": table, "is_delta": is_delta, "overwrite": overwrite, **process.__dict__})

    def hub(self, df: DataFrame, process: Process, entity_type: str, id_fields: Sequence[str], id_type: str, *, is_delta: bool = True, overwrite: bool = False, table: str | None = None, batch: Batch = Batch(), delete_indicator=None) -> DataFrame:
        """New and gone business keys; table <entity type>_hub."""
        ids = {"entity_id": entity_key(id_type, id_fields)}
        keep = [*id_fields, *([delete_indicator[0]] if delete_indicator else [])]
        rows = prepare(df.select(*dict.fromkeys([*keep, *(s[0] for s in (batch.valid_start, batch.valid_end) if s)])), ids, batch, process, {"entity_type": F.lit(entity_type), "id_type": F.lit(id_type)}, id_fields)
        return self._load(table or f"{entity_type.lower()}_hub", df, rows, ["entity_id"], process, is_delta, overwrite, delete_indicator, False, ("id_type",))

    def customers(self, df: DataFrame, process: Process, id_field: str, id_type: str, **more) -> DataFrame:
        return self.hub(df, process, "customer", [id_field], id_type, batch=Batch(renames={id_field: "customer_id"}), **more)

    def services(self, df: DataFrame, process: Process, id_field: str, id_type: str, **more) -> DataFrame:
        return self.hub(df, process, "service", [id_field], id_type, batch=Batch(renames={id_field: "service_id"}), **more)

    def satellite(self, df: DataFrame, process: Process, table: str, id_fields: Sequence[str], id_type: str, *, is_delta: bool = True, overwrite: bool = False, batch: Batch = Batch(), delete_indicator=None, partition_by: Sequence[str] = (), change_tables: bool = False) -> DataFrame:
        """Versions of the attributes of each key."""
        rows = prepare(df, {"entity_id": entity_key(id_type, id_fields)}, batch, process, key_columns=id_fields).drop(*id_fields)
        return self._load(table, df.select(*batch.projection) if batch.projection else df, rows, ["entity_id"], process, is_delta, overwrite, delete_indicator, True, partition_by, change_tables)

    def link(self, df: DataFrame, process: Process, src: tuple[str, Sequence[str], str], dst: tuple[str, Sequence[str], str], *, is_delta: bool = True, overwrite: bool = False, table: str | None = None, delete_indicator=None, extra: dict[str, Column] | None = None) -> DataFrame:
        """Pairs of keys; src and dst are (entity type, id fields, id type); table <src>_<dst>_link."""
        ids = {"src_entity_id": entity_key(src[2], src[1]), "dst_entity_id": entity_key(dst[2], dst[1])}
        used = [*src[1], *dst[1]]
        keep = [*used, *([delete_indicator[0]] if delete_indicator else [])]
        rows = prepare(df.select(*dict.fromkeys(keep)), ids, Batch(), process, {"src_entity_type": F.lit(src[0]), "dst_entity_type": F.lit(dst[0]), **(extra or {})}, used).drop(*used)
        return self._load(table or f"{src[0].lower()}_{dst[0].lower()}_link", df, rows, list(ids), process, is_delta, overwrite, delete_indicator, False)

    def mapping(self, df: DataFrame, process: Process, entity_type: str, src: tuple[Sequence[str], str], dst: tuple[Sequence[str], str], confidence: float = 1.0, *, is_delta: bool = True, overwrite: bool = False, table: str | None = None, delete_indicator=None) -> DataFrame:
        """Edges between identifiers with a confidence; src and dst are (id fields, id type); table <entity>_mapping."""
        ids = {"src_entity_id": entity_key(src[1], src[0]), "dst_entity_id": entity_key(dst[1], dst[0])}
        used = [*src[0], *dst[0]]
        keep = [*used, *([delete_indicator[0]] if delete_indicator else [])]
        extra = {"entity_type": F.lit(entity_type), "src_id_type": F.lit(src[1]), "dst_id_type": F.lit(dst[1]), "confidence": F.lit(float(confidence))}
        rows = prepare(df.select(*dict.fromkeys(keep)), ids, Batch(), process, extra, used).drop(*used)
        return self._load(table or f"{entity_type.lower()}_mapping", df, rows, list(ids), process, is_delta, overwrite, delete_indicator, False)

    def load_all(self, config: AppConfig, process: Process) -> list[DataFrame]:
        """Hubs, satellites, links and mappings of a configuration, in that order; their process-log rows."""
        return [self.load(t, process) for kind in ("hub", "satellite", "link", "mapping") for t in config.tables if t.kind == kind]

    def load(self, t: TableConfig, process: Process) -> DataFrame:
        """One configured table; sources with a slash are paths, others tables."""
        df = self.store.spark.read.load(t.source) if "/" in t.source else self.store.spark.table(t.source)
        how = {"is_delta": t.is_delta, "overwrite": t.overwrite, "delete_indicator": t.delete_indicator, "table": t.table_name}
        batch = Batch(projection=t.projection, renames=t.new_names, valid_start=t.valid_start_time, valid_end=t.valid_end_time)
        if t.kind == "hub":
            return self.hub(df, process, t.entity_type, t.id_fields, t.id_type, batch=Batch(renames=batch.renames, valid_start=batch.valid_start, valid_end=batch.valid_end), **how)
        if t.kind == "satellite":
            return self.satellite(df, process, how.pop("table"), t.id_fields, t.id_type, batch=batch, partition_by=t.partition_keys, change_tables=t.write_change_tables, **how)
        if t.kind == "link":
            return self.link(df, process, *((s["entity_type"], s["id_fields"], s["id_type"]) for s in (t.src, t.dst)), **how)
        return self.mapping(df, process, t.entity_type, *((s["id_fields"], s["id_type"]) for s in (t.src, t.dst)), t.confidence, **how)
