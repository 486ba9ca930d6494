"""Registered queries over the warehouse tables and their DuckDB equivalents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import dates, hashing, strings
from millrace.model import Feature
from millrace.operators import events as ev
from millrace.operators import features, quality, resolve, star, vault
from millrace.plans import pipeline, recipes
from millrace.plans.context import Context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-15 00:00:00"
LOAD = dt.datetime(2024, 2, 1)
KINDS = ("click", "error", "purchase", "signup", "view")
STORE = features.Registry([Feature(k) for k in KINDS])


def query(sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Registers a query; rounded: float columns whose last digits depend on the order of addition."""

    def register(f):
        def run(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.round(c, 8) for c in rounded})

        QUERIES[f.__name__] = run if rounded else f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, 8) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the form of the event model."""
    t = table(spark, sf_dir, "events")
    return t.select(F.md5(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("entity"), "event_type", "ts", F.col("value").cast("string").alias("value"), "event_id", F.lit(1).alias("version"))


def numeric_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), "event_type", "ts", "value", "event_id")


_EV = "ev AS (SELECT md5('user' || user_id) AS entity, event_type, ts, CAST(value AS VARCHAR) AS value, event_id, 1 AS version FROM events)"


# Scans, projections, sets ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_project_filter(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_dedup(spark, d):
    return table(spark, d, "events").select("event_type", "user_id").dropDuplicates()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey FROM customer")
def union_all(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, 'unknown') AS segment FROM customer")
def fill_unknown(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")).fillna("unknown")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


# Scalar functions ------------------------------------------------------------------------------------


@query("SELECT c_custkey, md5('Customer Number' || c_custkey) AS entity_id FROM customer")
def hash_entity_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.entity_key("Customer Number", ["c_custkey"]).alias("entity_id"))


@query("SELECT c_custkey, sha256(c_name) AS k FROM customer")
def sha256_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.sha256_key(F.col("c_name")).alias("k"))


@query(
    r"""SELECT p_partkey, regexp_replace(p_type, '\s+', '_', 'g') AS underscored, CAST((length(p_name) - length(replace(p_name, 'a', ''))) AS INTEGER) AS count_a,
    CASE WHEN p_brand IS NULL THEN '' ELSE replace(p_brand, '#', '') END AS camel FROM part"""
)
def string_functions(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", strings.underscore(F.col("p_type")).alias("underscored"), strings.count_substring(F.col("p_name"), "a").alias("count_a"), strings.camelize_column(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("camel"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders")
def date_format(spark, d):
    text = F.date_format("o_orderdate", "dd/MM/yyyy H:mm:ss")
    p = "dd/MM/yyyy HH:mm:ss"
    return table(spark, d, "orders").select("o_orderkey", dates.format_date(text, p).alias("d"), dates.format_date_time(text, p).alias("t"), dates.epoch_seconds(text, p).alias("s"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS b FROM orders"""
)
def parse_boolean(spark, d):
    k = F.col("o_orderkey") % 5
    word = F.when(k == 0, " Yes ").when(k == 1, "OFF").when(k == 2, "1").when(k == 3, "f").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", dates.parse_boolean(word).alias("b"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_date_multi(spark, d):
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "d MMM yyyy")).when(k == 2, F.concat(F.date_format(t, "EEE"), F.lit(", "), F.date_format(t, "MMM d, yyyy"))).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date(text).cast("date").alias("day"))


# Event analytics -------------------------------------------------------------------------------------


@query(f"WITH {_EV} SELECT entity, count(*) AS n FROM ev WHERE event_type = 'purchase' AND ts BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY 1")
def event_count_range(spark, d):
    return ev.count_events(event_rows(spark, d), ev.in_range("purchase", "2024-01-05 00:00:00", "2024-01-20 00:00:00"), ["entity"])


@query(f"WITH {_EV} SELECT entity, count(*) AS n FROM ev WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND '{AS_OF}' GROUP BY 1")
def event_count_lookback(spark, d):
    return ev.count_events(event_rows(spark, d), ev.look_back("click", AS_OF, "7 days"), ["entity"])


@query(f"WITH {_EV} SELECT entity, count(DISTINCT value) AS n FROM ev WHERE event_type = 'view' AND ts BETWEEN '2024-01-01' AND '{AS_OF}' GROUP BY 1")
def event_count_unique(spark, d):
    return ev.count_unique(event_rows(spark, d), ev.in_range("view", "2024-01-01 00:00:00", AS_OF), ["entity"])


@query("SELECT md5('user' || user_id) AS entity, round(sum(value), 6) AS total FROM events WHERE event_type = 'purchase' AND ts BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY user_id")
def event_sum(spark, d):
    return ev.sum_values(event_rows(spark, d), ev.in_range("purchase", "2024-01-01 00:00:00", "2024-01-31 00:00:00"), ["entity"]).withColumn("total", F.round("total", 6))


@query(f"WITH {_EV} SELECT entity, date_sub('day', max(ts) FILTER (WHERE event_type = 'error' AND ts <= '{AS_OF}'), TIMESTAMP '{AS_OF}') AS days FROM ev GROUP BY 1")
def days_since_latest(spark, d):
    return ev.days_since(event_rows(spark, d), "error", AS_OF, by=["entity"])


@query(f"WITH {_EV} SELECT entity, date_sub('day', min(ts) FILTER (WHERE event_type = 'error' AND ts <= '{AS_OF}'), TIMESTAMP '{AS_OF}') AS days FROM ev GROUP BY 1")
def days_since_earliest(spark, d):
    return ev.days_since(event_rows(spark, d), "error", AS_OF, latest=False, by=["entity"])


@query(
    f"""WITH {_EV}, v AS (SELECT * FROM ev UNION ALL SELECT entity, event_type, ts, value || 'x', event_id, 2 FROM ev WHERE event_id % 10 = 0)
    SELECT entity, event_type, ts, value, event_id, version FROM v QUALIFY row_number() OVER (PARTITION BY entity, event_type, ts ORDER BY version DESC) = 1"""
)
def current_events(spark, d):
    e = event_rows(spark, d)
    return ev.current(e.unionByName(e.where("event_id % 10 = 0").withColumns({"value": F.concat("value", F.lit("x")), "version": F.lit(2)})))


@query(f"WITH {_EV} SELECT entity, max(ts) FILTER (WHERE event_type = 'signup') AS chord FROM ev GROUP BY 1")
def extract_chords(spark, d):
    return ev.extract_chords(event_rows(spark, d), "signup")


_LATEST = ", ".join(f"max_by(value, ts) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS)


@query(f"WITH {_EV} SELECT entity, {_LATEST} FROM ev WHERE ts <= '{AS_OF}' GROUP BY 1")
def feature_snapshot(spark, d):
    return features.snapshot(event_rows(spark, d), AS_OF, STORE)


@query(
    f"""WITH {_EV}, s AS (SELECT *, max(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY entity) AS sync FROM ev WHERE ts <= '{AS_OF}')
    SELECT sync, entity, {_LATEST} FROM s WHERE ts <= sync GROUP BY 1, 2"""
)
def feature_chord(spark, d):
    return features.chord(event_rows(spark, d), "purchase", AS_OF, STORE)


_SESSIONS = f"""{_EV}, g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS n FROM ev WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
    ses AS (SELECT entity, event_id, ts, CAST(1 + sum(n) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session FROM g)"""


@query(f"WITH {_SESSIONS} SELECT entity, event_id, session FROM ses")
def sessionize(spark, d):
    return ev.sessionize(event_rows(spark, d), "12 hours").select("entity", "event_id", "session")


@query(f"WITH {_SESSIONS} SELECT entity, session, count(*) AS n, date_sub('second', min(ts), max(ts)) AS seconds FROM ses GROUP BY 1, 2")
def session_stats(spark, d):
    return recipes.session_stats(ev.sessionize(event_rows(spark, d), "12 hours"))


@query(f"WITH {_EV} SELECT entity, event_id, CAST(row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM ev WHERE ts <= '{AS_OF}' QUALIFY rank <= 5")
def interactions_topn(spark, d):
    return ev.previous_interactions(event_rows(spark, d), 5, AS_OF).select("entity", "event_id", "rank")


_CHORD = f"""{_EV}, c AS (SELECT *, max(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY entity) AS chord FROM ev WHERE ts <= '{AS_OF}'), u AS (SELECT * FROM c WHERE ts <= chord)"""


@query(
    f"""WITH {_CHORD}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS k FROM u), p AS (SELECT entity, string_agg(event_type, ',' ORDER BY ts, event_id) AS path FROM r WHERE k <= 4 GROUP BY 1)
    SELECT e.entity, coalesce(p.path, '') AS path FROM (SELECT DISTINCT entity FROM ev) e LEFT JOIN p USING (entity)"""
)
def interactions_chord(spark, d):
    return ev.chord_interactions(event_rows(spark, d), "purchase", 4, AS_OF).select("entity", strings.paths(F.col("path")).alias("path"))


_RUNS = f"""{_CHORD}, t AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM u WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)),
    i AS (SELECT *, sum(n) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM t),
    runs AS (SELECT entity, run, min(event_type) AS event_type, max(ts) AS ts, count(*) AS count FROM i GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY run DESC) AS k FROM runs QUALIFY k <= 3)"""


@query(f"WITH {_RUNS} SELECT entity, event_type, ts, count FROM best")
def interactions_unique(spark, d):
    found = ev.chord_unique_interactions(event_rows(spark, d), "purchase", 3, AS_OF)
    return found.select("entity", F.explode("path").alias("p")).select("entity", "p.event_type", "p.ts", "p.count")


@query(f"WITH {_RUNS} SELECT e.entity, coalesce(string_agg(event_type, ',' ORDER BY run), '') AS path FROM (SELECT DISTINCT entity FROM ev) e LEFT JOIN best USING (entity) GROUP BY 1")
def path_strings(spark, d):
    return ev.chord_unique_interactions(event_rows(spark, d), "purchase", 3, AS_OF).select("entity", strings.unique_paths(F.col("path")).alias("path"))


# Vault -----------------------------------------------------------------------------------------------

_PROCESS = vault.Process(LOAD, "crm", "load", "p1", "tester")
_BEFORE = vault.Process(LOAD - dt.timedelta(days=30), "crm", "load", "p0", "tester")


def _satellite(spark, d, process, rows):
    """Customer attributes as a prepared batch."""
    return vault.prepare(rows, {"entity_id": hashing.entity_key("Customer Number", ["c_custkey"])}, vault.Batch(renames={"c_nationkey": "nation"}), process, key_columns=["c_custkey"])


def _known(spark, d):
    rows = _satellite(spark, d, _BEFORE, table(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_nationkey", "c_mktsegment"))
    return rows.withColumns({"rectype": F.lit("I"), "version": F.lit(1)})


def _incoming(spark, d):
    t = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    return _satellite(spark, d, _PROCESS, t.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment"))


def _changes(spark, d, **more):
    return vault.plan_changes(_incoming(spark, d), _known(spark, d), ["entity_id"], _PROCESS.stamp, **({"is_delta": False} | more))


_SAT = """cur AS (SELECT c_custkey, md5('Customer Number' || c_custkey) AS entity_id, c_nationkey AS nation, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
    inc AS (SELECT c_custkey, md5('Customer Number' || c_custkey) AS entity_id, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0),
    ins AS (SELECT entity_id, nation, c_mktsegment, 'I' AS rectype, 1 AS version FROM inc WHERE entity_id NOT IN (SELECT entity_id FROM cur)),
    upd AS (SELECT i.entity_id, i.nation, i.c_mktsegment, 'U' AS rectype, 2 AS version, c.nation AS old FROM inc i JOIN cur c USING (entity_id) WHERE i.nation IS DISTINCT FROM c.nation),
    del AS (SELECT entity_id, nation, c_mktsegment, 'D' AS rectype, 2 AS version FROM cur WHERE entity_id NOT IN (SELECT entity_id FROM inc))"""
_SAT_COLS = ["entity_id", "nation", "c_mktsegment", "rectype", "version"]


@query(f"WITH {_SAT} SELECT * FROM ins")
def sat_inserts(spark, d):
    return _changes(spark, d).where("rectype = 'I'").select(_SAT_COLS)


@query(f"WITH {_SAT} SELECT * EXCLUDE (old) FROM upd")
def sat_updates(spark, d):
    return _changes(spark, d).where("rectype = 'U'").select(_SAT_COLS)


@query(f"WITH {_SAT} SELECT *, TIMESTAMP '2024-02-01' AS end_time FROM del")
def sat_deletes_full(spark, d):
    return _changes(spark, d).where("rectype = 'D'").select(*_SAT_COLS, "end_time")


@query(
    f"""WITH {_SAT} SELECT c.entity_id, c.nation, c.c_mktsegment, 'D' AS rectype, 2 AS version FROM cur c JOIN inc i USING (entity_id) WHERE i.c_mktsegment = 'BUILDING'
    UNION ALL SELECT entity_id, nation, c_mktsegment, 'D', 1 FROM inc WHERE entity_id NOT IN (SELECT entity_id FROM cur) AND c_mktsegment = 'BUILDING'"""
)
def sat_flagged_deletes(spark, d):
    return _changes(spark, d, is_delta=True, flag=F.col("c_mktsegment") == "BUILDING").where("rectype = 'D'").select(_SAT_COLS)


_OPEN = "TIMESTAMP '9999-12-31'"


@query(
    f"""WITH {_SAT} SELECT entity_id, nation, 'I' AS rectype, 1 AS version, {_OPEN} AS end_time FROM cur UNION ALL SELECT entity_id, nation, rectype, version, {_OPEN} FROM ins
    UNION ALL SELECT entity_id, nation, rectype, version, {_OPEN} FROM upd UNION ALL SELECT entity_id, nation, rectype, version, TIMESTAMP '2024-02-01' FROM del"""
)
def sat_history_append(spark, d):
    return vault.next_history(_known(spark, d), _changes(spark, d), ["entity_id"], False).select("entity_id", "nation", "rectype", "version", "end_time")


@query(
    f"""WITH {_SAT} SELECT entity_id, nation, 'I' AS rectype, 1 AS version, {_OPEN} AS end_time FROM cur WHERE entity_id NOT IN (SELECT entity_id FROM upd) AND entity_id NOT IN (SELECT entity_id FROM del)
    UNION ALL SELECT entity_id, nation, rectype, version, {_OPEN} FROM ins UNION ALL SELECT entity_id, nation, rectype, version, {_OPEN} FROM upd
    UNION ALL SELECT entity_id, old, 'U', 1, TIMESTAMP '2024-02-01' FROM upd UNION ALL SELECT entity_id, nation, 'D', 1, TIMESTAMP '2024-02-01' FROM del"""
)
def sat_history_overwrite(spark, d):
    return vault.next_history(_known(spark, d), _changes(spark, d, overwrite=True), ["entity_id"], True).select("entity_id", "nation", "rectype", "version", "end_time")


@query(
    f"""WITH {_SAT}, a AS (SELECT entity_id, nation, c_mktsegment, 'I' AS rectype, 1 AS version FROM cur UNION ALL SELECT * FROM ins UNION ALL SELECT * EXCLUDE (old) FROM upd UNION ALL SELECT * FROM del)
    SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) = 1"""
)
def sat_current(spark, d):
    return vault.next_current(_known(spark, d), _changes(spark, d), ["entity_id"]).select(_SAT_COLS)


@query(f"WITH {_SAT} SELECT (SELECT count(*) FROM ins) AS inserts_count, (SELECT count(*) FROM upd) AS updates_count, (SELECT count(*) FROM del) AS deletes_count")
def load_counters(spark, d):
    return _changes(spark, d).agg(vault.load_counts().alias("c")).select("c.*")


def _hub(spark, d, process, where):
    rows = table(spark, d, "customer").where(where).select("c_custkey")
    return vault.prepare(rows, {"entity_id": hashing.entity_key("Customer Number", ["c_custkey"])}, vault.Batch(renames={"c_custkey": "customer_id"}), process, {"entity_type": F.lit("customer"), "id_type": F.lit("Customer Number")}, ["c_custkey"])


_HUB_COLS = ["entity_id", "entity_type", "customer_id", "id_type", "source", "rectype", "version"]
_HUB_SQL = "md5('Customer Number' || c_custkey) AS entity_id, 'customer' AS entity_type, c_custkey AS customer_id, 'Customer Number' AS id_type, 'crm' AS source"


@query(f"SELECT {_HUB_SQL}, 'I' AS rectype, 1 AS version FROM customer")
def hub_initial(spark, d):
    return vault.plan_changes(_hub(spark, d, _PROCESS, "true"), None, ["entity_id"], _PROCESS.stamp, is_delta=True).select(_HUB_COLS)


def _hub_changes(spark, d, is_delta):
    known = _hub(spark, d, _BEFORE, "c_custkey % 10 <> 0").withColumns({"rectype": F.lit("I"), "version": F.lit(1)})
    return vault.plan_changes(_hub(spark, d, _PROCESS, "c_custkey % 7 <> 0"), known, ["entity_id"], _PROCESS.stamp, is_delta=is_delta, track_changes=False).select(_HUB_COLS)


@query(f"SELECT {_HUB_SQL}, 'I' AS rectype, 1 AS version FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 = 0")
def hub_new_entities(spark, d):
    return _hub_changes(spark, d, True)


@query(f"SELECT {_HUB_SQL}, 'D' AS rectype, 2 AS version FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 10 <> 0")
def hub_deletes(spark, d):
    return _hub_changes(spark, d, False).where("rectype = 'D'")


_LINK = "md5('Order Number' || o_orderkey) AS src_entity_id, md5('Customer Number' || o_custkey) AS dst_entity_id"


@query(f"SELECT DISTINCT {_LINK}, 'order' AS src_entity_type, 'customer' AS dst_entity_type, 'I' AS rectype, 1 AS version FROM orders")
def link_load(spark, d):
    ids = {"src_entity_id": hashing.entity_key("Order Number", ["o_orderkey"]), "dst_entity_id": hashing.entity_key("Customer Number", ["o_custkey"])}
    rows = vault.prepare(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, vault.Batch(), _PROCESS, {"src_entity_type": F.lit("order"), "dst_entity_type": F.lit("customer")}, ["o_orderkey", "o_custkey"])
    return vault.plan_changes(rows, None, list(ids), _PROCESS.stamp, is_delta=True).select(*ids, "src_entity_type", "dst_entity_type", "rectype", "version")


def _mapping(spark, d):
    ids = {"src_entity_id": hashing.entity_key("Customer Number", ["c_custkey"]), "dst_entity_id": hashing.entity_key("name", ["c_name"])}
    extra = {"entity_type": F.lit("customer"), "src_id_type": F.lit("Customer Number"), "dst_id_type": F.lit("name"), "confidence": F.lit(0.9)}
    return vault.prepare(table(spark, d, "customer").select("c_custkey", "c_name"), ids, vault.Batch(), _PROCESS, extra, ["c_custkey", "c_name"])


_MAP = "md5('Customer Number' || c_custkey) AS src_entity_id, md5('name' || c_name) AS dst_entity_id, 'customer' AS entity_type, 'Customer Number' AS src_id_type, 'name' AS dst_id_type, CAST(0.9 AS DOUBLE) AS confidence"


@query(f"SELECT {_MAP}, 'I' AS rectype, 1 AS version FROM customer")
def mapping_load(spark, d):
    rows = vault.plan_changes(_mapping(spark, d), None, ["src_entity_id", "dst_entity_id"], _PROCESS.stamp, is_delta=True)
    return rows.select("src_entity_id", "dst_entity_id", "entity_type", "src_id_type", "dst_id_type", "confidence", "rectype", "version")


@query(f"SELECT {_MAP}, CASE WHEN c_custkey % 4 = 0 THEN 'U' ELSE 'I' END AS rectype, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def mapping_latest(spark, d):
    base = _mapping(spark, d).withColumns({"rectype": F.lit("I"), "version": F.lit(1)})
    again = table(spark, d, "customer").where("c_custkey % 4 = 0").select(hashing.entity_key("Customer Number", ["c_custkey"]).alias("src_entity_id"))
    both = base.unionByName(base.join(again, "src_entity_id", "left_semi").withColumns({"rectype": F.lit("U"), "version": F.lit(2)}))
    return vault.latest(both, ["src_entity_id", "dst_entity_id"]).select("src_entity_id", "dst_entity_id", "entity_type", "src_id_type", "dst_id_type", "confidence", "rectype", "version")


@query("SELECT c.c_custkey, md5('Customer Number' || c.c_custkey) AS entity_id, c.c_mktsegment FROM customer c WHERE c_custkey % 10 <> 0")
def sat_join_hub(spark, d):
    return _known(spark, d).select("entity_id", "c_mktsegment").join(_hub(spark, d, _PROCESS, "true").select("entity_id", F.col("customer_id").alias("c_custkey")), "entity_id").select("c_custkey", "entity_id", "c_mktsegment")


@query(
    """WITH RECURSIVE m AS (
      SELECT 'o' || o_orderkey AS a, 'order' AS ta, 'c' || o_custkey AS b, 'customer' AS tb, CASE WHEN o_orderkey % 9 = 0 THEN 0.5 ELSE 1.0 END AS conf FROM orders
      UNION ALL SELECT 'c' || c_custkey, 'customer', 'n' || c_nationkey, 'nation', CASE WHEN c_custkey % 4 = 0 THEN 0.5 ELSE 1.0 END FROM customer),
    e AS (SELECT a, b FROM m WHERE conf >= 1.0 UNION SELECT b, a FROM m WHERE conf >= 1.0),
    v AS (SELECT a AS id, ta AS t FROM m UNION SELECT b, tb FROM m),
    w(id, target_id, hops) AS (SELECT id, id, 0 FROM v WHERE t = 'nation' UNION SELECT e.b, w.target_id, w.hops + 1 FROM w JOIN e ON e.a = w.id WHERE w.hops < 2)
    SELECT v.id, r.target_id FROM v LEFT JOIN (SELECT id, arg_min(target_id, (hops, target_id)) AS target_id FROM w GROUP BY 1) r USING (id)"""
)
def resolve_entities(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.selectExpr("concat('o', o_orderkey) src_entity_id", "'order' src_id_type", "concat('c', o_custkey) dst_entity_id", "'customer' dst_id_type", "case when o_orderkey % 9 = 0 then 0.5d else 1.0d end confidence")
    m = m.unionByName(c.selectExpr("concat('c', c_custkey) src_entity_id", "'customer' src_id_type", "concat('n', c_nationkey) dst_entity_id", "'nation' dst_id_type", "case when c_custkey % 4 = 0 then 0.5d else 1.0d end confidence"))
    return resolve.map_entities(resolve.vertices(m), "id", m, "nation", "target_id").select("id", "target_id")


# Star ------------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderpriority, md5(o_orderpriority) AS hashed_key, row_number() OVER (ORDER BY md5(o_orderpriority)) AS id FROM (SELECT DISTINCT o_orderpriority FROM orders)
    UNION ALL SELECT 'unknown', md5('unknown'), -1"""
)
def dim_members(spark, d):
    return star.load_dim(table(spark, d, "orders"), ["o_orderpriority"]).select("o_orderpriority", "hashed_key", "id")


def _dim_rows(spark, d, step):
    c = table(spark, d, "customer")
    if step == 0:
        return c.where("c_custkey % 10 <> 0").select("c_name", "c_mktsegment")
    return c.select("c_name", F.when(F.col("c_custkey") % 5 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


@query(
    """WITH a AS (SELECT *, c_custkey % 10 <> 0 AS known, c_custkey % 5 = 0 AS moved FROM customer)
    SELECT c_name, c_mktsegment, 'I' AS rectype, 1 AS version, CASE WHEN moved THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '9999-12-31' END AS end_time FROM a WHERE known
    UNION ALL SELECT c_name, 'MOVED', 'U', 2, TIMESTAMP '9999-12-31' FROM a WHERE known AND moved
    UNION ALL SELECT c_name, CASE WHEN moved THEN 'MOVED' ELSE c_mktsegment END, 'I', 1, TIMESTAMP '9999-12-31' FROM a WHERE NOT known
    UNION ALL SELECT 'unknown', 'unknown', 'I', 1, TIMESTAMP '9999-12-31'"""
)
def dim_scd2(spark, d):
    first = star.load_dim(_dim_rows(spark, d, 0), ["c_name"], ["c_mktsegment"], load_ts="2024-01-01 00:00:00")
    return star.load_dim(_dim_rows(spark, d, 1), ["c_name"], ["c_mktsegment"], first, load_ts="2024-02-01 00:00:00").select("c_name", "c_mktsegment", "rectype", "version", "end_time")


@query(
    """WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY md5(o_orderpriority)) AS id FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'))
    SELECT o_orderkey, o_totalprice, coalesce(p.id, -1) AS fk_priority FROM orders LEFT JOIN p USING (o_orderpriority)"""
)
def fact_fk_lookup(spark, d):
    o = table(spark, d, "orders")
    dim = star.load_dim(o.where("o_orderpriority <> '5-LOW'"), ["o_orderpriority"])
    return star.load_facts(o, ["o_orderkey", "o_totalprice"], {"priority": (["o_orderpriority"], dim)})


# Pipelines -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS doubled, CASE WHEN o_totalprice * 2 > 200000 THEN 'big' ELSE 'small' END AS size FROM orders")
def pipeline_rows(spark, d):
    double = pipeline.ColumnTransformation("double", "doubled", "o_totalprice * 2")
    size = pipeline.ColumnTransformation("size", "size", "case when doubled > 200000 then 'big' else 'small' end", [double])
    return pipeline.RowPipeline("rows").add(size, double)(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), Context())


@query("SELECT r_regionkey, upper(r_name) AS name, CAST(length(r_name) AS INTEGER) AS n FROM region")
def pipeline_python_rows(spark, d):
    upper = pipeline.RowTransformation("upper", lambda row, ctx: type(row)(**{**row.asDict(), "name": row["name"].upper()}))
    size = pipeline.AppendColumn("size", "n", T.IntegerType(), lambda row, ctx: len(row["name"]), [upper])
    rows = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"))
    return pipeline.RowPipeline("python rows").add(size, upper)(rows, Context()).drop(pipeline.ERRORS)


@query("SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1", rounded=("total",))
def pipeline_tables(spark, d):
    keep = pipeline.TableTransformation("keep", lambda df, ctx: df.where(F.col("o_orderstatus") == ctx["status"]))
    total = pipeline.SQLTable("total", "t", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM t GROUP BY 1", [keep])
    many = pipeline.SQLTable("many", "t2", "SELECT * FROM t2 WHERE n > ${least}", [total])
    return pipeline.TablePipeline("tables").add(many, total, keep)(table(spark, d, "orders"), Context(status="O", sqlparams={"least": 1}))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1")
def named_sql(spark, d):
    table(spark, d, "events").createOrReplaceTempView("millrace_events")
    return pipeline.run_sql(spark, "SELECT event_type, count(*) AS n\nFROM $mytable\nWHERE event_type <> '${leftOut}' GROUP BY 1", strings.parameterize({"mytable": "millrace_events", "left-out": "view"}))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def pipeline_join(spark, d):
    return pipeline.join_sources(table(spark, d, "orders"), table(spark, d, "customer"), ["o_custkey"], ["c_custkey"]).select("o_orderkey", "c_name")


# Data quality ----------------------------------------------------------------------------------------

_RULES = [
    {"query": "l_quantity <= 45", "description": "quantity", "threshold": 0.05},
    {"query": "l_discount < 0.09 and l_tax >= 0", "description": "discount", "threshold": 0.5},
]


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_quantity <= 45, false) OR NOT coalesce(l_discount < 0.09 AND l_tax >= 0, false)")
def dq_assertion_invalid(spark, d):
    return quality.invalid_rows(table(spark, d, "lineitem"), _RULES).select("l_orderkey", "l_linenumber")


@query(
    """WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE NOT coalesce(l_quantity <= 45, false)) AS a, count(*) FILTER (WHERE NOT coalesce(l_discount < 0.09 AND l_tax >= 0, false)) AS b FROM lineitem)
    SELECT 'quantity' AS description, CAST(0.05 AS DOUBLE) AS threshold, total, a AS invalid, a / total AS fraction, a / total <= 0.05 AS passed FROM t
    UNION ALL SELECT 'discount', 0.5, total, b, b / total, b / total <= 0.5 FROM t""", rounded=("fraction",))
def dq_assertion_report(spark, d):
    return quality.report(table(spark, d, "lineitem"), _RULES)


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN -1.0 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 17 <> 0)
    SELECT coalesce(a.k, b.k) AS o_orderkey, a.p AS old_p, b.p AS new_p, CASE WHEN b.k IS NULL THEN 'only_old' WHEN a.k IS NULL THEN 'only_new' ELSE 'differs' END AS status
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p IS DISTINCT FROM b.p"""
)
def dq_diff(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.col("o_totalprice").alias("p"))
    b = o.where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 13 == 0, -1.0).otherwise(F.col("o_totalprice")).alias("p"))
    return quality.diff(a, b, [("o_orderkey", "k")], [("p", "p")], ("old", "new"))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def dq_view(spark, d):
    return quality.view(spark, "SELECT n_name, count(*) AS customers FROM c JOIN n ON c_nationkey = n_nationkey GROUP BY 1", {"c": table(spark, d, "customer"), "n": table(spark, d, "nation")})


# Recipes ---------------------------------------------------------------------------------------------

_END = "1998-08-01 00:00:00"


def _spend(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"))


def _items(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_extendedprice")
    return i.join(o, "o_orderkey").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), F.col("l_extendedprice").alias("amount"), F.col("l_partkey").alias("sku"), F.col("o_orderkey").alias("cart"))


_SPEND = "sp AS (SELECT o_custkey AS entity, o_orderdate AS ts, o_totalprice AS amount FROM orders)"
_ITEMS = "it AS (SELECT o_custkey AS entity, o_orderdate AS ts, l_extendedprice AS amount, l_partkey AS sku, o_orderkey AS cart FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    f"""WITH {_SPEND}, dd AS (SELECT entity, date_trunc('day', ts) AS d, sum(amount) AS s FROM sp WHERE ts >= TIMESTAMP '{_END}' - INTERVAL 84 DAY AND ts < '{_END}' GROUP BY 1, 2),
    w AS (SELECT entity, date_trunc('week', d) AS w, max(s) AS m FROM dd GROUP BY 1, 2) SELECT entity, avg(m) AS weekly_avg_max FROM w GROUP BY 1""", rounded=("weekly_avg_max",))
def recipe_weekly_avg_max(spark, d):
    return recipes.weekly_average_of_daily_max(_spend(spark, d), _END)


@query(
    f"""WITH {_SPEND}, x AS (SELECT entity, sum(CASE WHEN ts >= TIMESTAMP '{_END}' - INTERVAL 42 DAY THEN amount ELSE 0 END) AS last, sum(CASE WHEN ts < TIMESTAMP '{_END}' - INTERVAL 42 DAY THEN amount ELSE 0 END) AS prior
    FROM sp WHERE ts >= TIMESTAMP '{_END}' - INTERVAL 84 DAY AND ts < '{_END}' GROUP BY 1) SELECT entity, last, prior, last < 0.6 * prior AS lapsing FROM x""", rounded=("last", "prior"))
def recipe_lapsing(spark, d):
    return recipes.lapsing(_spend(spark, d), _END)


@query(f"WITH {_ITEMS} SELECT entity, sum(amount) AS spend, count(sku) AS skus, count(DISTINCT sku) AS distinct_skus, count(DISTINCT cart) AS carts FROM it WHERE ts >= TIMESTAMP '{_END}' - INTERVAL 364 DAY AND ts < '{_END}' GROUP BY 1", rounded=("spend",))
def recipe_yearly(spark, d):
    return recipes.yearly(_items(spark, d), _END)


@query(
    f"""WITH {_SPEND}, m AS (SELECT entity, avg(s) AS avg_monthly FROM (SELECT entity, date_trunc('month', ts) AS p, sum(amount) AS s FROM sp GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT entity, min(s) AS min_weekly FROM (SELECT entity, date_trunc('week', ts) AS p, sum(amount) AS s FROM sp GROUP BY 1, 2) GROUP BY 1)
    SELECT entity, avg(amount) AS avg_transaction, max(amount) AS max_spend, any_value(avg_monthly) AS avg_monthly, any_value(min_weekly) AS min_weekly FROM sp JOIN m USING (entity) JOIN w USING (entity) GROUP BY 1""", rounded=("avg_transaction", "avg_monthly", "min_weekly"))
def recipe_spend_profile(spark, d):
    return recipes.spend_profile(_spend(spark, d))


@query(
    f"""WITH {_ITEMS}, m AS (SELECT sku, median(s) AS median_monthly FROM (SELECT sku, date_trunc('month', ts) AS p, sum(amount) AS s FROM it GROUP BY 1, 2) GROUP BY 1)
    SELECT sku, count(*) AS purchases, avg(amount) AS avg_amount, sum(amount) AS total, max(amount) AS max_amount, date_sub('day', min(ts), max(ts)) / count(*) AS interval_days, any_value(median_monthly) AS median_monthly FROM it JOIN m USING (sku) GROUP BY 1""", rounded=("avg_amount", "total", "interval_days", "median_monthly"))
def recipe_ipi(spark, d):
    return recipes.item_purchases(_items(spark, d))


@query(f"WITH {_ITEMS} SELECT entity, p_brand AS category, count(*) AS n FROM it JOIN part ON sku = p_partkey WHERE ts >= TIMESTAMP '{_END}' - INTERVAL 84 DAY AND ts < '{_END}' GROUP BY 1, 2 HAVING count(*) >= 2")
def recipe_repeated_category(spark, d):
    items = _items(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.col("p_brand").alias("category")), "sku")
    return recipes.repeated_category(items, _END, 12)


@query("SELECT user_id AS entity, sum(value) AS total, " + ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN value ELSE 0 END) AS {k}_total, sum(CASE WHEN event_type = '{k}' THEN value ELSE 0 END) / sum(value) AS {k}_share" for k in ("click", "view")) + " FROM events GROUP BY 1", rounded=("total", "click_total", "click_share", "view_total", "view_share"))
def recipe_proportion(spark, d):
    return recipes.proportions(numeric_events(spark, d), ["click", "view"])


@query("SELECT entity, regr_slope(s, w) AS slope FROM (SELECT user_id AS entity, floor(date_sub('day', TIMESTAMP '2024-01-01', ts) / 7) AS w, sum(value) AS s FROM events GROUP BY 1, 2) GROUP BY 1", rounded=("slope",))
def recipe_gradient(spark, d):
    return recipes.gradient(numeric_events(spark, d), "2024-01-01 00:00:00")


_WE = "dayofweek(ts) IN (0, 6)"


@query(
    f"""SELECT user_id AS entity, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) FILTER (WHERE hour(ts) BETWEEN 6 AND 11) AS mornings,
    count(*) FILTER (WHERE {_WE}) / nullif(count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE {_WE}), 0) AS per_weekend_day, count(*) FILTER (WHERE NOT {_WE}) / nullif(count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE NOT {_WE}), 0) AS per_weekday FROM events GROUP BY 1""", rounded=("per_weekend_day", "per_weekday"))
def recipe_daypart(spark, d):
    return recipes.day_parts(numeric_events(spark, d))


@query("SELECT entity, max(n) AS max_daily, quantile_cont(n, 0.1) AS low_daily FROM (SELECT user_id AS entity, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1", rounded=("low_daily",))
def recipe_quantile(spark, d):
    return recipes.daily_extremes(numeric_events(spark, d))


@query("SELECT entity, avg(n) AS days_per_month FROM (SELECT user_id AS entity, date_trunc('month', ts) AS m, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1, 2) GROUP BY 1", rounded=("days_per_month",))
def recipe_days_per_month(spark, d):
    return recipes.days_per_month(numeric_events(spark, d))


@query(
    f"""SELECT user_id AS entity, date_sub('day', max(ts) FILTER (WHERE event_type = 'error' AND ts <= '{AS_OF}'), TIMESTAMP '{AS_OF}') AS days,
    CAST(floor(date_sub('day', max(ts) FILTER (WHERE event_type = 'purchase' AND ts <= '{AS_OF}'), TIMESTAMP '{AS_OF}') / 7) AS BIGINT) AS weeks FROM events GROUP BY 1"""
)
def recipe_time_since(spark, d):
    return recipes.time_since(numeric_events(spark, d), AS_OF, "error", "purchase")
