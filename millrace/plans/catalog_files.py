"""Registered queries over sources, sinks, file layouts, loads end to end and pipelines with files.

What they write goes below the shared folder; small resources such as SQL files are the driver's own.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import AppConfig
from millrace.functions import bounded, dates, hashing, strings
from millrace.model import Feature
from millrace.operators import features, quality, resolve, scoring, star, vault
from millrace.plans import pipeline
from millrace.plans.catalog import query, table
from millrace.plans.context import Context
from millrace.session import scratch
from millrace.sources import io, repositories, sniffer

KEEP = pipeline.TablePipeline("copy")


def resource(name: str, text: str) -> str:
    """A small file on the driver."""
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def view(spark: SparkSession, d: str, name: str) -> str:
    table(spark, d, name).createOrReplaceTempView(f"millrace_{name}")
    return f"millrace_{name}"


# Sources and sinks -----------------------------------------------------------------------------------


@query("SELECT * FROM customer")
def csv_round_trip(spark, d):
    out, schema = scratch(spark, "csv"), table(spark, d, "customer").schema
    KEEP.run(spark, io.ParquetSource(), io.CSVSink(), Context(in_path=f"{d}/customer.parquet", out_path=out, header="true"))
    return io.CSVSource()(spark, Context(in_path=out, header="true", schema=schema))


@query("SELECT * FROM orders WHERE o_totalprice > 1000")
def parquet_round_trip(spark, d):
    out = scratch(spark, "parquet")
    big = pipeline.TablePipeline("big").add(pipeline.TableTransformation("big", lambda df, ctx: df.where(F.col("o_totalprice") > ctx["least"])))
    big.run(spark, io.ParquetSource(), io.ParquetSink(), Context(in_path=f"{d}/orders.parquet", out_path=out, least=1000))
    return io.ParquetSource()(spark, Context(in_path=out))


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey >= 1")
def sql_source(spark, d):
    return io.SQLSource()(spark, Context(sql="SELECT n_name, n_regionkey FROM $t WHERE n_regionkey >= ${least}", sqlparams={"t": view(spark, d, "nation"), "least": 1}))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sql_file_source(spark, d):
    return io.SQLFileSource()(spark, Context(filename=resource("q.sql", "SELECT event_type, count(*) AS n\nFROM ${t} GROUP BY 1"), sqlparams={"t": view(spark, d, "events")}))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def named_sql_source(spark, d):
    params = {"c": view(spark, d, "customer"), "o": view(spark, d, "orders")}
    one = resource("q.properties", "# counts\nsegments=SELECT c_mktsegment, count(*) AS n \\\n  FROM $c GROUP BY 1\n")
    two = resource("q.xml", '<properties><entry key="states">SELECT o_orderstatus, count(*) AS n FROM $o GROUP BY 1</entry></properties>')
    return io.NamedSQLSource()(spark, Context(propsPath=one, name="segments", sqlparams=params)).union(io.NamedSQLSource()(spark, Context(propsPath=two, name="states", sqlparams=params)))


@query("SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_size, p_retailprice FROM part")
def star_csv_reader(spark, d):
    out = scratch(spark, "star-csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(out)
    return io.read_csv(spark, out)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def catalog_table(spark, d):
    io.write_table(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "millrace_suppliers", "orc", scratch(spark, "suppliers"), single_file=True)
    return spark.table("millrace_suppliers")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS line_no, n_name || ' ' || n_regionkey AS line FROM nation")
def ebcdic_lines(spark, d):
    out = scratch(spark, "ebcdic")

    def encoded(batches):
        for x in batches:
            yield x.assign(value=x["value"].map(lambda t: t.encode("cp500")))

    rows = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat_ws(" ", "n_name", "n_regionkey").cast("binary").alias("value"))
    text = rows.select(F.col("value").cast("string").alias("value")).mapInPandas(encoded, "value binary")
    text.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "%").text(out)  # line feed in this code page
    return io.read_ebcdic(spark, out).select(F.col("line_no").cast("long").alias("line_no"), "line")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def prepared_keys(spark, d):
    raw, out = scratch(spark, "raw"), scratch(spark, "prepared")
    table(spark, d, "customer").select("c_custkey", "c_nationkey").write.option("header", True).csv(raw)
    io.prepare_keys(io.read_csv(spark, raw), "c_custkey").write.parquet(out)
    return spark.read.parquet(out)


@query("SELECT 'a;b' AS head, 3 AS n")
def sampled_text(spark, d):
    head = io.read_sample(resource("s.txt", "a;b\n1;2\n"), 3)
    return spark.createDataFrame([(head, len(head))], "head string, n int")


# Layout of files -------------------------------------------------------------------------------------

_SAMPLES = {
    "commas": 'id,name,note\n1,foo,"a, b"\n2,bar,"c, d"\n',
    "tabs": "id\tname\tn\r\n1\tfoo\t2.5\r\n2\tbar\t3.5\r\n",
    "semicolons": "1;2;3\n4;5;6\n7;8;9\n",
    "pipes": "k|day\n1|2016-01-02\n2|2016-01-03\n",
}


@query("SELECT * FROM (VALUES ('commas', ',', '\"', true, 'minimal', 3), ('tabs', chr(9), '\"', true, 'none', 3), ('semicolons', ';', '\"', false, 'none', 3), ('pipes', '|', '\"', true, 'none', 3)) t(sample, delimiter, quote, header, quoting, lines)")
def sniffed_layouts(spark, d):
    rows = []
    for name, text in _SAMPLES.items():
        meta, lines = sniffer.sniff(text)
        known = json.loads(meta.to_json())
        rows.append((name, known["column_delimiter"], known["text_qualifier"], known["header"], known["quoting"], len(lines)))
    return spark.createDataFrame(rows, "sample string, delimiter string, quote string, header boolean, quoting string, lines int")


_TEXTS = {"12": "Integer", "-3.5": "Numeric", "007": "String", "2016-01-02": "Date", "yes": "Boolean", "": "None", "abc": "String", "1e5": "Numeric"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', {len(t)}, {str(k in ('Integer', 'Numeric') or t == '007').lower()})" for t, k in _TEXTS.items()) + ") t(value, kind, length, number)")
def value_types(spark, d):
    return spark.createDataFrame([(t, *sniffer.typed_length(t), strings.is_number(t)) for t in _TEXTS], "value string, kind string, length int, number boolean")


@query("SELECT CAST(avg(length(n_name)) AS DOUBLE) AS mean, var_pop(length(n_name)) AS variance, stddev_pop(length(n_name)) AS deviation FROM nation", rounded=("mean", "variance", "deviation"))
def line_statistics(spark, d):
    lines = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]  # a sample of a file
    return spark.createDataFrame([sniffer.line_statistics(lines)], "mean double, variance double, deviation double")


@query("SELECT 'wk 7 2016' AS value, 'String' AS before, 'Date' AS after")
def own_date_formats(spark, d):
    before = sniffer.value_type("wk 7 2016")
    sniffer.set_date_formats([r"wk \d+ \d{4}"])
    after = sniffer.value_type("wk 7 2016")
    sniffer.set_date_formats()
    return spark.createDataFrame([("wk 7 2016", before, after)], "value string, before string, after string")


# Functions -------------------------------------------------------------------------------------------

_FORMS = ("yyyy.MM.dd", "dd.MM.yyyy", "yyyy/MM/dd", "dd/MMM/yy", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd'T'HH", "EEE, MMM d, yyyy", "yyyy-MM-dd HH:mm:ss.SSS")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_patterns(spark, d):
    """Order dates written in as many forms, and read back without being told which."""
    k, t = F.col("o_orderkey") % len(_FORMS), F.col("o_orderdate").cast("timestamp")
    text = F.coalesce(*(F.when(k == i, F.date_format(t, p.replace("EEE", "E"))) for i, p in enumerate(_FORMS)))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date(text).cast("date").alias("day"))


@query("SELECT c_custkey, c_custkey AS i, CAST(c_custkey AS BIGINT) AS l, c_acctbal AS x, c_custkey % 2 = 0 AS b, c_name AS s FROM customer")
def typed_parsers(spark, d):
    kinds = {"i": ("long", F.col("c_custkey").cast("string")), "l": ("long", F.concat(F.lit(" "), F.col("c_custkey").cast("string"))), "x": ("double", F.col("c_acctbal").cast("string")), "b": ("boolean", F.when(F.col("c_custkey") % 2 == 0, " Yes").otherwise("OFF")), "s": ("string", F.col("c_name"))}
    return table(spark, d, "customer").select("c_custkey", *(dates.PARSERS[kind](c).alias(n) for n, (kind, c) in kinds.items()))


@query("SELECT c_custkey, md5(c_name) AS k, epoch(TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 1000) HOUR)::BIGINT AS s FROM customer")
def sql_functions(spark, d):
    dates.register(spark)
    return spark.sql(f"""SELECT c_custkey, hashKey(c_name) AS k, unix_seconds(convertStringToTimestamp(date_format(timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(c_custkey % 1000 as int)), 'dd/MM/yyyy H:mm'), 'dd/MM/yyyy HH:mm')) AS s
        FROM {view(spark, d, "customer")}""")


@query()
def fast_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.fast_hash(F.col("c_name")).alias("h"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3)")
def bounded_top(spark, d):
    """Three greatest orders of each customer: bounded queues over the rows of a task, then row_number over what they keep."""
    names = ["o_custkey", "o_orderkey", "o_totalprice"]
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("long"), F.col("o_orderkey").cast("long"), F.col("o_totalprice").cast("double"))
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.mapInArrow(lambda batches: bounded.greatest(batches, 3, *names), o.schema).withColumn("place", F.row_number().over(best)).where("place <= 3").select(names)


@query("SELECT * FROM (VALUES (0, 'click', 'Base', true), (1, 'purchase', 'Derived', true), (2, 'error', 'Base', false)) t(place, attribute, kind, active)")
def registry_round_trip(spark, d):
    path = resource("features.csv", "")
    features.Registry([Feature("click"), Feature("purchase", "Derived", description='a, "b"'), Feature("error", active=False), Feature("click")]).save(path)
    return spark.createDataFrame([(k, f.attribute, f.attribute_type, f.active) for k, f in enumerate(features.Registry.load(path).features)], "place int, attribute string, kind string, active boolean")


# Loads end to end ------------------------------------------------------------------------------------

_FIRST = vault.Process(dt.datetime(2024, 1, 2), "crm", "load", "p0", "tester")
_SECOND = vault.Process(dt.datetime(2024, 2, 1), "crm", "load", "p1", "tester")


def _store(spark: SparkSession) -> vault.Loader:
    return vault.Loader(vault.Store(spark, scratch(spark, "vault")))


def _two_loads(spark, d) -> vault.Loader:
    """Customers but every tenth, then all, those of nation 3 in another segment, and the rows of nation 4 twice."""
    loader, c = _store(spark), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    loader.satellite(c.where("c_custkey % 10 <> 0"), _FIRST, "customer_sat", ["c_custkey"], "Customer Number", change_tables=True)
    moved = c.withColumn("c_mktsegment", F.when(F.col("c_nationkey") == 3, "MOVED").otherwise(F.col("c_mktsegment")))
    loader.satellite(moved.unionByName(moved.where("c_nationkey = 4")), _SECOND, "customer_sat", ["c_custkey"], "Customer Number", change_tables=True)
    return loader


@query(
    """SELECT 'p0' AS process_id, count(*) AS read_count, 0 AS duplicates_count, count(*) AS inserts_count, 0 AS updates_count, 0 AS deletes_count FROM customer WHERE c_custkey % 10 <> 0
    UNION ALL SELECT 'p1', count(*) + count(*) FILTER (WHERE c_nationkey = 4), count(*) FILTER (WHERE c_nationkey = 4), count(*) FILTER (WHERE c_custkey % 10 = 0), count(*) FILTER (WHERE c_custkey % 10 <> 0 AND c_nationkey = 3), 0 FROM customer"""
)
def process_log(spark, d):
    return _two_loads(spark, d).store.read("process_log.parquet").select("process_id", "read_count", "duplicates_count", "inserts_count", "updates_count", "deletes_count")


@query("SELECT md5('Customer Number' || c_custkey) AS entity_id, 'MOVED' AS c_mktsegment, 2 AS version, DATE '2024-02-01' AS process_date FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey = 3")
def change_tables(spark, d):
    return _two_loads(spark, d).store.read("customer_sat/changed.parquet").select("entity_id", "c_mktsegment", "version", "process_date")


@query("SELECT 'customer_sat' AS tab, 'true' AS is_delta, 'crm' AS source, 'tester' AS user_id")
def load_meta(spark, d):
    store = _two_loads(spark, d).store
    return spark.read.json(f"{store.base}/customer_sat/meta.json").select(F.col("table").alias("tab"), F.col("is_delta").cast("string").alias("is_delta"), "source", "user_id")


_ORDER_LINK = "md5('Order Number' || o_orderkey) AS src_entity_id, md5('Customer Number' || o_custkey) AS dst_entity_id"


@query(
    f"""SELECT {_ORDER_LINK}, 'I' AS rectype, 1 AS version FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT {_ORDER_LINK}, 'I', 1 FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0
    UNION ALL SELECT {_ORDER_LINK}, 'D', 2 FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0"""
)
def link_deletes(spark, d):
    """A full load that lacks some links and has new ones; whole history."""
    loader, o = _store(spark), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sides = ("order", ["o_orderkey"], "Order Number"), ("customer", ["o_custkey"], "Customer Number")
    loader.link(o.where("o_orderkey % 5 <> 0"), _FIRST, *sides, is_delta=False)
    loader.link(o.where("o_orderkey % 3 <> 0"), _SECOND, *sides, is_delta=False)
    return loader.store.read("order_customer_link/history.parquet").select("src_entity_id", "dst_entity_id", "rectype", "version")


_NAMES = "md5('Customer Number' || c_custkey) AS src_entity_id, md5('name' || c_name) AS dst_entity_id, CAST(0.9 AS DOUBLE) AS confidence"


@query(
    f"""SELECT {_NAMES}, CASE WHEN c_custkey % 4 = 0 THEN 'D' ELSE 'I' END AS rectype, 1 AS version, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '9999-12-31' END AS end_time
    FROM customer WHERE c_custkey % 6 <> 0 OR c_custkey % 4 <> 0"""
)
def mapping_overwrite(spark, d):
    """A full load in overwrite mode closes the mappings it lacks in place."""
    loader, c = _store(spark), table(spark, d, "customer").select("c_custkey", "c_name")
    sides = (["c_custkey"], "Customer Number"), (["c_name"], "name")
    loader.mapping(c.where("c_custkey % 6 <> 0"), _FIRST, "customer", *sides, 0.9, is_delta=False, overwrite=True)
    loader.mapping(c.where("c_custkey % 4 <> 0"), _SECOND, "customer", *sides, 0.9, is_delta=False, overwrite=True)
    return loader.store.read("customer_mapping/history.parquet").select("src_entity_id", "dst_entity_id", "confidence", "rectype", "version", "end_time")


@query(f"SELECT {_NAMES}, CASE WHEN c_custkey % 4 = 0 THEN 'D' ELSE 'I' END AS rectype, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def current_mapping(spark, d):
    """Current mappings from history alone, after a delta that flags some for deletion."""
    loader, c = _store(spark), table(spark, d, "customer").select("c_custkey", "c_name")
    sides = (["c_custkey"], "Customer Number"), (["c_name"], "name")
    loader.mapping(c, _FIRST, "customer", *sides, 0.9)
    loader.mapping(c.where("c_custkey % 4 = 0").withColumn("gone", F.lit("y")), _SECOND, "customer", *sides, 0.9, delete_indicator=("gone", "y"))
    at = loader.store._path(f"{loader.store.base}/customer_mapping/current.parquet")
    loader.store._fs.delete(at, True)
    return loader.store.read_current("customer_mapping").select("src_entity_id", "dst_entity_id", "confidence", "rectype", "version")


@query(
    """SELECT 0 AS place, (SELECT count(*) FROM customer) AS read_count, (SELECT count(*) FROM customer) AS inserts_count UNION ALL SELECT 1, (SELECT count(*) FROM part), (SELECT count(*) FROM part)
    UNION ALL SELECT 2, (SELECT count(*) FROM customer), (SELECT count(*) FROM customer) UNION ALL SELECT 3, (SELECT count(*) FROM orders), (SELECT count(DISTINCT (o_orderkey, o_custkey)) FROM orders)
    UNION ALL SELECT 4, (SELECT count(*) FROM customer), (SELECT count(*) FROM customer)"""
)
def load_all(spark, d):
    """Customers and services registered as hubs, a satellite, a link and a mapping, by configuration."""
    side = lambda s, entity, field, kind: {f"{s}-entity-type": entity, f"{s}-id-fields": [field], f"{s}-id-type": kind}
    path = f"{d}/{{}}.parquet".format
    config = AppConfig.from_dict({"data": {
        "hubs": [{"source": path("customer"), "entity-type": "customer", "id-fields": ["c_custkey"], "id-type": "Customer Number", "new-names": {"c_custkey": "customer_id"}}, {"source": path("part"), "entity-type": "service", "id-fields": ["p_partkey"], "id-type": "Service Number", "new-names": {"p_partkey": "service_id"}}],
        "satellites": [{"source": path("customer"), "table-name": "customer_sat", "id-fields": ["c_custkey"], "id-type": "Customer Number", "projection": ["c_custkey", "c_mktsegment"]}],
        "links": [{"source": path("orders"), **side("src", "order", "o_orderkey", "Order Number"), **side("dst", "customer", "o_custkey", "Customer Number")}],
        "mappings": [{"source": path("customer"), "entity-type": "customer", **side("src", "customer", "c_custkey", "Customer Number"), **side("dst", "name", "c_name", "name")}],
    }})
    logs = _store(spark).load_all(config, _FIRST)
    rows = [(k, r["read_count"], r["inserts_count"]) for k, log in enumerate(logs) for r in log.collect()]
    return spark.createDataFrame(rows, "place int, read_count long, inserts_count long")


@query("SELECT md5('Service Number' || p_partkey) AS entity_id, p_partkey AS service_id, 'service' AS entity_type, 'I' AS rectype, 1 AS version FROM part")
def registered_services(spark, d):
    loader = _store(spark)
    loader.services(table(spark, d, "part"), _FIRST, "p_partkey", "Service Number")
    return loader.store.read("service_hub/current.parquet").select("entity_id", "service_id", "entity_type", "rectype", "version")


# Star ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, true AS sampled FROM orders")
def dimensionalized(spark, d):
    """Facts joined back to their dimensions; everything is written and read through the star writers."""
    base, config = scratch(spark, "star"), {"sample": 20, "tables": {"orders": {"source": f"{d}/orders.parquet", "dims": [{"fields": ["o_orderpriority"]}, {"fields": ["o_orderstatus"]}], "facts": ["o_orderkey", "o_totalprice"]}}}
    star.dimensionalize(config, spark.read.parquet, lambda df, name: df.write.parquet(f"{base}/{name}"))
    out = spark.read.parquet(f"{base}/fact_orders")
    for name in ("o_orderpriority", "o_orderstatus"):
        out = out.join(spark.read.parquet(f"{base}/dim_{name}").select(F.col("id").alias(f"fk_{name}"), name), f"fk_{name}")
    few = spark.read.parquet(f"{base}/orders_sample").count() < 200
    return out.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", F.lit(few).alias("sampled"))


@query(
    """WITH a AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment < 'H'), b AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment >= 'H')
    SELECT s AS c_mktsegment, row_number() OVER (ORDER BY md5(s)) AS id FROM a UNION ALL SELECT s, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY md5(s)) FROM b UNION ALL SELECT 'unknown', -1"""
)
def dim_ids_of_two_loads(spark, d):
    c = table(spark, d, "customer")
    first = star.load_dim(c.where("c_mktsegment < 'H'"), ["c_mktsegment"])
    return star.load_dim(c, ["c_mktsegment"], existing=first, load_ts="2024-02-01 00:00:00").select("c_mktsegment", "id")


# Pipelines with files, errors, plans -----------------------------------------------------------------


@query("SELECT * FROM (VALUES ('a -> b'), ('a -> c'), ('alone')) t(line)")
def pipeline_dag(spark, d):
    a = pipeline.ColumnTransformation("a", "x", "1")
    steps = [pipeline.ColumnTransformation("b", "y", "x", [a]), pipeline.ColumnTransformation("c", "z", "x", [a]), a, pipeline.ColumnTransformation("alone", "w", "2")]
    return spark.createDataFrame([(x,) for x in pipeline.RowPipeline("p").add(*steps).dag().splitlines()], "line string")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING count(*) > 2", rounded=("total",))
def pipeline_sql_files(spark, d):
    total = pipeline.SQLFileTable("total", "t1", resource("total.sql", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM t1 GROUP BY 1"))
    many = pipeline.NamedSQLTable("many", "t3", (resource("q.properties", "many=SELECT * FROM t3 WHERE n > ${least}"), "many"), [total])
    return pipeline.TablePipeline("files").add(many, total)(table(spark, d, "orders"), Context(sqlparams={"least": 2}))


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 2")
def sourceless_sql(spark, d):
    params = {"t": view(spark, d, "nation")}
    return pipeline.run_sql_file(spark, resource("q.sql", "SELECT n_name FROM $t WHERE n_regionkey = 1"), params).union(pipeline.run_named_sql(spark, resource("q.properties", "two=SELECT n_name FROM ${t} WHERE n_regionkey = 2"), "two", params))


@query("SELECT * FROM (VALUES ('keep', 'Success'), ('count', 'Success'), ('broken', 'Fail')) t(step, status)")
def job_steps(spark, d):
    ctx = Context()
    keep = pipeline.TableTransformation("keep", lambda df, c: df.where("n_regionkey > 0"))
    count = pipeline.TableTransformation("count", lambda df, c: df.groupBy("n_regionkey").count(), [keep])
    broken = pipeline.TableTransformation("broken", lambda df, c: df.select(*c["no such key"]), [count])
    with contextlib.suppress(KeyError):
        pipeline.TablePipeline("steps").add(broken, count, keep)(table(spark, d, "nation"), ctx)
    repository = repositories.Repository(str(Path(resource("steps.csv", "")).parent), "steps.csv")
    repository.save(ctx["steps"])
    return spark.createDataFrame([(r[0], r[2]) for r in repository.load()], "step string, status string")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE 12.0 / (l_linenumber - 3) END AS share, CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS errors FROM lineitem", rounded=("share",))
def row_errors(spark, d):
    """A Python step over all line items that fails on some of them."""
    share = pipeline.AppendColumn("share", "share", T.DoubleType(), lambda r, c: 12.0 / (r["l_linenumber"] - c["third"]))
    out = pipeline.RowPipeline("errors").add(share)(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), Context(third=3))
    return out.select("l_orderkey", "l_linenumber", "share", F.size(pipeline.ERRORS).alias("errors"))


class _Linear:
    """Twice the balance, and the segment's place."""

    columns, response = ["c_acctbal", "c_mktsegment"], "c_nationkey"

    def __init__(self):
        self.domains = {"c_mktsegment": ["BUILDING", "MACHINERY"]}

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, 0] * 2, x[:, 1]])


@query("SELECT c_custkey, c_acctbal * 2 AS p, CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'MACHINERY' THEN 1.0 ELSE -1.0 END AS segment, CAST(c_nationkey AS DOUBLE) AS response FROM customer")
def scored_rows(spark, d):
    out = scoring.score(_Linear(), table(spark, d, "customer"), response_attached=True, keys=["c_custkey"])
    return out.select("c_custkey", F.col("scores")[0].alias("p"), F.col("scores")[1].alias("segment"), F.col("scores")[2].alias("response"))


@query(
    """SELECT 'small' AS description, count(*) FILTER (WHERE NOT o_totalprice < 400000) AS invalid FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'both', count(*) FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice < 400000"""
)
def dq_plan(spark, d):
    """A view, an assertion over it and a difference of the two, by a plan."""
    rule = {"query": "o_totalprice < 400000", "description": "small", "threshold": 0.9}
    side = lambda ref: {"ref": ref, "onDisk": False, "joinColumns": ["o_orderkey"], "diffColumns": []}
    plan = {"topnotch": [
        {"command": "view", "inputs": [{"ref": f"{d}/orders.parquet", "onDisk": True, "tableAlias": "millrace_plan_orders"}], "query": "SELECT o_orderkey, o_totalprice FROM millrace_plan_orders WHERE o_orderstatus = 'F'", "outputKey": "v"},
        {"command": "assertion", "input": {"ref": "v", "onDisk": False}, "assertions": [rule], "outputKey": "bad"},
        {"command": "diff", "input1": side("v"), "input2": side("bad"), "input1Name": "view", "input2Name": "bad", "outputKey": "fine"},
    ]}
    run = quality.PlanRunner(spark)
    out = run.run(plan)
    total = out["v"].agg(F.count(F.lit(1)).alias("v")).crossJoin(out["fine"].agg(F.count(F.lit(1)).alias("f")))  # one row each
    return run.reports["bad"].select("description", F.col("invalid").cast("long").alias("invalid")).unionByName(total.select(F.lit("both").alias("description"), (F.col("v") - F.col("f")).alias("invalid")))


@query(
    """WITH v AS (SELECT 'c' || c_custkey AS id, 'customer' AS id_type FROM customer), e AS (SELECT DISTINCT 'n' || c_nationkey AS id FROM customer)
    SELECT * FROM v UNION ALL SELECT id, 'Missing' FROM e"""
)
def graph_vertices(spark, d):
    """Vertices of a graph of which only the customers are known: the nations are Missing."""
    c = table(spark, d, "customer")
    mapping = c.selectExpr("concat('c', c_custkey) src_entity_id", "'customer' src_id_type", "concat('n', c_nationkey) dst_entity_id", "'nation' dst_id_type", "1.0d confidence")
    nodes, _ = resolve.graph(mapping, c.selectExpr("concat('c', c_custkey) id", "'customer' id_type"))
    return nodes

