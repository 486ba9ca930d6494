import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import AppConfig
from millrace.operators import vault

PROCESS = vault.Process(dt.datetime(2024, 1, 10), "crm", "load", "p1", "me")


def customers(spark, lo, hi, flag=0):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("cust_id"), F.lit(flag).cast("long").alias("age25to29"), F.lit(1).cast("long").alias("age30to34"))


def load(loader, df, process=PROCESS, **more):
    return loader.satellite(df, process, "demo_sat", ["cust_id"], "Customer Number", batch=vault.Batch(renames={"age25to29": "age_25_29"}), change_tables=True, **more).first()


def test_satellite_append(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path))
    loader = vault.Loader(store)
    assert load(loader, customers(spark, 1, 201))["inserts_count"] == 200
    log = load(loader, customers(spark, 20001, 20011).union(customers(spark, 20001, 20002)))
    assert (log["inserts_count"], log["duplicates_count"]) == (10, 1)
    log = load(loader, customers(spark, 20001, 20011, 1))
    assert log["updates_count"] == 10
    history, current = store.read("demo_sat/history.parquet"), store.read("demo_sat/current.parquet")
    assert history.count() == 220 and current.count() == 210
    key = F.md5(F.lit("Customer Number20010"))
    assert sorted((r["version"], r["rectype"]) for r in history.where(F.col("entity_id") == key).collect()) == [(1, "I"), (2, "U")]
    now = current.where(F.col("entity_id") == key).collect()
    assert [(r["version"], r["rectype"], r["age_25_29"]) for r in now] == [(2, "U", 1)]
    assert store.read("demo_sat/changed.parquet").count() == 10 and store.read("process_log.parquet").count() == 3
    assert load(loader, customers(spark, 20001, 20011, 1))["updates_count"] == 0


def test_satellite_overwrite(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path))
    loader = vault.Loader(store)
    later = vault.Process(dt.datetime(2024, 1, 12))
    load(loader, customers(spark, 1, 21), is_delta=False, overwrite=True)
    log = load(loader, customers(spark, 1, 11, 1).unionByName(customers(spark, 11, 20)), later, is_delta=False, overwrite=True)
    assert log["deletes_count"] == 1
    history = store.read("demo_sat/history.parquet")
    rows = {r["version"]: r for r in history.where(F.col("entity_id") == F.md5(F.lit("Customer Number5"))).collect()}
    assert history.count() == 30 and {r["rectype"] for r in rows.values()} == {"U"}
    assert rows[1]["end_time"] == rows[2]["start_time"] == dt.datetime(2024, 1, 12)
    with pytest.raises(ValueError):
        load(loader, customers(spark, 1, 2), is_delta=True, overwrite=True)


def test_deletes_and_return(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path))
    loader = vault.Loader(store)
    load(loader, customers(spark, 1, 4), is_delta=False)
    load(loader, customers(spark, 1, 3), is_delta=False)
    load(loader, customers(spark, 1, 4), is_delta=False)
    rows = store.read("demo_sat/history.parquet").where(F.col("entity_id") == F.md5(F.lit("Customer Number3"))).orderBy("version").collect()
    assert [(r["version"], r["rectype"]) for r in rows] == [(1, "I"), (2, "D"), (3, "I")]
    gone = customers(spark, 1, 2).withColumn("gone", F.lit(True))
    log = loader.satellite(gone, PROCESS, "demo_sat", ["cust_id"], "Customer Number", delete_indicator=("gone", True)).first()
    assert log["deletes_count"] == 1


def test_hub_link_mapping(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path))
    loader = vault.Loader(store)
    loader.customers(customers(spark, 1, 6), PROCESS, "cust_id", "Customer Number")
    loader.customers(customers(spark, 3, 9), PROCESS, "cust_id", "Customer Number")
    hub = store.read("customer_hub/current.parquet")
    assert hub.count() == 8 and "customer_id" in hub.columns
    pairs = spark.createDataFrame([("1", "a@x"), ("2", "b@x")], "cust_id string, email string")
    loader.link(pairs, PROCESS, ("customer", ["cust_id"], "Customer Number"), ("email", ["email"], "email"))
    loader.mapping(pairs, PROCESS, "customer", (["cust_id"], "Customer Number"), (["email"], "email"), 0.8)
    assert store.read("customer_email_link/current.parquet").count() == 2
    got = store.read_current("customer_mapping").first()
    assert got["confidence"] == 0.8 and got["dst_id_type"] == "email"
    loader.link(pairs.limit(1), PROCESS, ("customer", ["cust_id"], "Customer Number"), ("email", ["email"], "email"), is_delta=False)
    assert store.read("customer_email_link/history.parquet").where("rectype = 'D'").count() == 1


def test_null_key_refused(spark):
    df = spark.createDataFrame([(None, 1)], "cust_id string, x int")
    with pytest.raises(Exception, match="null entity_id"):
        vault.prepare(df, {"entity_id": vault.entity_key("t", ["cust_id"])}, vault.Batch(), PROCESS, key_columns=["cust_id"]).collect()


def test_retention(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path))
    for day in (1, 5):
        p = vault.Process(dt.datetime(2024, 1, day))
        store.write_changes(spark.range(1).withColumn("process_date", p.stamp.cast("date")), "t/new.parquet", p)
    assert [str(r[0]) for r in store.read("t/new.parquet").select("process_date").collect()] == ["2024-01-05"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.integers(0, 5), st.integers(0, 2), max_size=5), min_size=2, max_size=3))
def test_append_and_overwrite_agree(spark, loads):
    states = {}
    for overwrite in (False, True):
        history = current = None
        for k, batch in enumerate(loads):
            df = spark.createDataFrame([(str(a), b) for a, b in batch.items()], "id string, x int")
            p = vault.Process(dt.datetime(2024, 1, 1 + k))
            rows = vault.prepare(df, {"entity_id": vault.entity_key("t", ["id"])}, vault.Batch(), p, key_columns=["id"])
            changes = vault.plan_changes(rows, current, ["entity_id"], p.stamp, is_delta=False, overwrite=overwrite)
            changes = spark.createDataFrame(changes.collect(), changes.schema)
            history = vault.next_history(history, changes, ["entity_id"], overwrite)
            current = vault.next_current(current, changes, ["entity_id"])
            history, current = (spark.createDataFrame(x.collect(), x.schema) for x in (history, current))
        states[overwrite] = {r["id"]: r["x"] for r in current.where("rectype <> 'D'").collect()}
        assert current.count() == current.select("entity_id").distinct().count()
        assert history.groupBy("entity_id").agg((F.max("version") == F.count_distinct("version")).alias("ok")).where("not ok").count() == 0
    assert states[False] == states[True] == {str(a): b for a, b in loads[-1].items()}


def test_load_all(spark, tmp_path):
    customers(spark, 1, 4).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("1", "a@x")], "cust_id string, email string").write.parquet(str(tmp_path / "map"))
    side = {"src-entity-type": "customer", "src-id-fields": ["cust_id"], "src-id-type": "Customer Number", "dst-entity-type": "email", "dst-id-fields": ["email"], "dst-id-type": "email"}
    config = AppConfig.from_dict({"data": {
        "mappings": [{"source": str(tmp_path / "map"), "entity-type": "customer", "confidence": 0.7, **side}],
        "links": [{"source": str(tmp_path / "map"), **side}],
        "satellites": [{"source": str(tmp_path / "in"), "table-name": "demo_sat", "id-fields": ["cust_id"], "id-type": "Customer Number", "projection": ["cust_id", "age25to29"], "new-names": {"age25to29": "age_25_29"}}],
        "hubs": [{"source": str(tmp_path / "in"), "entity-type": "customer", "id-fields": ["cust_id"], "id-type": "Customer Number", "new-names": {"cust_id": "customer_id"}}],
    }})
    store = vault.Store(spark, str(tmp_path / "vault"))
    logs = vault.Loader(store).load_all(config, PROCESS)
    assert [r.first()["inserts_count"] for r in logs] == [3, 3, 1, 1]
    assert "age_25_29" in store.read("demo_sat/current.parquet").columns and store.read("customer_mapping/current.parquet").first()["confidence"] == 0.7


def broken_off(loader, at):
    """A store whose driver is lost at a step of a load."""

    def lost(*a, **k):
        raise RuntimeError("lost")

    return type("Lost", (vault.Store,), {at: lost})(loader.store.spark, loader.store.base)


@pytest.mark.parametrize("step", ["replace", "write_changes", "write_log"])
@pytest.mark.parametrize("overwrite", [False, True])
def test_lost_driver(spark, tmp_path, step, overwrite):
    """A load cut off between its writes is finished by the next one; nothing is written twice."""
    loader = vault.Loader(vault.Store(spark, str(tmp_path)))
    how = {"is_delta": False, "overwrite": overwrite}
    load(loader, customers(spark, 1, 21), **how)
    later = vault.Process(dt.datetime(2024, 1, 12), process_id="p2")
    with pytest.raises(RuntimeError):
        load(vault.Loader(broken_off(loader, step)), customers(spark, 1, 16, 1), later, **how)
    log = load(loader, customers(spark, 1, 16, 1), vault.Process(dt.datetime(2024, 1, 13), process_id="p3"), **how)
    assert (log["inserts_count"], log["updates_count"], log["deletes_count"]) == (0, 0, 0)
    history, current = loader.store.read("demo_sat/history.parquet"), loader.store.read("demo_sat/current.parquet")
    assert history.groupBy("entity_id", "version", "rectype", "start_time").count().where("count > 1").count() == 0
    assert history.count() == (35 if overwrite else 40) and current.count() == 20 and current.where("rectype = 'D'").count() == 5
    assert loader.store.read("demo_sat/changed.parquet").count() == (30 if overwrite else 15)


def test_swap_cut_off(spark, tmp_path):
    store = vault.Store(spark, str(tmp_path))
    store.replace(spark.range(3), "t.parquet")
    spark.range(5).write.parquet(str(tmp_path / "t.parquet.next"))
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.prev")
    assert store.read("t.parquet").count() == 5


def test_duplicates_are_equal_rows(spark, tmp_path):
    """Two different rows of a key are no duplicates."""
    loader = vault.Loader(vault.Store(spark, str(tmp_path)))
    log = load(loader, customers(spark, 1, 4).unionByName(customers(spark, 1, 2, 1)).unionByName(customers(spark, 3, 4)))
    assert (log["duplicates_count"], log["inserts_count"]) == (1, 3)


def test_logs_in_the_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS logs")
    loader = vault.Loader(vault.Store(spark, str(tmp_path), catalog="logs"))
    for _ in range(2):
        load(loader, customers(spark, 1, 4))
    assert spark.table("logs.process_log").count() == 2 and spark.table("logs.meta_log").where("name = 'source'").first()["value"] == "crm"
    loader.store.spark.createDataFrame([("9",)], "cust_id string").write.saveAsTable("logs.feed")
    config = AppConfig.from_dict({"data": {"hubs": [{"source": "logs.feed", "entity-type": "customer", "id-fields": ["cust_id"], "id-type": "Customer Number"}]}})
    assert loader.load_all(config, PROCESS)[0].first()["inserts_count"] == 1
    spark.sql("DROP DATABASE logs CASCADE")


def test_deltas_leave_other_keys_alone(spark):
    plan = vault.plan_changes(*(spark.createDataFrame([], "entity_id string, hashed_value long, end_time timestamp_ntz, rectype string, version int") for _ in range(2)), ["entity_id"], PROCESS.stamp, is_delta=True)
    assert "FullOuter" not in plan._jdf.queryExecution().optimizedPlan().toString()
