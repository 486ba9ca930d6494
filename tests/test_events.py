import datetime as dt

from pyspark.sql import functions as F

from millrace.functions.strings import paths
from millrace.model import Feature
from millrace.operators import events as ev
from millrace.operators import features

ROWS = {
    "1001": ["email 25 8:45", "web 26 8:45", "livechat 27 8:45", "call 27 10:45", "purchase 27 11:45"],
    "1002": ["web 25 11:45", "call 26 11:45", "call 27 11:45", "purchase 28 11:45"],
    "1003": ["mybills 23 9:30", "myusage 23 10:30", "complaint 23 11:45", "complaint 26 11:45", "churn 28 11:45"],
}
AT = "2016-03-01 00:00:00"


def fixture(spark):
    rows, n = [], 0
    for entity, items in ROWS.items():
        for item in items:
            kind, day, time = item.split()
            hour, minute = map(int, time.split(":"))
            rows.append((entity, kind, dt.datetime(2016, 2, int(day), hour, minute), str(n), n, 1))
            n += 1
    return spark.createDataFrame(rows, "entity string, event_type string, ts timestamp_ntz, value string, event_id int, version int")


def test_paths(spark):
    e = fixture(spark)
    top = ev.previous_interactions(e, 3, AT).where("entity = '1001'").select("event_type").collect()
    assert "livechat" in {r[0] for r in top}
    unique = dict(ev.chord_unique_interactions(e, "call", 3, AT).select("entity", paths(F.col("path"))).collect())
    assert unique == {"1001": "web,livechat,call", "1002": "web,call", "1003": ""}
    plain = dict(ev.chord_interactions(e, "call", 2, AT).select("entity", paths(F.col("path"))).collect())
    assert plain == {"1001": "livechat,call", "1002": "call,call", "1003": ""}


def test_sessions(spark):
    s = {(r["entity"], r["event_type"]): r["session"] for r in ev.sessionize(fixture(spark), "24 hours").collect()}
    assert s["1003", "churn"] == 3 and s["1001", "email"] == 1
    one = fixture(spark).where("event_id = 0")
    assert ev.sessionize(one, "1 hour").first()["session"] == 1


def test_counts(spark):
    e = fixture(spark)
    assert ev.count_events(e, ev.in_range("call", "2016-02-26 11:45:00", "2016-02-27 11:45:00")).first()["n"] == 3
    assert ev.count_events(e, ev.look_back("call", "2016-02-27 11:45:00", "1 days")).first()["n"] == 3
    assert ev.count_unique(e, ev.in_range("call", "2016-02-01 00:00:00", AT)).first()["n"] == 3
    assert ev.sum_values(e, ev.in_range("none", "2016-02-01 00:00:00", AT)).first()["total"] == 0.0
    assert ev.days_since(e, "call", AT).first()["days"] == 2
    assert ev.days_since(e, "none", AT).first()["days"] is None


def test_current_and_chords(spark):
    e = fixture(spark)
    newer = e.where("event_id = 0").withColumns({"version": F.lit(2), "value": F.lit("new")})
    got = ev.current(e.unionByName(newer)).where("event_id = 0").collect()
    assert [(r["version"], r["value"]) for r in got] == [(2, "new")]
    assert {r["entity"]: r["chord"] is None for r in ev.extract_chords(e, "call").collect()} == {"1001": False, "1002": False, "1003": True}


def test_features(spark, tmp_path):
    store = features.Registry([Feature("call"), Feature("web"), Feature("web"), Feature("off", active=False)])
    assert store.active == ["call", "web"]
    store.save(tmp_path / "f.csv")
    assert features.Registry.load(tmp_path / "f.csv").features == store.features
    got = {r["entity"]: (r["call"], r["web"]) for r in features.snapshot(fixture(spark), "2016-02-26 23:00:00", store).collect()}
    assert got == {"1001": (None, "1"), "1002": ("6", "5"), "1003": (None, None)}
    chord = {r["entity"]: (r["call"], r["web"]) for r in features.chord(fixture(spark), "purchase", AT, store).collect()}
    assert chord == {"1001": ("3", "1"), "1002": ("7", "5")}


def test_empty(spark):
    e = fixture(spark).where("false")
    assert ev.sessionize(e, "1 hour").count() == 0
    assert ev.chord_unique_interactions(e, "call", 2, AT).count() == 0
