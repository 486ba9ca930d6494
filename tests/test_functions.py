import datetime as dt
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import bounded, dates, hashing, strings


@pytest.mark.parametrize(
    "text, expected",
    [("$x", "1"), ("${x}", "1"), ("a ${x}b $y", "a 1b two"), ("'$x'", "'1'"), ('"${y}"', '"two"'), ("$z ${z}", "$z ${z}"), ("$$x", "$$x"), ("$${x}", "$${x}"), ("l1 $x\nl2 ${y},", "l1 1\nl2 two,")],
)
def test_template(text, expected):
    assert strings.template(text, {"x": 1, "y": "two"}) == expected


@pytest.mark.parametrize("text, lower, upper", [("foo_bar", "fooBar", "FooBar"), ("foo--bar_baz", "fooBarBaz", "FooBarBaz"), (None, "", ""), ("", "", "")])
def test_camelize(spark, text, lower, upper):
    assert strings.camelize(text) == lower and strings.camelize(text, True) == upper
    df = spark.createDataFrame([(text,)], "s string")
    assert tuple(df.select(strings.camelize_column(F.col("s")), strings.camelize_column(F.col("s"), True)).first()) == (lower, upper)


def test_strings(spark):
    df = spark.createDataFrame([("a  b\tc", "aaaa"), (None, None)], "s string, t string")
    got = df.select(strings.underscore(F.col("s")).alias("u"), strings.count_substring(F.col("t"), "aa").alias("n")).collect()
    assert [tuple(r) for r in got] == [("a_b_c", 2), (None, 0)]
    assert strings.parameterize({"entity-id": 7}) == {"entityId": "7"}
    assert strings.is_number("-1.5e3") and not strings.is_number("x1")


def test_hashes(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("N", "c")], "a string, b string")
    keys = [r[0] for r in df.select(hashing.entity_key("t", ["a", "b"])).collect()]
    assert keys[0] == keys[1] and keys[2] is None
    hashes = [r[0] for r in df.select(hashing.change_hash(["a", "b"])).collect()]
    assert len(set(hashes)) == 4


def test_dates(spark):
    df = spark.createDataFrame([("2016-02-25 8:45:00",), ("nonsense",), (None,)], "s string")
    got = df.select(dates.format_date(F.col("s"), "yyyy-MM-dd HH:mm:ss").alias("d"), dates.epoch_seconds(F.col("s"), "yyyy-MM-dd HH:mm:ss").alias("e")).collect()
    assert got[0]["d"] == "2016-02-25" and got[0]["e"] == 1456389900 and got[1]["d"] is None and got[2]["e"] is None
    many = spark.createDataFrame([("Mon, Jan 4, 2016",), ("4 Jan 2016",), ("2016/01/04",), ("20160104",), ("04/01/2016",)], "s string")
    assert {r[0] for r in many.select(dates.parse_date(F.col("s")).cast("date")).collect()} == {dt.date(2016, 1, 4)}
    flags = spark.createDataFrame([(" YES ",), ("0",), ("maybe",)], "s string")
    assert [r[0] for r in flags.select(dates.parse_boolean(F.col("s"))).collect()] == [True, False, None]


def test_every_date_pattern(spark):
    """A day written by each pattern is read back, unless an earlier pattern reads it in another way."""
    day = dt.datetime(2001, 12, 25, 13, 0, 0)
    for pattern in dates.DATE_PATTERNS + dates.MORE_PATTERNS:
        df = spark.createDataFrame([(day,)], "t timestamp").select(F.date_format("t", pattern.replace("EEE", "E")).alias("s"))
        assert df.select(dates.parse_date(F.col("s")).cast("date")).first()[0] == day.date(), (pattern, df.first())
    rows = spark.createDataFrame([("Wed, Jul 4, '01",), ("03/APR/15",), ("04.07.95",), ("2001-07-04 12",)], "s string")
    assert [str(r[0]) for r in rows.select(dates.parse_date(F.col("s")).cast("date")).collect()] == ["2001-07-04", "2015-04-03", "1995-07-04", "2001-07-04"]


def test_fast_hash_and_registered_functions(spark):
    df = spark.createDataFrame([("",), ("abc",), (None,)], "s string")
    got = [r[0] for r in df.select(hashing.fast_hash(F.col("s"))).collect()]
    assert got[0] == "-1205034819632174695" and got[1] not in (None, got[0]) and got[2] is None  # of no bytes: the published test value
    dates.register(spark)
    assert spark.sql("SELECT hashKey('a'), unix_seconds(convertStringToTimestamp('2016-02-25 8:45', 'yyyy-MM-dd HH:mm'))").first() == ("0cc175b9c0f1b6a831c399e269772661", 1456389900)


def test_bounded():
    queue = bounded.Bounded(3, len).extend(["a", "bbb", "cc", "ddd", "e", "ffff"])
    assert list(queue) == ["ffff", "bbb", "ddd"] and len(queue) == 3
    queue.clear()
    assert list(queue) == [] and list(bounded.Bounded(0).add(1)) == []


def test_greatest_of_a_batch_without_a_call_for_each_key():
    rows = [(k % 7 if k % 11 else None, k, float(k * 37 % 10)) for k in range(300)] + [(1, 500, math.nan), (1, 501, None), (9, 502, None), (9, 503, math.nan), (9, None, 5.0)]
    batch = pa.RecordBatch.from_pylist([dict(zip("kpv", r)) for r in rows], pa.schema([("k", pa.int64()), ("p", pa.int64()), ("v", pa.float64())]))
    got = [tuple(r.values()) for b in bounded.greatest([batch, batch.slice(0, 0)], 3, "k", "p", "v") for r in b.to_pylist()]
    value = lambda v: -math.inf if v is None else math.inf if math.isnan(v) else v
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    want = [r for own in want.values() for r in bounded.Bounded(3, lambda r: (value(r[2]), -(-1 if r[1] is None else r[1]))).extend(own)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 27
