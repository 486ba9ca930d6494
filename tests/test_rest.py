import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import AppConfig
from millrace.model import EVENT, FACT, ErrorThresholdReached, JobStep, Quoting
from millrace.operators import quality, resolve, scoring, star
from millrace.plans import pipeline
from millrace.plans.context import Context
from millrace.sources import io, repositories, sniffer, sql
from millrace.streaming import loads


def test_models():
    assert len(EVENT) == 17 and len(FACT) == 15 and "attribute" in FACT.names
    assert JobStep("a", dt.datetime(2024, 1, 1), "Success").to_list()[1] == "2024-01-01 00:00:00.000"


def test_star(spark):
    df = spark.createDataFrame([("High", 1), ("Low", 2), (None, 3), ("High", 4)], "priority string, qty int")
    dim = star.load_dim(df, ["priority"])
    assert sorted(r["id"] for r in dim.collect()) == [-1, 1, 2]
    again = star.load_dim(spark.createDataFrame([("New",), ("Low",)], "priority string"), ["priority"], existing=dim)
    assert again.where("priority = 'New'").first()["id"] == 3 and again.count() == 4
    facts = {r["qty"]: r["fk_priority"] for r in star.load_facts(df, ["qty"], {"priority": (["priority"], dim)}).collect()}
    assert facts[3] == -1 and facts[1] == facts[4] != -1
    written = {}
    star.dimensionalize({"sample": 2, "tables": {"t": {"source": "x", "dims": [{"fields": ["priority"]}], "facts": ["qty"]}}}, lambda s: df, lambda d, n: written.update({n: d.columns}))
    assert set(written) == {"t", "t_sample", "dim_priority", "fact_t"}


def test_pipelines(spark, tmp_path):
    a = pipeline.ColumnTransformation("a", "x2", "x * 2")
    b = pipeline.AppendColumn("b", "inv", T.DoubleType(), lambda r, c: 1 / r["x"], [a])
    p = pipeline.RowPipeline("p").add(b, a)
    assert [s.name for s in pipeline.topological(p.steps)] == ["a", "b"] and p.dag() == "a -> b"
    df = spark.createDataFrame([(0,), (4,)], "x int")
    got = {r["x"]: r for r in p(df, Context()).collect()}
    assert got[4]["inv"] == 0.25 and got[0]["inv"] is None and "division" in got[0][pipeline.ERRORS][0]
    with pytest.raises(ErrorThresholdReached):
        p(df, Context(error_threshold=0))
    b.dependencies, a.dependencies = [a], [b]
    with pytest.raises(ValueError):
        pipeline.topological([a, b])
    ctx = Context(in_path=str(tmp_path / "in.csv"), out_path=str(tmp_path / "out"), header="true")
    (tmp_path / "in.csv").write_text("k,v\n1,a\n2,b\n")
    t = pipeline.TablePipeline("t").add(pipeline.TableTransformation("one", lambda d, c: d.where("k = 1")))
    assert t.run(spark, io.CSVSource(), io.ParquetSink(), ctx).count() == 1
    assert ctx["steps"][0].status == "Success" and spark.read.parquet(ctx["out_path"]).count() == 1
    joined = t.run_joined(spark, io.CSVSource(), io.CSVSource(), ["k"], ["k"], lambda d, c: d, ctx)
    assert joined.count() == 1
    bad = pipeline.TablePipeline("t").add(pipeline.TableTransformation("bad", lambda d, c: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        bad(df, ctx)
    assert ctx["steps"][-1].status == "Fail"
    repo = repositories.Repository(str(tmp_path), "steps.csv")
    repo.save(ctx["steps"])
    assert repo.load()[0][2] == "Success"


def test_sql_files(spark, tmp_path):
    (tmp_path / "q.properties").write_text("# c\nq1=SELECT 1 AS a\nq2 = SELECT '$x' AS b, \\\n  ${n} AS n\n")
    (tmp_path / "q.xml").write_text('<properties><entry key="q3">SELECT $n AS n</entry></properties>')
    assert pipeline.run_named_sql(spark, str(tmp_path / "q.properties"), "q2", {"x": "hey", "n": 3}).first() == ("hey", 3)
    assert sql.load_query(str(tmp_path / "q.xml"), "q3", {"n": 5}) == "SELECT 5 AS n"
    assert io.NamedSQLSource()(spark, Context(propsPath=str(tmp_path / "q.properties"), name="q1")).first()["a"] == 1


def test_quality(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (None, True), (5, False)], "n int, b boolean")
    rules = [{"query": "n < 3", "description": "small", "threshold": 0.5}, {"query": "b", "description": "b", "threshold": 0.4}]
    assert quality.invalid_rows(df, rules).count() == 2
    got = {r["description"]: (r["invalid"], r["passed"]) for r in quality.report(df, rules).collect()}
    assert got == {"small": (2, False), "b": (1, True)}
    df.write.parquet(str(tmp_path / "d"))
    plan = {"topnotch": [
        {"command": "view", "inputs": [{"ref": str(tmp_path / "d"), "onDisk": True, "tableAlias": "t"}], "query": "SELECT n FROM t WHERE b", "outputKey": "v"},
        {"command": "assertion", "input": {"ref": "v", "onDisk": False}, "assertions": rules[:1], "outputKey": "a"},
        {"command": "diff", "input1": {"ref": "v", "onDisk": False, "joinColumns": ["n"], "diffColumns": []}, "input2": {"ref": "a", "onDisk": False, "joinColumns": ["n"], "diffColumns": []}, "outputKey": "d"},
    ]}
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    run = quality.PlanRunner(spark, str(tmp_path))
    out = run.run("plan.json")
    assert out["v"].count() == 2 and out["a"].count() == 1 and run.reports["a"].first()["invalid"] == 1
    with pytest.raises(quality.AssertionFailed):
        run.run({"topnotch": [{"command": "assertion", "input": {"ref": "v"}, "assertions": [{"query": "n > 9", "description": "x", "threshold": 0}], "outputKey": "z"}]}, fail=True)


def test_resolver(spark):
    cols = "src_entity_id string, src_id_type string, dst_entity_id string, dst_id_type string, confidence double"
    m = spark.createDataFrame([("c1", "customer", "e1", "email", 1.0), ("e1", "email", "f1", "fnn", 1.0), ("c2", "customer", "e2", "email", 0.5)], cols)
    got = {r["id"]: r["target"] for r in resolve.map_entities(resolve.vertices(m), "id", m, "fnn", "target").collect()}
    assert got == {"c1": "f1", "e1": "f1", "f1": "f1", "c2": None, "e2": None}


def test_scoring(spark):
    class Twice:
        columns, domains, response = ["x", "c"], {"c": ["a", "b"]}, None

        def predict(self, x):
            return np.column_stack([x[:, 0] * 2, x[:, 1]])

    df = spark.createDataFrame([(3, "b"), (4, None)], "x long, c string")
    assert [r[0] for r in scoring.score(Twice(), df).collect()] == [[6.0, 1.0], [8.0, -1.0]]


def test_sniffer():
    meta, lines = sniffer.sniff('id,name,"note, x"\n1,foo,"a, b"\n2,bar,"c ""q"" d"\n')
    assert (meta.column_delimiter, meta.text_qualifier, meta.double_quoted) == (",", '"', True) and len(lines) == 3
    meta, _ = sniffer.sniff("id\tname\tn\r\n1\tfoo\t2.5\r\n2\tbar, x\t3.5\r\n")
    assert meta.column_delimiter == "\t" and meta.header and meta.line_terminator == "\r\n" and meta.columns == ["id", "name", "n"]
    assert not sniffer.sniff("1,2,3\n4,5,6\n7,8,9\n")[0].header
    wide = "\t".join(f"column_{k}" for k in range(555))
    assert sniffer.sniff(wide + "\n" + "\t".join("1" for _ in range(555)))[0].header
    assert [sniffer.value_type(x) for x in ("0", "007", "1.5", "2016-01-02", "yes", "", "x")] == ["Integer", "String", "Numeric", "Date", "Boolean", "None", "String"]


def test_ebcdic_and_samples(spark, tmp_path):
    (tmp_path / "e").write_bytes("HELLO\nWORLD\n".encode("cp500"))
    assert [r["line"] for r in io.read_ebcdic(spark, str(tmp_path / "e")).orderBy("line_no").collect()] == ["HELLO", "WORLD"]
    (tmp_path / "s").write_text("abcdef")
    assert io.read_sample(str(tmp_path / "s"), 3) == "abc"


def test_config():
    c = AppConfig.from_dict({"data": {"base-uri": "/x", "hubs": [{"source": "s", "entity-type": "customer", "id-fields": ["a"], "id-type": "t", "partitionKeys": ["p"], "valid-start-time-field": "v", "valid-start-time-format": "yyyy"}]}, "user": {"a-b": 1}})
    assert c.tables[0].entity_type == "customer" and c.tables[0].partition_keys == ("p",) and c.tables[0].valid_start_time == ("v", "yyyy")


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 9))], "entity string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    loads.load_stream(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 2
    q = loads.session_counts(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("sessions").count() >= 1


def test_queries_have_oracles():
    from millrace.plans import catalog, catalog_files

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"fast_hash"} and catalog_files.query is catalog.query


def test_entry_without_llm(spark, monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("millrace.llm", "corpus_pipeline")) else real(name, *a))
    assert "feature_snapshot" in entry.queries() and not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    assert F is not None


def test_jdbc_reader():
    """The reader hands its options to Spark; there is no database here."""

    class Reader:
        def __init__(self):
            self.seen = {}

        read = property(lambda self: self)

        def format(self, name):
            self.seen["format"] = name
            return self

        def options(self, **more):
            self.seen.update(more)
            return self

        def load(self):
            return self.seen

    got = io.read_jdbc(Reader(), "jdbc:x://h/d", "t", "org.x.Driver", fetchsize="100")
    assert got == {"format": "jdbc", "url": "jdbc:x://h/d", "dbtable": "t", "driver": "org.x.Driver", "fetchsize": "100"}


def test_layout_settings():
    assert sniffer.line_statistics([]) == (0.0, 0.0, 0.0) and sniffer.line_statistics(["ab", "abcd"]) == (3.0, 1.0, 1.0)
    assert [q.value for q in Quoting] == ["minimal", "all", "nonnumeric", "none"] and sniffer.sniff('a,"b"\n')[0].quoting is Quoting.MINIMAL


def test_python_steps_run_once(spark, tmp_path):
    """With a threshold the steps run once for the count and the sink together."""
    (tmp_path / "calls").mkdir()
    seen = str(tmp_path / "calls")

    def call(row, ctx):
        import uuid

        open(f"{seen}/{uuid.uuid4().hex}", "w").close()
        return dt.datetime(2024, 1, row["x"])

    step = pipeline.AppendColumn("t", "t", T.TimestampType(), call)
    out = pipeline.RowPipeline("p").add(step)(spark.createDataFrame([(1,), (2,)], "x int"), Context(error_threshold=3))
    assert sorted(r["t"] for r in out.collect()) == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)] and out.count() == 2
    assert len(list((tmp_path / "calls").iterdir())) == 2


def test_graph_of_unknown_ends(spark):
    m = spark.createDataFrame([("a", "x", "b", "y", 1.0)], "src_entity_id string, src_id_type string, dst_entity_id string, dst_id_type string, confidence double")
    nodes, links = resolve.graph(m, spark.createDataFrame([("a", "x")], "id string, id_type string"))
    assert {tuple(r) for r in nodes.collect()} == {("a", "x"), ("b", "Missing")} and links.count() == 2 and resolve.graph(m)[0].count() == 2
