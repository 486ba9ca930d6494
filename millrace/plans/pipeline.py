"""Transformation pipelines: row and table steps in dependency order, between sources and sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.strings import template
from millrace.model import ErrorThresholdReached, JobStep, TransformationError
from millrace.plans.context import Context
from millrace.session import checkpointed
from millrace.sources.sql import load_query

ERRORS = "_errors"


class Transformation:
    """A named step that runs after others."""

    def __init__(self, name: str, dependencies: Sequence[Transformation] = ()):
        self.name, self.dependencies = name, list(dependencies)

    @property
    def edges(self) -> list[tuple[Transformation, Transformation]]:
        return [(d, self) for d in self.dependencies]


def topological(steps: Sequence[Transformation]) -> list[Transformation]:
    """Steps after their dependencies, otherwise in the given order; a cycle is an error."""
    known = set(map(id, steps))
    graph = TopologicalSorter({k: [] for k in range(len(steps))})
    place = {id(s): k for k, s in enumerate(steps)}
    for k, s in enumerate(steps):
        graph.add(k, *(place[id(d)] for d in s.dependencies if id(d) in known))
    try:
        graph.prepare()
    except CycleError as e:
        raise ValueError("the transformations depend on one another in a cycle") from e
    out = []
    while graph.is_active():
        ready = sorted(graph.get_ready())
        out += [steps[k] for k in ready]
        graph.done(*ready)
    return out


class ColumnTransformation(Transformation):
    """Adds or replaces a column by an expression: the preferred row step."""

    def __init__(self, name: str, column: str, expr: Column | str, dependencies=()):
        super().__init__(name, dependencies)
        self.column, self.expr = column, F.expr(expr) if isinstance(expr, str) else expr


class RowTransformation(Transformation):
    """A Python function (Row, context) -> Row with the same columns."""

    def __init__(self, name: str, f: Callable[[Row, Context], Row], dependencies=()):
        super().__init__(name, dependencies)
        self.f = f


class AppendColumn(Transformation):
    """A Python function (Row, context) -> value of a new typed column."""

    def __init__(self, name: str, column: str, kind: T.DataType, f: Callable, dependencies=()):
        super().__init__(name, dependencies)
        self.column, self.kind, self.f = column, kind, f


class TableTransformation(Transformation):
    """A function (DataFrame, context) -> DataFrame."""

    def __init__(self, name: str, f: Callable[[DataFrame, Context], DataFrame] | None = None, dependencies=()):
        super().__init__(name, dependencies)
        self.f = f

    def __call__(self, df: DataFrame, ctx: Context) -> DataFrame:
        return self.f(df, ctx)


class SQLTable(TableTransformation):
    """Runs SQL over the table, registered under a name."""

    def __init__(self, name: str, table: str, sql: str, dependencies=()):
        super().__init__(name, None, dependencies)
        self.table, self.sql = table, sql

    def text(self, ctx: Context) -> str:
        return template(self.sql, ctx["sqlparams"])

    def __call__(self, df, ctx):
        df.createOrReplaceTempView(self.table)
        return df.sparkSession.sql(self.text(ctx))


class SQLFileTable(SQLTable):
    def text(self, ctx):
        return template(Path(self.sql).read_text(encoding="utf-8"), ctx["sqlparams"])


class NamedSQLTable(SQLTable):
    """sql: (file, query name)."""

    def text(self, ctx):
        return load_query(*self.sql, ctx["sqlparams"])


def run_sql(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    return spark.sql(template(sql, params or {}))


def run_sql_file(spark: SparkSession, path: str, params: dict | None = None) -> DataFrame:
    return run_sql(spark, Path(path).read_text(encoding="utf-8"), params)


def run_named_sql(spark: SparkSession, path: str, name: str, params: dict | None = None) -> DataFrame:
    return spark.sql(load_query(path, name, params))


class Pipeline(Transformation):
    def __init__(self, name: str = "pipeline"):
        super().__init__(name)
        self.steps: list[Transformation] = []

    def add(self, *steps: Transformation) -> Pipeline:
        self.steps += steps
        return self

    def __call__(self, df: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError

    def run(self, spark: SparkSession, source, sink, ctx: Context) -> DataFrame:
        return sink(self(source(spark, ctx), ctx), ctx)

    def run_joined(self, spark: SparkSession, source1, source2, keys1: Sequence[str], keys2: Sequence[str], sink, ctx: Context) -> DataFrame:
        """Two sources joined on pairs of keys, then as run()."""
        return sink(self(join_sources(source1(spark, ctx), source2(spark, ctx), keys1, keys2), ctx), ctx)

    def dag(self) -> str:
        """One line per edge, then the steps without any."""
        lines = [f"{a.name} -> {b.name}" for s in self.steps for a, b in s.edges]
        linked = {x.name for s in self.steps for e in s.edges for x in e}
        return "\n".join([*lines, *(s.name for s in self.steps if s.name not in linked)])


def join_sources(a: DataFrame, b: DataFrame, keys1: Sequence[str], keys2: Sequence[str]) -> DataFrame:
    """Inner join on pairs of keys; the second source's keys are dropped."""
    left = a.alias("a")
    right = b.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys2)})
    on = [F.col(f"a.{k}") == F.col(f"_k{i}") for i, k in enumerate(keys1)]
    return left.join(right, on).drop(*(f"_k{i}" for i in range(len(keys2))))


class RowPipeline(Pipeline):
    """Row steps in one pass. Column steps stay expressions; runs of Python steps share one pass over the rows.

    A row that a Python step fails on keeps its values, an appended column is null there, and the message is
    added to the column `_errors`. With a threshold in ctx['error_threshold'] the failed rows are counted
    up to it; too many raise ErrorThresholdReached.
    """

    def __call__(self, df, ctx):
        run: list[Transformation] = []
        for step in topological(self.steps):
            if isinstance(step, ColumnTransformation):
                df, run = self._python(df, run, ctx), []
                df = df.withColumn(step.column, step.expr)
            else:
                run.append(step)
        df = self._python(df, run, ctx)
        limit = ctx.get("error_threshold")
        if ERRORS in df.columns and limit is not None:
            df = checkpointed(df)  # the steps run once, for the count and for the sink
            bad = df.where(F.size(ERRORS) > 0).limit(limit + 1).collect()
            ctx["errors"] += [TransformationError(self.name, dt.datetime.now(), "row", m, str(r)) for r in bad for m in r[ERRORS]]
            if len(bad) > limit:
                raise ErrorThresholdReached(f"more than {limit} rows failed")
        return df

    @staticmethod
    def _python(df: DataFrame, steps: list[Transformation], ctx: Context) -> DataFrame:
        if not steps:
            return df
        schema = T.StructType(list(df.schema.fields))
        if ERRORS not in df.columns:
            schema = schema.add(ERRORS, T.ArrayType(T.StringType()))
        for s in steps:
            if isinstance(s, AppendColumn):
                schema = schema.add(s.column, s.kind)
        shared = Context(**{k: v for k, v in ctx.items() if k not in ("errors", "steps")})
        names = schema.fieldNames()

        calls = [(s.name, s.f, s.column if isinstance(s, AppendColumn) else None) for s in steps]  # no Columns go along

        def apply(row: Row) -> tuple:
            values = row.asDict()
            values[ERRORS] = list(values.get(ERRORS) or [])
            for name, f, column in calls:
                now = Row(**values)
                try:
                    if column:
                        values[column] = f(now, shared)
                    else:
                        values.update(f(now, shared).asDict())
                except Exception as e:  # noqa: BLE001
                    values[ERRORS].append(f"{name}: {e}")
                    if column:
                        values[column] = None
            return tuple(values.get(n) for n in names)

        # rows cross in Arrow batches and the plan stays one of DataFrames
        steps_udf = F.udf(apply, schema, useArrow=True).asNondeterministic()
        return df.select(steps_udf(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("_row")).select("_row.*")


class TablePipeline(Pipeline):
    """Table steps in order; each leaves a JobStep in the context."""

    def __call__(self, df, ctx):
        for step in topological(self.steps):
            try:
                df = step(df, ctx)
            except Exception as e:
                ctx["steps"].append(JobStep(step.name, dt.datetime.now(), "Fail", str(e)))
                raise
            ctx["steps"].append(JobStep(step.name, dt.datetime.now(), "Success"))
        return df
