"""Sources and sinks of pipelines; each is called with a context."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.strings import template
from millrace.plans.context import Context
from millrace.sources.sql import load_query


class Source:
    def __call__(self, spark: SparkSession, ctx: Context) -> DataFrame:
        raise NotImplementedError


class CSVSource(Source):
    """in_path, header ('false'), schema (optional)."""

    def __call__(self, spark, ctx):
        reader = spark.read.option("header", ctx.get("header", "false"))
        if "schema" in ctx:
            reader = reader.schema(ctx["schema"])
        return reader.csv(ctx["in_path"])


class ParquetSource(Source):
    """in_path."""

    def __call__(self, spark, ctx):
        return spark.read.parquet(ctx["in_path"])


class SQLSource(Source):
    """sql, sqlparams."""

    def __call__(self, spark, ctx):
        return spark.sql(template(ctx["sql"], ctx.get("sqlparams", {})))


class SQLFileSource(Source):
    """filename, sqlparams."""

    def __call__(self, spark, ctx):
        return spark.sql(template(Path(ctx["filename"]).read_text(), ctx.get("sqlparams", {})))


class NamedSQLSource(Source):
    """propsPath, name, sqlparams."""

    def __call__(self, spark, ctx):
        return spark.sql(load_query(ctx["propsPath"], ctx["name"], ctx.get("sqlparams", {})))


class Sink:
    def __call__(self, df: DataFrame, ctx: Context) -> DataFrame:
        raise NotImplementedError


class CSVSink(Sink):
    """out_path, header."""

    def __call__(self, df, ctx):
        df.write.mode(ctx.get("mode", "error")).option("header", ctx.get("header", "false")).csv(ctx["out_path"])
        return df


class ParquetSink(Sink):
    """out_path."""

    def __call__(self, df, ctx):
        df.write.mode(ctx.get("mode", "error")).parquet(ctx["out_path"])
        return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, driver=driver, **options).load()


def write_table(df: DataFrame, name: str, fmt: str = "orc", path: str | None = None, single_file: bool = False, mode: str = "overwrite") -> None:
    """A table of the catalog, replaced or appended to; managed unless a path is given.

    single_file writes with one task, so it is for small tables only.
    """
    writer = (df.coalesce(1) if single_file else df).write.format(fmt).mode(mode)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def prepare_keys(df: DataFrame, key: str) -> DataFrame:
    """The key as text and all other columns as long."""
    return df.select(*(F.col(c).cast("string" if c == key else "long").alias(c) for c in df.columns))


def read_sample(path: str, n: int, encoding: str = "utf-8") -> str:
    """The first n characters of a file; malformed bytes are an error."""
    with open(path, encoding=encoding, errors="strict", newline="") as f:
        return f.read(n)


def read_ebcdic(spark: SparkSession, path: str, codepage: str = "cp500", line_end: str = "\n") -> DataFrame:
    """(path, line_no, line) of EBCDIC files at any Hadoop URI; malformed bytes are an error."""
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: bytes(b).decode(codepage, "strict").replace("\x85", "\n"))

    files = spark.read.format("binaryFile").load(path).select("path", decode("content").alias("text"))
    return files.select("path", F.posexplode(F.split(F.regexp_replace("text", f"{line_end}$", ""), line_end)).alias("line_no", "line"))
