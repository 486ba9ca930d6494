"""Data-quality plans: assertions, diffs and views."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def violates(query: str) -> Column:
    """Rows that an assertion's condition doesn't select; null counts as not selected."""
    return ~F.coalesce(F.expr(query), F.lit(False))


def invalid_rows(df: DataFrame, assertions: Sequence[dict]) -> DataFrame:
    """Rows that violate any assertion."""
    some = F.lit(False)
    for a in assertions:
        some = some | violates(a["query"])
    return df.where(some)


def report(df: DataFrame, assertions: Sequence[dict]) -> DataFrame:
    """(description, threshold, total, invalid, fraction, passed) per assertion, from one pass."""
    n = df.agg(F.count(F.lit(1)).alias("total"), *(F.coalesce(F.sum(violates(a["query"]).cast("long")), F.lit(0)).alias(f"i{k}") for k, a in enumerate(assertions)))
    rows = F.array(*(F.struct(F.lit(a["description"]).alias("description"), F.lit(float(a["threshold"])).alias("threshold"), F.col(f"i{k}").alias("invalid")) for k, a in enumerate(assertions)))
    out = n.select("total", F.explode(rows).alias("r")).select("r.description", "r.threshold", "total", "r.invalid")
    out = out.withColumn("fraction", F.when(F.col("total") > 0, F.col("invalid") / F.col("total")).otherwise(F.lit(0.0)))
    return out.withColumn("passed", F.col("fraction") <= F.col("threshold"))


def diff(a: DataFrame, b: DataFrame, keys: Sequence[tuple[str, str]], columns: Sequence[tuple[str, str]], names: tuple[str, str] = ("input1", "input2")) -> DataFrame:
    """Rows that differ or are on one side only, with status; keys and columns pair those of a and b."""
    left = a.select(*(F.col(x).alias(f"k{i}") for i, (x, _) in enumerate(keys)), F.lit(True).alias("_a"), *(F.col(x).alias(f"{names[0]}_{x}") for x, _ in columns))
    right = b.select(*(F.col(y).alias(f"k{i}") for i, (_, y) in enumerate(keys)), F.lit(True).alias("_b"), *(F.col(y).alias(f"{names[1]}_{y}") for _, y in columns))
    both = left.join(right, [f"k{i}" for i in range(len(keys))], "full_outer")
    same = F.lit(True)
    for x, y in columns:
        same = same & F.col(f"{names[0]}_{x}").eqNullSafe(F.col(f"{names[1]}_{y}"))
    status = F.when(F.col("_b").isNull(), f"only_{names[0]}").when(F.col("_a").isNull(), f"only_{names[1]}").when(~same, "differs")
    out = both.withColumn("status", status).where("status is not null").drop("_a", "_b")
    return out.withColumnsRenamed({f"k{i}": x for i, (x, _) in enumerate(keys)})


def view(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over aliased inputs."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


class AssertionFailed(RuntimeError):
    """An assertion's invalid fraction is above its threshold."""


class PlanRunner:
    """Runs a plan: ordered commands over named or stored inputs."""

    def __init__(self, spark: SparkSession, base: str = "."):
        self.spark, self.base, self.data, self.reports = spark, Path(base), {}, {}

    def _input(self, spec: dict) -> DataFrame:
        if not spec.get("onDisk"):
            return self.data[spec["ref"]]
        if "delimiter" in spec:
            return self.spark.read.csv(spec["ref"], sep=spec["delimiter"], header=True, inferSchema=True)
        return self.spark.read.parquet(spec["ref"])

    def _params(self, command: dict) -> dict:
        if "externalParamsFile" in command:
            found = json.loads((self.base / command["externalParamsFile"]).read_text())
            return {**found.get("topnotch", found), **command}
        return command

    def run(self, plan: dict | str, fail: bool = False) -> dict[str, DataFrame]:
        """Outputs by key; reports of assertions are in self.reports. fail: raise where a threshold is passed."""
        if isinstance(plan, str):
            plan = json.loads((self.base / plan).read_text())
        for command in plan.get("topnotch", plan) if isinstance(plan, dict) else plan:
            spec = self._params(command)
            kind = spec["command"]
            if kind == "assertion":
                df = self._input(spec["input"])
                out, self.reports[spec["outputKey"]] = invalid_rows(df, spec["assertions"]), report(df, spec["assertions"])
                if fail and (bad := self.reports[spec["outputKey"]].where("not passed").collect()):
                    raise AssertionFailed("; ".join(f"{r['description']}: {r['fraction']:.4g} > {r['threshold']:.4g}" for r in bad))
            elif kind == "diff":
                a, b = spec["input1"], spec["input2"]
                out = diff(self._input(a), self._input(b), list(zip(a["joinColumns"], b["joinColumns"])), list(zip(a["diffColumns"], b["diffColumns"])), (spec.get("input1Name", "input1"), spec.get("input2Name", "input2")))
            elif kind == "view":
                inputs = spec["inputs"]
                out = view(self.spark, spec["query"], dict(zip([x["tableAlias"] for x in inputs], [self._input(x) for x in inputs])))
            else:
                raise ValueError(f"unknown command {kind}")
            if spec.get("cache"):
                out = out.cache()
            if spec.get("outputPath"):
                out.write.mode("overwrite").parquet(spec["outputPath"])
            self.data[spec["outputKey"]] = out
        return self.data
