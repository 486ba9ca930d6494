"""Scoring of tables with pluggable models."""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Model(Protocol):
    """What a model needs: its columns, the domains of categorical ones, and predictions."""

    columns: list[str]
    domains: dict[str, list[str]]
    response: str | None

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def load_model(path: str, *args) -> Model:
    """A model by the dotted name of its class."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)(*args)


def encode(df: DataFrame, columns: list[str], domains: dict[str, list[str]], keys: Sequence[str] = ()) -> DataFrame:
    """keys, and columns as doubles: the place in the domain (-1 for null and unknown), numbers as they are, else 0."""
    out = [F.col(k) for k in keys]
    for c in columns:
        if c in domains:
            pairs = [x for i, d in enumerate(domains[c]) for x in (F.lit(d), F.lit(float(i)))]
            out.append(F.coalesce(F.create_map(*pairs)[F.col(c).cast("string")], F.lit(-1.0)).alias(c) if pairs else F.lit(-1.0).alias(c))
        elif isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
            out.append(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c))
        else:
            out.append(F.lit(0.0).alias(c))
    return df.select(*out)


def score(model: Model, df: DataFrame, response_attached: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, scores array<double>) of every row; with the response's encoded value last if it is attached."""
    columns = [*model.columns, *([model.response] if response_attached and model.response else [])]
    n = len(model.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            values = x.iloc[:, len(keys) :].to_numpy(dtype=float)
            found = np.atleast_2d(model.predict(values[:, :n])) if len(x) else np.empty((0, 0))
            if len(columns) > n and len(x):
                found = np.column_stack([found, values[:, n]])
            yield pd.concat([x.iloc[:, : len(keys)], pd.Series(list(found), index=x.index, name="scores", dtype=object)], axis=1)

    schema = T.StructType([df.schema[k] for k in keys]).add("scores", T.ArrayType(T.DoubleType()))
    return encode(df, columns, model.domains, keys).mapInPandas(run, schema)
