"""Schemas and small records."""

from __future__ import annotations

import datetime as dt
from dataclasses import astuple, dataclass, field
from enum import Enum

from pyspark.sql import types as T

OPEN_END = "9999-12-31 00:00:00"

JOURNEY = T.StructType().add("id", "string").add("name", "string")
STAGE = T.StructType().add("id", "string").add("name", "string").add("journey", JOURNEY)
TASK = T.StructType().add("id", "string").add("name", "string").add("stages", T.ArrayType(STAGE))

EVENT = (
    T.StructType().add("entity", "string").add("event_type", "string").add("ts", "timestamp").add("namespace", "string").add("session", "integer").add("task", TASK)
    .add("value", "string").add("properties", "string").add("start_time", "timestamp").add("end_time", "timestamp").add("source", "string").add("process_type", "string")
    .add("process_id", "string").add("process_date", "timestamp").add("user_id", "string").add("rectype", "string").add("version", "integer")
)
FACT = T.StructType([T.StructField("attribute" if f.name == "event_type" else f.name, f.dataType) for f in EVENT if f.name not in ("session", "task")])
PROCESS_LOG = (
    T.StructType().add("process_id", "string").add("process_type", "string").add("user_id", "string").add("read_count", "long").add("duplicates_count", "long")
    .add("inserts_count", "long").add("updates_count", "long").add("deletes_count", "long").add("process_time", "timestamp").add("process_date", "date")
)

BASE, TRANSFORMED, DERIVED = "Base", "Transformed", "Derived"


@dataclass(frozen=True)
class Feature:
    """An entry of the feature registry."""

    attribute: str
    attribute_type: str = BASE
    namespace: str = "default"
    encoding: str = "string"
    description: str = ""
    active: bool = True

    def to_list(self) -> list[str]:
        return [self.attribute, self.attribute_type, self.namespace, self.encoding, self.description, str(self.active).lower()]

    @classmethod
    def from_list(cls, row: list[str]) -> Feature:
        return cls(*row[:5], row[5].strip().lower() == "true")


def _stamp(ts: dt.datetime) -> str:
    return ts.strftime("%Y-%m-%d %H:%M:%S.") + f"{ts.microsecond // 1000:03d}"


@dataclass(frozen=True)
class TransformationError:
    """A row that a step could not transform."""

    step: str
    ts: dt.datetime
    type: str
    message: str
    row: str

    def to_list(self) -> list[str]:
        return [self.step, _stamp(self.ts), self.type, self.message, self.row]


class ErrorThresholdReached(RuntimeError):
    """More rows failed than a pipeline allows."""


@dataclass(frozen=True)
class JobStep:
    """How a step ended."""

    step: str
    ts: dt.datetime
    status: str
    message: str = ""

    def to_list(self) -> list[str]:
        return [self.step, _stamp(self.ts), self.status, self.message]


class Quoting(str, Enum):
    """How fields of a delimited file are quoted."""

    MINIMAL, ALL, NONNUMERIC, NONE = "minimal", "all", "nonnumeric", "none"


@dataclass
class FileMetadata:
    """Layout of a delimited file."""

    column_delimiter: str = ","
    text_qualifier: str = '"'
    double_quoted: bool = True
    skip_initial_space: bool = False
    header: bool = False
    line_terminator: str = "\n"
    quoting: Quoting = Quoting.MINIMAL
    escape_character: str | None = None
    inferred: bool = True
    columns: list[str] = field(default_factory=list)

    def reader_options(self) -> dict[str, str]:
        """Options for spark.read.csv."""
        out = {"sep": self.column_delimiter, "quote": self.text_qualifier, "header": str(self.header).lower(), "ignoreLeadingWhiteSpace": str(self.skip_initial_space).lower()}
        out["escape"] = self.text_qualifier if self.double_quoted else self.escape_character or "\\"
        return out

    def to_json(self) -> str:
        import json

        return json.dumps(dict(zip(self.__dataclass_fields__, astuple(self))))
