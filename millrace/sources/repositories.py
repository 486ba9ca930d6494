"""CSV stores of errors and job steps."""

from __future__ import annotations

import csv
from pathlib import Path

from millrace.model import JobStep, TransformationError


class Repository:
    def __init__(self, path: str, filename: str):
        self.file = Path(path) / filename

    def save(self, rows: list[TransformationError] | list[JobStep]) -> None:
        with open(self.file, "a", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows(r.to_list() for r in rows)

    def load(self) -> list[list[str]]:
        with open(self.file, newline="", encoding="utf-8") as f:
            return list(csv.reader(f))
