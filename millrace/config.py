"""Configuration of loads: frozen records from dictionaries or JSON with kebab-case keys."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


def _get(d: dict, *names, default=None):
    for n in names:
        if n in d:
            return d[n]
    return default


@dataclass(frozen=True)
class TableConfig:
    """One hub, satellite, link or mapping; keys that a kind doesn't have stay empty."""

    source: str
    kind: str
    table_name: str | None = None
    is_delta: bool = True
    overwrite: bool = False
    entity_type: str = ""
    id_fields: tuple[str, ...] = ()
    id_type: str = ""
    projection: tuple[str, ...] = ()
    partition_keys: tuple[str, ...] = ()
    new_names: dict = field(default_factory=dict)
    valid_start_time: tuple[str, str] | None = None
    valid_end_time: tuple[str, str] | None = None
    delete_indicator: tuple[str, object] | None = None
    src: dict = field(default_factory=dict)
    dst: dict = field(default_factory=dict)
    confidence: float = 1.0
    write_change_tables: bool = False

    @classmethod
    def from_dict(cls, kind: str, d: dict) -> TableConfig:
        pair = lambda a, b: (d[a], d[b]) if a in d else None
        side = lambda s: {k[len(s) + 1 :].replace("-", "_"): v for k, v in d.items() if k.startswith(f"{s}-")}
        return cls(
            source=d["source"], kind=kind, table_name=_get(d, "table-name"), is_delta=bool(_get(d, "delta", "is-delta", default=True)), overwrite=bool(_get(d, "overwrite", default=False)),
            entity_type=_get(d, "entity-type", default=""), id_fields=tuple(_get(d, "id-fields", default=())), id_type=_get(d, "id-type", default=""), projection=tuple(_get(d, "projection", default=())),
            partition_keys=tuple(_get(d, "partition-keys", "partitionKeys", default=())), new_names=dict(_get(d, "new-names", default={})), valid_start_time=pair("valid-start-time-field", "valid-start-time-format"),
            valid_end_time=pair("valid-end-time-field", "valid-end-time-format"), delete_indicator=pair("delete-indicator-field", "delete-indicator-value"), src=side("src"), dst=side("dst"),
            confidence=float(_get(d, "confidence", default=1.0)), write_change_tables=bool(_get(d, "write-change-tables", default=False)),
        )


@dataclass(frozen=True)
class AppConfig:
    base_uri: str
    tables: tuple[TableConfig, ...]
    user: dict

    @classmethod
    def from_dict(cls, d: dict) -> AppConfig:
        data = d.get("data", {})
        tables = [TableConfig.from_dict(kind, t) for kind in ("hub", "satellite", "link", "mapping") for t in data.get(f"{kind}s", ())]
        return cls(data.get("base-uri", ""), tuple(tables), dict(d.get("user", {})))

    @classmethod
    def load(cls, path: str) -> AppConfig:
        text = Path(path).read_text(encoding="utf-8")
        return cls.from_dict(tomllib.loads(text) if path.endswith(".toml") else json.loads(text))
