"""Named SQL queries in .properties or .xml files."""

from __future__ import annotations

import threading
import xml.etree.ElementTree as ET
from collections.abc import Mapping
from pathlib import Path

from millrace.functions.strings import template

_cache: dict[str, dict[str, str]] = {}
_lock = threading.Lock()


def _properties(text: str) -> dict[str, str]:
    out, held = {}, ""
    for row in text.splitlines():
        row = row.lstrip() if held else row.strip()
        if not held and (not row or row[0] in "#!"):
            continue
        if row.endswith("\\") and not row.endswith("\\\\"):
            held += row[:-1]
            continue
        row, held = held + row, ""
        at = min((i for i in (row.find("="), row.find(":")) if i > 0), default=-1)
        if at > 0:
            out[row[:at].strip()] = row[at + 1 :].strip()
    return out


def _xml(text: str) -> dict[str, str]:
    return {x.attrib["key"]: (x.text or "").strip() for x in ET.fromstring(text).iter("entry")}


def load_queries(path: str) -> dict[str, str]:
    """All queries of a file; read once for each path."""
    with _lock:
        if path not in _cache:
            text = Path(path).read_text(encoding="utf-8")
            _cache[path] = _xml(text) if path.endswith(".xml") else _properties(text)
        return _cache[path]


def load_query(path: str, name: str, params: Mapping[str, object] | None = None) -> str:
    return template(load_queries(path)[name], params or {})


def unload(path: str) -> None:
    with _lock:
        _cache.pop(path, None)
