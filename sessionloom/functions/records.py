"""Reading one transcript line: JSON decoding, JSON type names and field aliases.

These are plain Python helpers used inside Arrow batch functions, where a line
has to be walked to a depth that no fixed schema describes.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa

#: Canonical name -> other names under which emitters write the same field.
#: ``operators.drift.learn_renames`` finds these from data; the known ones are
#: stated here so that the other operators need no profiling pass of their own.
RECORD_ALIASES = {
    "type": ("recordType",),
    "cwd": ("workdir",),
    "gitBranch": ("branchName",),
    "requestId": ("requestRef",),
}
MESSAGE_ALIASES = {"model": ("modelName",)}
BLOCK_ALIASES = {"type": ("kind",), "tool_use_id": ("toolUseId",)}


@dataclass(frozen=True)
class Aliases:
    """Other names of fields, per level; ``STATED`` are the known ones above."""

    record: dict[str, tuple[str, ...]]
    message: dict[str, tuple[str, ...]]
    block: dict[str, tuple[str, ...]]

    @classmethod
    def learned(cls, renames: dict[str, str]) -> Aliases:
        """From new path -> agreed path, as ``Drift.learn_renames`` gives them."""
        levels: dict[str, dict[str, tuple[str, ...]]] = {"": {}, "message": {}, "message.content[]": {}}
        for new, old in sorted(renames.items()):
            level = levels.get(old.rpartition(".")[0])
            if level is not None:
                name = old.rpartition(".")[2]
                level[name] = (*level.get(name, ()), new.rpartition(".")[2])
        return cls(*levels.values())


STATED = Aliases(RECORD_ALIASES, MESSAGE_ALIASES, BLOCK_ALIASES)


def parse(raw: str | None) -> dict | None:
    """The JSON object of a line; None for blank, cut off or non-object lines."""
    if not raw:
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def field(obj: dict, name: str, aliases: dict[str, tuple[str, ...]]):
    """Value of ``name``, or of the first alias present when it is absent."""
    if name in obj:
        return obj[name]
    for other in aliases.get(name, ()):
        if other in obj:
            return obj[other]
    return None


def json_type(value) -> str:
    """One of null, bool, int, float, str, list, dict (bool before int)."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "bool"
    kind = type(value)
    if kind is str:
        return "str"
    if kind is int:
        return "int"
    if kind is float:
        return "float"
    return "list" if kind is list else "dict"


def blocks(message) -> list:
    """Content blocks of a message; a lone object counts as one block."""
    content = message.get("content") if isinstance(message, dict) else None
    if isinstance(content, dict):
        return [content]
    return content if isinstance(content, list) else []


def text_of(value) -> str | None:
    """A scalar as text; None for null and containers."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value)


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_RANGE = 253_402_300_799_000  #: the last millisecond that a timestamp can hold


def instant(value) -> int | None:
    """Microseconds since 1970 of ISO text or epoch milliseconds; None if unreadable."""
    try:
        if isinstance(value, bool) or value is None or isinstance(value, (list, dict)):
            return None
        if isinstance(value, (int, float)):
            return int(value * 1000) if abs(value) <= _RANGE else None
        at = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        return int(((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - _EPOCH).total_seconds() * 1_000_000)
    except (ValueError, OverflowError):
        return None


def storable(value):
    """Text with lone surrogates as JSON escapes, as Arrow takes no others; lists
    of texts alike, everything else as it is."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "backslashreplace").decode()
    return type(value)(storable(v) for v in value) if isinstance(value, (list, tuple)) else value


def column(values, kind: pa.DataType) -> pa.Array:
    """The values as an Arrow column; texts are made storable where they have to be."""
    try:
        return pa.array(values, type=kind)
    except ValueError:  # a lone surrogate in one of them
        return pa.array([storable(v) for v in values], type=kind)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a record batch of the schema."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(columns, schema)], schema=schema)
