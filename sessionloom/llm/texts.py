"""The texts of a transcript line: strings at any depth of ``message.content``."""

from __future__ import annotations

from collections.abc import Iterator

from sessionloom.functions.records import BLOCK_ALIASES, field

#: Keys of blocks that hold identifiers, signatures or encoded bytes, no text.
OPAQUE = {"id", "tool_use_id", "toolUseId", "signature", "type", "kind"}


def walk(value, path: tuple = (), depth: int = 0) -> Iterator[tuple[tuple, str]]:
    """(path, text) of every string below ``value``."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from walk(x, (*path, i), depth + 1)
    elif isinstance(value, dict):
        kind = field(value, "type", BLOCK_ALIASES)
        for k, x in value.items():
            if k in OPAQUE and isinstance(x, str) and ("input" not in path):
                continue
            if k == "data" and kind == "base64":
                continue
            yield from walk(x, (*path, k), depth + 1)


def texts_of(record: dict, *, last_prompt: bool) -> list[tuple[tuple, str]]:
    """Texts of the message's content, and of ``lastPrompt`` when asked for."""
    out = []
    message = record.get("message")
    if isinstance(message, dict):
        out = list(walk(message.get("content"), ("message", "content")))
    if last_prompt and isinstance(record.get("lastPrompt"), str):
        out.append((("lastPrompt",), record["lastPrompt"]))
    return out


def replace_at(record: dict, path: tuple, text: str) -> None:
    """Put ``text`` where ``path`` leads."""
    at = record
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = text
