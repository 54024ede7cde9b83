"""Deeply nested records as related flat tables, by Merkle subtree identities.

Every object is canonicalised (sorted keys, children replaced by their hashes)
and hashed once, bottom-up, so equal subtrees have equal identities wherever they
occur.  ``bridge`` has a row per occurrence of every object of a message, itself
included: its path, its ordinal, its parent's identity and that of the content
block it is in.  ``objects`` stores each distinct object once, with what it says
of itself (type, own id, the call it is or answers).  ``nodes`` joins the two by
identity; ``rebuild`` gives messages back from them.

An object that makes up a third of all occurrences meets one stored row: the join
splits such a partition at run time (adaptive skew join), and stored objects are
reduced in every task before they are shuffled.

Defined cases: unreadable lines and messages that are no objects give no rows; a
lone object counts as one block at position 0; an object without a type has a
null ``node_type``; a result without a call id has a null ``ref_id``; repeated
lines give rows of their own (their ``line_id`` differs) and share objects; an
empty table gives empty tables.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.records import STATED, Aliases, batch_of, field, parse, storable, text_of

BRIDGE = pa.schema(
    [
        ("line_id", pa.int64()),
        ("path", pa.string()),
        ("node_path", pa.string()),
        ("role", pa.string()),
        ("ordinal", pa.int32()),
        ("object_id", pa.string()),
        ("parent_object_id", pa.string()),
        ("block_object_id", pa.string()),
        ("node_type", pa.string()),
        ("own_id", pa.string()),
        ("call_id", pa.string()),
        ("body", pa.string()),
    ]
)
BRIDGE_DDL = (
    "line_id bigint, path string, node_path string, role string, ordinal int, object_id string, parent_object_id string, "
    "block_object_id string, node_type string, own_id string, call_id string, body string"
)


def _canonical(flat) -> str:
    return json.dumps(flat, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _hash(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _occurrences(line_id, message: dict, bodies: bool, out: list, names: dict) -> None:
    """Rows of every object of a message.

    Paths are JSON pointers into it, an ordinal is the place in its list or
    among its object's sorted keys; ``node_path`` has the positions from
    ``content`` down, of blocks and of what lists named ``content`` hold.
    """

    def visit(value, path: str, node_path: str | None, ordinal: int, role: str, held: list, mine_of: list | None):
        """The value with objects replaced by their hashes; ``held`` gets the rows
        just below, ``mine_of`` all rows of the block around it."""
        if isinstance(value, list):
            at = path.rsplit("/", 1)[-1] == "content"
            return [
                visit(v, f"{path}/{i}", (f"{node_path}.{i}" if node_path else str(i)) if at and node_path is not None else None, i, role if at else "other", held, mine_of)
                for i, v in enumerate(value)
            ]
        if not isinstance(value, dict):
            return value
        kind = text_of(field(value, "type", names))
        own = text_of(value.get("id"))
        block = role == "block"
        if block:
            mine_of = []
            node_path = node_path or "0"  # a lone object
        below: list[list] = []
        flat = {}
        for n, k in enumerate(sorted(value)):
            if role == "message":
                next_role = {"content": "block", "usage": "usage"}.get(k, "other")
            else:
                holds = isinstance(value[k], list) and k == "content" and (role == "part" or block and kind == "tool_result")
                next_role = "part" if holds else "other"
            inner = ("" if role == "message" else node_path) if k == "content" else None
            flat[k] = visit(value[k], path + "/" + k.replace("~", "~0").replace("/", "~1"), inner, n, next_role, below, mine_of)
        text = _canonical(flat)
        me = _hash(text)
        for row in below:
            row[6] = me
        call = own if kind == "tool_use" else text_of(field(value, "tool_use_id", names)) if kind == "tool_result" else None
        row = [
            line_id, storable(path), node_path if role in ("block", "part") else None, role, ordinal, me, None, None,
            storable(kind), storable(own), storable(call), storable(text) if bodies else None,
        ]
        out.append(row)
        held.append(row)
        if mine_of is not None:
            mine_of.append(row)
            if block:
                for r in mine_of:
                    r[7] = me
        return {"#": me}

    visit(message, "", None, 0, "message", [], None)


def bridge(lines: DataFrame, *, id_col="line_id", raw_col="raw", bodies=False, aliases: Aliases = STATED) -> DataFrame:
    """A row per occurrence of every object of the messages; ``bodies`` adds the
    canonical text.  ``aliases`` are other names of types and call ids."""

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # as deep as the parser reads
        for batch in batches:
            out: list[list] = []
            for line_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse(raw)
                message = record.get("message") if record is not None else None
                if isinstance(message, dict):
                    _occurrences(line_id, message, bodies, out, aliases.block)
            yield batch_of(BRIDGE, out)

    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    return source.mapInArrow(run, BRIDGE_DDL)


def objects(bridged: DataFrame) -> DataFrame:
    """Each distinct object once: what it says of itself, its canonical text and
    the number of its occurrences."""
    same = ("node_type", "own_id", "call_id", "body")
    return bridged.groupBy("object_id").agg(*[F.any_value(c).alias(c) for c in same], F.count(F.lit(1)).alias("occurrences"))


def nodes(bridged: DataFrame, stored: DataFrame) -> DataFrame:
    """tool_use and tool_result blocks, and the objects inside results, as
    (line_id, node_path, node_type, ref_id): types and calls come from the stored
    objects, by the identities that the bridge rows carry."""
    said = stored.select("object_id", "node_type", "call_id")
    here = bridged.select("line_id", "node_path", "role", "object_id", "block_object_id")
    blocks = here.where("role = 'block'").join(said.where("node_type in ('tool_use', 'tool_result')"), "object_id")
    calls = said.select(F.col("object_id").alias("block_object_id"), F.col("call_id").alias("ref_id"))
    parts = here.where("role = 'part'").join(said.select("object_id", "node_type"), "object_id").join(calls, "block_object_id")
    out = ["line_id", "node_path", "node_type"]
    return blocks.select(*out, F.col("call_id").alias("ref_id")).unionByName(parts.select(*out, "ref_id"))


def rebuild(bridged: DataFrame, stored: DataFrame) -> DataFrame:
    """(line_id, message): canonical text of each message, from the two tables.

    The bodies of a line's own objects are put into one another, innermost first.
    """
    schema = pa.schema([("line_id", pa.int64()), ("message", pa.string())])

    def whole(flat, bodies: dict):
        if isinstance(flat, list):
            return [whole(x, bodies) for x in flat]
        if isinstance(flat, dict):
            if set(flat) == {"#"} and flat["#"] in bodies:
                return {k: whole(v, bodies) for k, v in json.loads(bodies[flat["#"]]).items()}
            return {k: whole(v, bodies) for k, v in flat.items()}
        return flat

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
        for batch in batches:
            out = []
            for line_id, top, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((line_id, _canonical(whole({"#": top}, {p["object_id"]: p["body"] for p in pairs}))))
            yield batch_of(schema, out)

    held = bridged.select("line_id", "role", "object_id").join(stored.select("object_id", "body"), "object_id")
    by_line = held.groupBy("line_id").agg(
        F.max(F.when(F.col("role") == "message", F.col("object_id"))).alias("top"), F.collect_set(F.struct("object_id", "body")).alias("pairs")
    )
    return by_line.mapInArrow(run, "line_id bigint, message string")


def usage_table(lines: DataFrame, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """Usage of each message as (line_id, message_id, metric, value) rows."""
    schema = pa.schema([("line_id", pa.int64()), ("message_id", pa.string()), ("metric", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for line_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                message = (parse(raw) or {}).get("message")
                usage = message.get("usage") if isinstance(message, dict) else None
                if isinstance(usage, dict):
                    for k, v in usage.items():
                        out.append((line_id, storable(text_of(message.get("id"))), storable(k), storable(json.dumps(v, ensure_ascii=False, separators=(",", ":")))))
            yield batch_of(schema, out)

    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    return source.mapInArrow(run, "line_id bigint, message_id string, metric string, value string")
