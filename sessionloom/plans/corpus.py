"""Queries over a transcript corpus: one statement per operator.

Each statement reads the shared tables (``lines``, ``blocks``, ``uses``,
``results``, ...) and leaves all physical choices to Catalyst.  A statement is
also a check: the same text runs on the checking engine over its own extraction
of the tables (``ORACLE_TABLES``), with overrides where dialects differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import tables
from sessionloom.sources.tables import table

_J = {"text": "case when json_type(raw,'{p}')='VARCHAR' then json_extract_string(raw,'{p}') end", "true": "coalesce(json_type(raw,'{p}')='BOOLEAN' and json_extract_string(raw,'{p}')='true', false)",
      "number": "try_cast(json_extract_string(raw,'{p}') as bigint)"}
_KIND = "case json_type({x}) when 'NULL' then 'null' when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' when 'BIGINT' then 'int' when 'UBIGINT' then 'int' when 'DOUBLE' then 'float' when 'ARRAY' then 'list' when 'OBJECT' then 'dict' else 'absent' end"


def _kind(x: str) -> str:
    return _KIND.format(x=x)


def _oracle_lines() -> str:
    out = []
    for c, (how, path) in tables.PROMOTED.items():
        name = how.__name__
        out.append((_kind(f"raw,'{path}'") if name == "kind" else _J[name].format(p=path)) + f" as {c}")
    return (
        "objects as materialized (select line_id, file_name, slug, raw from transcript_lines where raw is not null and json_valid(raw) and json_type(raw)='OBJECT'), "
        "lines as materialized (select line_id, file_name, slug, raw, coalesce(" + _J["text"].format(p="$.type") + ", '<no-type>') as type, json_keys(raw) as keys, "
        "case when contains(file_name,'/subagents/') then 'subagent-trace' else 'parent-session' end as container, "
        "coalesce(epoch_ms(try_cast(" + _J["text"].format(p="$.timestamp") + " as timestamp)), case when json_type(raw,'$.timestamp') in ('BIGINT','UBIGINT') then json_extract_string(raw,'$.timestamp')::bigint end) as ts_ms, "
        + ", ".join(out)
        + " from objects)"
    )


def _oracle_blocks() -> str:
    t = lambda p: f"case when json_type(b,'{p}')='VARCHAR' then json_extract_string(b,'{p}') end"
    return (
        "exploded as materialized (select l.* exclude(raw), l.raw, unnest(json_extract(raw,'$.message.content[*]')) b, generate_subscripts(json_extract(raw,'$.message.content[*]'),1)-1 pos from lines l where k_content='list'), "
        "blocks as materialized (select line_id, file_name, slug, session_id, type, is_sidechain, is_api_error, ts_ms, keys, raw, k_envelope, container, request_id, message_id, pos, "
        + _kind("b") + " k_block, " + t("$.type") + " block_type, " + t("$.id") + " id, " + t("$.name") + " name, " + t("$.tool_use_id") + " tool_use_id, "
        + _kind("b,'$.is_error'") + " k_is_error, coalesce(json_type(b,'$.is_error')='BOOLEAN' and json_extract_string(b,'$.is_error')='true', false) is_error, "
        + _kind("b,'$.content'") + " k_inner, " + t("$.content") + " inner_text, " + t("$.input.file_path") + " file_path, " + t("$.input.command") + " command, json_extract(b,'$.content') inner_json, " + t("$.text") + " block_text from exploded)"
    )


#: statements both engines share for derived tables
DERIVED = {
    "uses": "select * from (select *, row_number() over (partition by file_name, id order by line_id desc, pos desc) rn from blocks where block_type='tool_use' and id is not null) where rn=1",
    "results": "select * from blocks where block_type='tool_result'",
    "turns": "select * from (select *, row_number() over (partition by file_name, message_id order by coalesce(output_tokens,0) desc, line_id desc) rn from lines where type='assistant' and message_id is not null and not is_api_error and k_usage='dict') where rn=1",
    "texts": "",
}
_ORACLE_TEXTS = (
    "texts as materialized (select line_id, pos, 0 part, inner_text \"text\" from blocks where block_type='tool_result' and k_inner='str' union all "
    "select line_id, pos, part, json_extract_string(p,'$.text') from (select line_id, pos, unnest(json_extract(inner_json,'$[*]')) p, generate_subscripts(json_extract(inner_json,'$[*]'),1)-1 part from blocks where block_type='tool_result' and k_inner='list') "
    "where json_type(p,'$.type')='VARCHAR' and json_extract_string(p,'$.type')='text' and json_type(p,'$.text')='VARCHAR')"
)


@dataclass(frozen=True)
class Statement:
    """One operator as a statement; ``oracle`` overrides the checking text."""

    sql: str
    oracle: str | None = None

    def names(self) -> list[str]:
        words = set(re.findall(r"\b[a-z_0-9]+\b", self.sql))
        return [n for n in ("lines", "blocks", "uses", "results", "turns", "texts", "classes") if n in words]


#: what each shared table is made from
_FROM = {"lines": None, "classes": None, "blocks": "lines", "uses": "blocks", "results": "blocks", "texts": "blocks", "turns": "lines"}


def shared(spark: SparkSession, folder: str, wanted: list[str]) -> dict[str, DataFrame]:
    """The shared tables that a statement names, each made once."""
    raw = table(spark, folder, "transcript_lines")
    made: dict[str, DataFrame] = {}

    def make(name: str) -> DataFrame:
        if name not in made:
            source = make(_FROM[name]) if _FROM[name] else raw
            if name in DERIVED_TABLES:
                made[name] = DERIVED_TABLES[name](source)
            else:
                made[name] = spark.sql(DERIVED[name].replace(f"from {_FROM[name]}", "from {src}"), src=source)
        return made[name]

    for name in wanted:
        make(name)
    return made


DERIVED_TABLES = {"lines": tables.lines, "classes": tables.classified, "blocks": tables.blocks, "texts": tables.result_texts}


def run(spark: SparkSession, folder: str, statement: Statement) -> DataFrame:
    """Run a statement over the tables of a folder."""
    wanted = statement.names()
    made = shared(spark, folder, wanted)
    args, sql = {}, statement.sql.replace("{", "{{").replace("}", "}}")
    for name in [*wanted, *PLAIN]:
        if re.search(rf"\b(from|join)\s+{name}\b", sql):
            sql = re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", sql)
            args[name] = made[name] if name in made else _timed(table(spark, folder, name))
    return spark.sql(sql, **args)


PLAIN = ("dispatch", "judge", "manifests", "documents", "events", "schema_baseline", "lineitem", "orders")


def _timed(df: DataFrame) -> DataFrame:
    """Timestamps without a zone read as UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def oracle(statement: Statement) -> str:
    """The checking text: extraction of the shared tables, then the statement."""
    text = statement.oracle or statement.sql
    words = set(re.findall(r"\b[a-z_0-9]+\b", text))
    parts = []
    if words & {"lines", "blocks", "uses", "results", "turns", "texts"}:
        parts.append(_oracle_lines())
    if words & {"blocks", "uses", "results", "texts"}:
        parts.append(_oracle_blocks())
    parts += [f"{n} as materialized ({DERIVED[n]})" for n in ("uses", "results", "turns") if n in words]
    if "texts" in words:
        parts.append(_ORACLE_TEXTS)
    if "classes" in words:
        parts.append(
            "classes as (select line_id, file_name, slug, case when trim(coalesce(raw,''))='' then 'blank' when not json_valid(raw) then 'parse_error' when json_type(raw)='OBJECT' then 'object' else 'non_object' end as \"class\" from transcript_lines)"
        )
    if not parts:
        return text
    if text.lstrip().lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + text.lstrip()[5:]
    return "with " + ", ".join(parts) + " " + text
