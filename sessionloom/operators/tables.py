"""Shared tables of a transcript corpus: lines, blocks, tool uses and results.

Lines are parsed to VARIANT once, JVM-side; a fixed set of hot fields is
promoted, and absent, null and present stay three different things (``k_*``
columns: absent, null, bool, int, float, str, list, dict).  Catalyst prunes the
promoted columns that a query does not read.

Defined cases: blank, cut off and non-object lines are classed and have no
promoted fields; a missing or non-text ``type`` becomes ``<no-type>``; a content
that is no list has no blocks; input columns are only those named here, so
extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: first letters of a variant's schema -> JSON type name
_NAMES = {"VOID": "null", "STRI": "str", "BOOL": "bool", "BIGI": "int", "DECI": "float", "DOUB": "float", "FLOA": "float", "ARRA": "list", "OBJE": "dict"}


def kind(value: Column) -> Column:
    """JSON type name of a variant, ``absent`` where it is missing.

    The schema of a variant is dear for nested values, so it is derived once;
    integers beyond 64 bits show as decimals without fraction.
    """
    shape = F.regexp_replace(F.schema_of_variant(value), r"^DECIMAL\((?:19|[23]\d),0\)$", "BIGINT")
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.substring(shape, 1, 4)), F.lit("absent"))


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text(v: Column, path: str) -> Column:
    """The value if it is text, else null."""
    return F.when(F.schema_of_variant(at(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, path: str) -> Column:
    """The value as an integer, also from text; null otherwise."""
    return F.try_variant_get(v, path, "string").try_cast("bigint")


def true(v: Column, path: str) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(at(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


#: promoted column -> (how, JSON path)
PROMOTED = {
    "uuid": (text, "$.uuid"), "parent_uuid": (text, "$.parentUuid"), "session_id": (text, "$.sessionId"), "ts_text": (text, "$.timestamp"),
    "version": (text, "$.version"), "k_version": (kind, "$.version"), "cwd": (text, "$.cwd"), "git_branch": (text, "$.gitBranch"), "agent_id": (text, "$.agentId"),
    "request_id": (text, "$.requestId"), "prompt_id": (text, "$.promptId"), "source_uuid": (text, "$.sourceToolAssistantUUID"),
    "is_sidechain": (true, "$.isSidechain"), "is_meta": (true, "$.isMeta"), "is_api_error": (true, "$.isApiErrorMessage"),
    "attribution_agent": (text, "$.attributionAgent"), "attribution_server": (text, "$.attributionMcpServer"), "attribution_tool": (text, "$.attributionMcpTool"),
    "attribution_skill": (text, "$.attributionSkill"), "k_message": (kind, "$.message"), "message_id": (text, "$.message.id"), "model": (text, "$.message.model"),
    "k_model": (kind, "$.message.model"), "role": (text, "$.message.role"), "k_stop_reason": (kind, "$.message.stop_reason"),
    "stop_reason": (text, "$.message.stop_reason"), "k_stop_sequence": (kind, "$.message.stop_sequence"), "stop_sequence": (text, "$.message.stop_sequence"),
    "k_content": (kind, "$.message.content"), "k_envelope": (kind, "$.toolUseResult"), "k_usage": (kind, "$.message.usage"),
    "input_tokens": (number, "$.message.usage.input_tokens"), "output_tokens": (number, "$.message.usage.output_tokens"),
    "cache_creation_tokens": (number, "$.message.usage.cache_creation_input_tokens"), "cache_read_tokens": (number, "$.message.usage.cache_read_input_tokens"),
    "k_cache_creation": (kind, "$.message.usage.cache_creation"), "write_5m": (number, "$.message.usage.cache_creation.ephemeral_5m_input_tokens"),
    "write_1h": (number, "$.message.usage.cache_creation.ephemeral_1h_input_tokens"), "subtype": (text, "$.subtype"), "k_subtype": (kind, "$.subtype"),
    "duration_ms": (number, "$.durationMs"), "message_count": (number, "$.messageCount"), "hook_count": (number, "$.hookCount"), "k_hook_count": (kind, "$.hookCount"),
    "k_denial": (kind, "$.toolDenialKind"), "denial": (text, "$.toolDenialKind"), "k_decision": (kind, "$.permissionDecision"),
    "decision": (text, "$.permissionDecision.decision"), "decision_source": (text, "$.permissionDecision.source"), "reason_type": (text, "$.permissionDecision.reasonType"),
    "pr_number": (number, "$.prNumber"), "pr_repository": (text, "$.prRepository"), "ai_title": (text, "$.aiTitle"), "last_prompt": (text, "$.lastPrompt"),
    "speed": (text, "$.message.usage.speed"), "service_tier": (text, "$.message.usage.service_tier"), "inference_geo": (text, "$.message.usage.inference_geo"),
    "searches": (number, "$.message.usage.server_tool_use.web_search_requests"),
    "e_agent_id": (text, "$.toolUseResult.agentId"), "e_total_tokens": (number, "$.toolUseResult.totalTokens"), "e_duration_ms": (number, "$.toolUseResult.totalDurationMs"),
    "e_tool_uses": (number, "$.toolUseResult.totalToolUseCount"), "e_input": (number, "$.toolUseResult.usage.input_tokens"), "e_output": (number, "$.toolUseResult.usage.output_tokens"),
    "e_creation": (number, "$.toolUseResult.usage.cache_creation_input_tokens"), "e_read": (number, "$.toolUseResult.usage.cache_read_input_tokens"),
    "e_start_line": (number, "$.toolUseResult.file.startLine"), "e_num_lines": (number, "$.toolUseResult.file.numLines"), "e_total_lines": (number, "$.toolUseResult.file.totalLines"),
    "e_spill_path": (text, "$.toolUseResult.persistedOutputPath"),
    "first_hook_error": (text, "$.hookErrors[0]"), "k_hook_context": (kind, "$.hookAdditionalContext[0]"), "retry_ms": (number, "$.retryInMs"), "retry_attempt": (number, "$.retryAttempt"),
}


def classified(raw_lines: DataFrame) -> DataFrame:
    """(line_id, file_name, slug, raw, v, class) of every delivered line."""
    v = F.try_parse_json(F.trim("raw"))
    class_ = (
        F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "blank")
        .when(F.col("v").isNull(), "parse_error")
        .when(kind(F.col("v")) == "dict", "object")
        .otherwise("non_object")
    )
    return raw_lines.select(F.col("line_id").cast("bigint").alias("line_id"), "file_name", "slug", "raw", v.alias("v")).withColumn("class", class_)


def lines(raw_lines: DataFrame) -> DataFrame:
    """One row per object line with the promoted fields."""
    df = classified(raw_lines).where("class = 'object'")
    v = F.col("v")
    made = [how(v, path).alias(c) if how is not kind else kind(at(v, path)).alias(c) for c, (how, path) in PROMOTED.items()]
    ts = F.coalesce(F.unix_millis(F.try_to_timestamp(text(v, "$.timestamp"))), F.when(kind(at(v, "$.timestamp")) == "int", F.try_variant_get(v, "$.timestamp", "bigint")))
    return df.select(
        "line_id", "file_name", "slug", "v",
        F.coalesce(text(v, "$.type"), F.lit("<no-type>")).alias("type"),
        F.array_distinct(F.json_object_keys("raw")).alias("keys"),
        F.when(F.col("file_name").contains("/subagents/"), "subagent-trace").otherwise("parent-session").alias("container"),
        ts.alias("ts_ms"), *made,
    )


def blocks(line_table: DataFrame) -> DataFrame:
    """One row per content block of list-shaped contents, with its position."""
    df = line_table.where("k_content = 'list'").withColumn("content", at(F.col("v"), "$.message.content"))
    out = df.sparkSession.sql("select l.*, e.pos, e.value b from {l} l, lateral variant_explode(l.content) e", l=df)
    b = F.col("b")
    return out.select(
        "line_id", "file_name", "slug", "session_id", "type", "is_sidechain", "is_api_error", "ts_ms", "keys", "v", "k_envelope", "container",
        "request_id", "message_id", "pos",
        kind(b).alias("k_block"), text(b, "$.type").alias("block_type"), text(b, "$.id").alias("id"), text(b, "$.name").alias("name"),
        text(b, "$.tool_use_id").alias("tool_use_id"), kind(at(b, "$.is_error")).alias("k_is_error"), true(b, "$.is_error").alias("is_error"),
        kind(at(b, "$.content")).alias("k_inner"), text(b, "$.content").alias("inner_text"), text(b, "$.input.file_path").alias("file_path"),
        text(b, "$.input.command").alias("command"), at(b, "$.content").alias("inner"), text(b, "$.text").alias("block_text"),
    )


def result_texts(block_table: DataFrame) -> DataFrame:
    """(line_id, pos, part, text) of tool results: the string or its text parts."""
    results = block_table.where("block_type = 'tool_result'")
    whole = results.where("k_inner = 'str'").select("line_id", "pos", F.lit(0).alias("part"), F.col("inner_text").alias("text"))
    lists = results.where("k_inner = 'list'").select("line_id", "pos", "inner")
    parts = lists.sparkSession.sql("select l.line_id, l.pos, e.pos part, e.value p from {l} l, lateral variant_explode(l.inner) e", l=lists)
    p = F.col("p")
    return whole.unionByName(
        parts.where(text(p, "$.type") == "text").select("line_id", "pos", "part", text(p, "$.text").alias("text")).where("text is not null")
    )
