"""The statements of the reference's operators, by operator id."""

from __future__ import annotations

import re

from sessionloom.plans.corpus import Statement

S = Statement

#: Allowlists and markers that reports may show.
STOP_REASONS = "'end_turn','max_tokens','stop_sequence','tool_use','pause_turn','refusal','model_context_window_exceeded'"
SUBTYPES = "'stop_hook_summary','turn_duration','informational','compact_boundary','away_summary','local_command'"
HOOK_KEYS = ("hookAdditionalContext", "hookCount", "hookErrors", "hookInfos", "preventContinuation", "preventedContinuation")
STRIPPED = "'file-history-snapshot','attachment','api-request','api-request-blob','api-request-shape'"
PERSISTED = ("<persisted-output", "</persisted-output>", "persisted-output", "persisted_output", "Preview (first", "Preview of", "tool-results/", "characters truncated", "truncated", "saved to", "output exceeds", "[Tool")
HOOK_FAILURE = "Failed with non-blocking status code: "
#: Denial markers in order; the first that matches names the text.
MARKERS = (
    ("hook-error-prefix", r"^(Error: )?[A-Za-z]+(:[^\\s]+)? hook error:"),
    ("user-declined", r"(?i)user doesn''t want to (proceed|take this action)"),
    ("blocked-by-hook-phrase", r"(?i)blocked by\\b.{0,80}\\bhook"),
    ("has-been-denied-phrase", "(?i)has been denied"),
    ("permission-phrase", "(?i)permission"),
    ("denied-phrase", "(?i)denied"),
    ("blocked-phrase", "(?i)blocked"),
)


def _fold(value: str, kind: str, allowed: str) -> str:
    return f"case when {kind}='absent' then '<absent>' when {kind}='null' then '<null>' when {value} in ({allowed}) then {value} else '<other>' end"


_has = lambda k: f"array_contains(keys, '{k}')"
_any_hook = "(" + " or ".join(_has(k) for k in HOOK_KEYS) + ")"
_shape = "concat_ws('+', " + ", ".join(f"case when {_has(k)} then '{k}' end" for k in HOOK_KEYS) + ")"
_model = "case when k_model in ('absent','null') then 'absent' when model='<synthetic>' then 'synthetic' else 'real' end"
_main = "coalesce(not is_sidechain, true)"
_MARK_SPARK = "case " + " ".join(f"when rlike(t, '{p}') then '{n}'" for n, p in MARKERS) + " else 'no-marker' end"
_MARK_DUCK = "case " + " ".join(f"when regexp_matches(t, '{p.replace(chr(92) * 2, chr(92))}') then '{n}'" for n, p in MARKERS) + " else 'no-marker' end"
_VKEY = "try_cast(split_part(version,'.',1) as bigint) * 1000000000000 + try_cast(split_part(version,'.',2) as bigint) * 1000000 + try_cast(split_part(version,'.',3) as bigint)"
_VERSIONED = "k_version='str' and {m}"
_vs, _vd = _VERSIONED.format(m="rlike(version, '^[0-9]+\\\\.[0-9]+\\\\.[0-9]+\\\\z')"), _VERSIONED.format(m="regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+')")


def _both(sql: str, spark: dict[str, str], duck: dict[str, str]) -> Statement:
    a = b = sql
    for k, v in spark.items():
        a = a.replace(k, v)
    for k, v in duck.items():
        b = b.replace(k, v)
    return S(a, b)


def _markers(column: str) -> str:
    return ", ".join(f"count(*) filter (where contains({column}, '{m}')) as m{i}" for i, m in enumerate(PERSISTED))


# AG-27: lines with a denial kind, the first result block of each, by kind
_DENIALS = (
    "with denied as (select line_id, case when k_denial='null' then '<null>' when k_denial='str' and ENUM then denial when k_denial='str' then concat('<non-enum len=', length(denial), '>') else '<other>' end kind, "
    f"case when VOK then version end version, case when VOK then {_VKEY} end o from lines where k_denial<>'absent'), "
    "blocks_of as (select line_id, count(*) over (partition by line_id) n, row_number() over (partition by line_id order by pos) rn, k_is_error, is_error, left(coalesce(case when k_inner='str' then inner_text when k_inner='list' then PARTS end, ''), 300) t "
    "from results r where line_id in (select line_id from denied)), "
    "firsts as (select d.line_id, d.kind, d.version, d.o, coalesce(b.n, 0) > 1 multi, case when b.n is null then '<no-tool-result>' when k_is_error='absent' then '<absent>' when k_is_error='null' then '<null>' when k_is_error='bool' then cast(is_error as TEXT) else '<other>' end error_label, "
    "case when b.n is null then '<no-tool-result>' else MARK end marker from denied d left join (select * from blocks_of where rn=1) b on d.line_id=b.line_id), "
    "errors as (select kind, HIST is_errors from (select kind, error_label label, count(*) n from firsts group by 1, 2) group by kind), marks as (select kind, HIST markers from (select kind, marker label, count(*) n from firsts group by 1, 2) group by kind) "
    "select k.kind, k.denials, k.first_version, k.last_version, k.versions, e.is_errors, m.markers, k.multi_block_lines from (select kind, count(*) denials, min_by(version, o) first_version, max_by(version, o) last_version, "
    "count(distinct version) versions, count(*) filter (where multi) multi_block_lines from firsts group by kind) k join errors e on k.kind=e.kind join marks m on k.kind=m.kind"
)
_CYCLE = (
    "select coalesce(u.name,'<unnamed>') tool, count(*) results, count(*) filter (where shape='dict') env_dict, count(*) filter (where shape='null') env_null, count(*) filter (where shape='absent') env_absent, count(*) filter (where shape='non_dict') env_non_dict, "
    "count(*) filter (where shape='ambiguous') env_ambiguous, count(*) filter (where shape='dict' and patch) structured_patch, count(*) filter (where shape='dict' and asked) prompt, count(*) filter (where shape='dict' and stats) tool_stats "
    "from (select file_name, tool_use_id, patch, asked, stats, case when k_envelope in ('absent','null') then k_envelope when count(*) over (partition by line_id) > 1 then 'ambiguous' when k_envelope='dict' then 'dict' else 'non_dict' end shape "
    "from (select line_id, file_name, tool_use_id, k_envelope, KEY(structuredPatch) patch, KEY(prompt) asked, KEY(toolStats) stats from results)) r join uses u on r.file_name=u.file_name and r.tool_use_id=u.id group by 1"
)


def _keyed(form: str) -> dict[str, str]:
    return {f"KEY({k})": form.format(k=k) for k in ("structuredPatch", "prompt", "toolStats")}


PROFILE: dict[str, Statement] = {
    "src04_line_classes": S("select class, count(*) n from classes group by class", "select \"class\", count(*) n from classes group by \"class\""),
    "src12_result_texts": S("select count(*) texts, sum(length(text)) chars, count(distinct line_id) lines_with from texts"),
    "ag01_totals": S("select count(distinct file_name) files, count(*) lines_seen, count(distinct slug) slugs, count(distinct session_id) sessions from lines"),
    "ag02_types": S("select type, count(*) n from lines group by type"),
    "ag03_keys": S("select k, count(*) n from (select explode(keys) k from lines) group by k", "select k, count(*) n from (select unnest(keys) k from lines) group by k"),
    "ag04_type_keys": S("select type, k, count(*) n from (select type, explode(keys) k from lines) group by type, k", "select type, k, count(*) n from (select type, unnest(keys) k from lines) group by type, k"),
    "ag05_block_types": S("select coalesce(block_type,'<no-type>') block_type, count(*) n from blocks where k_block='dict' group by 1"),
    "ag06_result_line_keys": S("select k, count(*) n from (select explode(keys) k from blocks where block_type='tool_result') group by k", "select k, count(*) n from (select unnest(keys) k from blocks where block_type='tool_result') group by k"),
    "ag07_system_subtypes": _both(f"select {_fold('subtype', 'k_subtype', SUBTYPES)} label, count(*) every, count(*) filter (where HOOK) with_hook_key, count(*) filter (where HAS) in_family from lines where type='system' group by 1", {"HOOK": _any_hook, "HAS": _has("hookCount")}, {"HOOK": _any_hook.replace("array_contains", "list_contains"), "HAS": _has("hookCount").replace("array_contains", "list_contains")}),
    "ag08_hook_shapes": _both("select SHAPE as shape, count(*) n from lines where HOOK group by 1", {"SHAPE": _shape, "HOOK": _any_hook}, {"SHAPE": _shape.replace("array_contains", "list_contains"), "HOOK": _any_hook.replace("array_contains", "list_contains")}),
    "ag09_denials": S("select " + _fold("denial", "k_denial", "'permission-rule'") + " label, count(*) n, count(*) filter (where k_content='list') with_list from lines group by 1"),
    "ag10_versions": S("select version, count(*) n from lines where version is not null group by version"),
    "ag11_turn_lines": S("select type, count(*) n, count(*) filter (where is_sidechain) sidechain, count(*) filter (where is_api_error) api_error from lines where type in ('assistant','user') and k_message='dict' group by type"),
    "ag12_stop_reasons": S(f"select {_model} bucket, {_fold('stop_reason', 'k_stop_reason', STOP_REASONS)} label, count(*) n from lines where type='assistant' and k_message='dict' group by 1, 2"),
    "ag12_stop_presence": S("select case k_stop_reason when 'absent' then 'absent' when 'null' then 'null' else 'value' end state, count(*) n from lines where type='assistant' and k_message='dict' group by 1"),
    "ag13_stop_sequences": S(f"select {_model} bucket, case when k_stop_sequence='absent' then 'absent' when k_stop_sequence='null' then 'null' when k_stop_sequence<>'str' then 'non_string' when stop_sequence='' then 'empty_string' else 'non_empty_string' end state, count(*) n from lines where type='assistant' and k_message='dict' group by 1, 2"),
    "ag14_content_shapes": S("select case when k_content in ('list','str','null','absent') then k_content else 'other' end shape, count(*) n from lines where type='user' and k_message='dict' group by 1"),
    "ag15_tool_cycle": S("select coalesce(u.name,'<unnamed>') tool, count(*) results, count(*) filter (where r.k_envelope='dict') as env_dict, count(*) filter (where r.k_envelope='null') as env_null, count(*) filter (where r.k_envelope='absent') as env_absent, count(*) filter (where r.k_envelope not in ('dict','null','absent')) as env_non_dict from results r join uses u on r.file_name=u.file_name and r.tool_use_id=u.id group by 1"),
    "ag16_identity": S("select count(*) blocks_seen, count(u.id) resolved, count(*) filter (where u.id is null) orphaned from results r left join uses u on r.file_name=u.file_name and r.tool_use_id=u.id"),
    "ag22_zero_seeded": S("select l.label, coalesce(c.n, 0) n from (values ('end_turn'),('max_tokens'),('stop_sequence'),('tool_use'),('pause_turn'),('refusal'),('model_context_window_exceeded')) l(label) left join (select stop_reason label, count(*) n from lines where type='assistant' group by 1) c on l.label=c.label"),
    "ag23_markers": S(f"select count(*) n, {_markers('text')} from texts"),
    "ag24_tags": S("select tag, count(*) n from (select explode(regexp_extract_all(lower(text), '(<[^>\\\\n]{1,40}>)', 1)) tag from texts where contains(text,'persist') or contains(text,'output')) where contains(tag,'persist') or contains(tag,'output') group by tag", "select tag, count(*) n from (select unnest(regexp_extract_all(lower(text), '<[^>\\n]{1,40}>')) tag from texts where contains(text,'persist') or contains(text,'output')) where contains(tag,'persist') or contains(tag,'output') group by tag"),
    "ag27_denial_markers": S(f"select marker, count(*) n from (select {_MARK_SPARK} marker from (select left(text, 300) t from texts)) group by marker", f"select marker, count(*) n from (select {_MARK_DUCK} marker from (select left(text, 300) t from texts)) group by marker"),
    "ag15_cycle_keys": _both(_CYCLE, _keyed("try_variant_get(v, '$.toolUseResult.{k}', 'variant') is not null"), _keyed("json_type(raw,'$.toolUseResult.{k}') is not null")),
    "ag27_denials": _both(
        _DENIALS,
        {"ENUM": "rlike(denial, '^[a-z][a-z0-9_-]{0,39}\\\\z')", "VOK": _vs, "TEXT": "string", "MARK": _MARK_SPARK, "HIST": "array_join(array_sort(collect_list(concat(label, '=', n))), ', ')", "PARTS": "try_variant_get(get(filter(try_variant_get(inner, '$', 'array<variant>'), x -> coalesce(schema_of_variant(try_variant_get(x, '$.text', 'variant'))='STRING', false)), 0), '$.text', 'string')"},
        {"ENUM": "regexp_full_match(denial, '[a-z][a-z0-9_-]{0,39}')", "VOK": _vd, "TEXT": "varchar", "MARK": _MARK_DUCK, "HIST": "string_agg(concat(label, '=', n), ', ' order by concat(label, '=', n))", "PARTS": "(select json_extract_string(p,'$.text') from (select unnest(json_extract(inner_json,'$[*]')) p, generate_subscripts(json_extract(inner_json,'$[*]'),1) i) where json_type(p,'$.text')='VARCHAR' order by i limit 1)"},
    ),
    "prj06_tool_fold": S("select case when name in ('Edit','Agent') then name else '<other>' end tool, count(*) n from uses group by 1"),
    "prj13_envelopes": S("select case when n > 1 and k_envelope not in ('absent','null') then 'ambiguous_multi_block' when k_envelope in ('dict','null','absent') then k_envelope else 'non_dict' end shape, count(*) n from (select line_id, k_envelope, count(*) n from results group by line_id, k_envelope) group by 1"),
    "prj15_result_lines": S("select count(distinct line_id) n from results"),
    "prj18_containers": S("select container, count(*) n, count(distinct file_name) files from lines group by container"),
    "prj22_error_labels": S("select case k_is_error when 'absent' then '<absent>' when 'null' then '<null>' when 'bool' then cast(is_error as string) else '<other>' end label, count(*) n from results group by 1", "select case k_is_error when 'absent' then '<absent>' when 'null' then '<null>' when 'bool' then cast(is_error as varchar) else '<other>' end label, count(*) n from results group by 1"),
    "prj25_id_tails": S("select case when length(id) > 8 then concat('…', right(id, 8)) else id end tail, count(*) n from uses group by 1"),
    "flt01_stripped": S(f"select type in ({STRIPPED}) stripped, count(*) n from lines group by 1"),
    "flt02_main_thread": S("select count(*) n from lines where not is_sidechain"),
    "flt03_no_api_errors": S("select count(*) n from lines where type='assistant' and not is_api_error and coalesce(model,'')<>'<synthetic>'"),
    "jn02_orphans": S("select r.is_sidechain, count(*) n from results r left join uses u on r.file_name=u.file_name and r.tool_use_id=u.id where u.id is null group by 1"),
    "jn03_interrupted": S("select u.name, count(*) n from uses u left join (select distinct file_name, tool_use_id from results) r on u.file_name=r.file_name and u.id=r.tool_use_id where r.tool_use_id is null group by 1"),
    "jn08_source_pairs": S("select count(*) n, count(distinct a.file_name) files from (select distinct file_name, source_uuid from lines where source_uuid is not null) a join (select distinct file_name, uuid from lines where type='assistant' and uuid is not null) b on a.file_name=b.file_name and a.source_uuid=b.uuid"),
    "jn21_prs": S("select distinct session_id, pr_repository, pr_number from lines where type='pr-link'"),
    "set01_new_keys": S("select k from (select distinct explode(keys) k from lines) except select field_path from schema_baseline", "select k from (select distinct unnest(keys) k from lines) except select field_path from schema_baseline"),
    "set02_removed_keys": S("select field_path k from schema_baseline where not contains(field_path,'.') except select k from (select distinct explode(keys) k from lines)", "select field_path k from schema_baseline where not contains(field_path,'.') except select k from (select distinct unnest(keys) k from lines)"),
    "st02_version_order": S(f"select version, row_number() over (order by {_VKEY}) place from (select distinct version, k_version from lines) where {_vs}", f"select version, row_number() over (order by {_VKEY}) place from (select distinct version, k_version from lines) where {_vd}"),
    "set05_versions_per_file": S("select file_name, count(distinct version) n from lines group by file_name having count(distinct version) > 1"),
}

METRICS: dict[str, Statement] = {
    "mt01_snapshots": S("select file_name, message_id, line_id, coalesce(output_tokens,0) as output_tokens from turns"),
    "mt02_tokens": S("select container, sum(coalesce(input_tokens,0)) input, sum(coalesce(output_tokens,0)) output, sum(coalesce(cache_creation_tokens,0)) creation, sum(coalesce(cache_read_tokens,0)) cache_read, count(*) n from turns group by container"),
    "mt03_session_totals": S("select session_id, sum(coalesce(input_tokens,0)+coalesce(output_tokens,0)+coalesce(cache_creation_tokens,0)+coalesce(cache_read_tokens,0)) tokens, count(*) turns_seen from turns group by session_id"),
    "mt04_peak_context": S("select file_name, max(coalesce(input_tokens,0)+coalesce(cache_creation_tokens,0)+coalesce(cache_read_tokens,0)) peak, max_by(coalesce(input_tokens,0)+coalesce(cache_creation_tokens,0)+coalesce(cache_read_tokens,0), line_id) final from turns group by file_name"),
    "mt06_naive_inflation": S("select l.file_name, cast(sum(coalesce(l.output_tokens,0)) as bigint) naive, cast(max(t.kept) as bigint) kept from lines l join (select file_name, sum(coalesce(output_tokens,0)) kept from turns group by file_name) t on l.file_name=t.file_name where l.type='assistant' and l.k_usage='dict' and not l.is_api_error and l.message_id is not null group by l.file_name"),
    "mt07_cost": S("select t.model, count(*) n, round(sum((coalesce(t.input_tokens,0)*r.input + coalesce(t.output_tokens,0)*r.output + coalesce(t.cache_read_tokens,0)*r.input*0.1 + case when t.k_cache_creation='dict' then coalesce(t.write_5m,0)*r.input*1.25 + coalesce(t.write_1h,0)*r.input*2 else coalesce(t.cache_creation_tokens,0)*r.input*1.25 end)/1000000.0), 4) cost from turns t join (values ('quill-large-4', 5.0D, 25.0D), ('quill-medium-4', 3.0D, 15.0D), ('quill-medium-5', 3.0D, 15.0D), ('quill-small-4', 1.0D, 5.0D)) r(model, input, output) on t.model=r.model group by t.model", "select t.model, count(*) n, round(sum((coalesce(t.input_tokens,0)*r.input + coalesce(t.output_tokens,0)*r.output + coalesce(t.cache_read_tokens,0)*r.input*0.1::double + case when t.k_cache_creation='dict' then coalesce(t.write_5m,0)*r.input*1.25::double + coalesce(t.write_1h,0)*r.input*2 else coalesce(t.cache_creation_tokens,0)*r.input*1.25::double end)/1000000.0::double), 4) \"cost\" from turns t join (values ('quill-large-4', 5.0::double, 25.0::double), ('quill-medium-4', 3.0::double, 15.0::double), ('quill-medium-5', 3.0::double, 15.0::double), ('quill-small-4', 1.0::double, 5.0::double)) r(model, input, output) on t.model=r.model group by t.model"),
    "mt10_cache_reuse": S("select file_name, round(cast(sum(coalesce(cache_read_tokens,0)) as double) / nullif(cast(sum(coalesce(cache_creation_tokens,0)) as double), 0), 6) reuse from turns group by file_name"),
    "mt11_cache_split": S("select line_id, write_5m, write_1h from turns where k_cache_creation='dict'"),
    "mt12_turn_table": S("select line_id, ts_ms, model, coalesce(input_tokens,0) as input_tokens, coalesce(output_tokens,0) as output_tokens, coalesce(cache_creation_tokens,0) as creation, coalesce(cache_read_tokens,0) as cache_read from lines where type='assistant' and not is_sidechain and not is_api_error"),
    "mt14_tools": S("select name, count(*) n from blocks where block_type='tool_use' group by name"),
    "st05_top_tools": S("select name, count(*) n from blocks where block_type='tool_use' group by name order by n desc, name limit 5"),
    "mt17_parallel": S("select count(*) requests, count(*) filter (where n > 1) parallel, max(n) most from (select coalesce(request_id, message_id) r, count(*) n from blocks where type='assistant' and block_type='tool_use' and coalesce(request_id, message_id) is not null group by 1)"),
    "mt18_turn_count": S("select file_name, count(distinct coalesce(request_id, message_id)) turns_seen, count(*) assistant_lines from lines where type='assistant' group by file_name"),
    "mt19_error_rate": S("select u.name tool, count(*) calls, count(*) filter (where r.is_error) errors, round(count(*) filter (where r.is_error) / cast(count(*) as double), 6) rate from results r join uses u on r.file_name=u.file_name and r.tool_use_id=u.id group by u.name"),
    "mt20_retry_rate": S("select tool, count(*) filter (where is_error) errors, count(*) filter (where before > 0) retries from (select *, coalesce(sum(case when is_error then 1 else 0 end) over (partition by session_id, tool order by line_id, pos rows between unbounded preceding and 1 preceding), 0) before from (select u.session_id, u.name tool, u.line_id, u.pos, coalesce(max(case when r.is_error then 1 else 0 end), 0) = 1 is_error from uses u left join results r on u.file_name=r.file_name and u.id=r.tool_use_id group by u.session_id, u.name, u.line_id, u.pos, u.id, u.file_name)) group by tool"),
    "mt21_loose_retry": S("select name, count(*) n from (select name, lag(name) over (partition by session_id order by line_id, pos) before from uses) where name=before group by name"),
    "mt22_turns_by_agent": S("select coalesce(attribution_agent,'(main loop)') agent, is_sidechain, count(*) n from lines where type='assistant' group by 1, 2"),
    "mt23_mcp_turns": S("select split_part(name,'__',2) server, split_part(name,'__',3) tool, count(*) n from uses where left(name, 5)='mcp__' group by 1, 2"),
    "mt24_skill_turns": S("select file_name, attribution_skill, is_sidechain, count(*) n from lines where attribution_skill is not null group by 1, 2, 3"),
    "mt25_first_seen": S(f"select k, min_by(version, o) version from (select explode(keys) k, version, {_VKEY} o from lines where {_vs}) group by k", f"select k, min_by(version, o) \"version\" from (select unnest(keys) k, version, {_VKEY} o from lines where {_vd}) group by k"),
    "mt26_segments": S("select slug, count(*) filter (where gap is null or gap > 3600000) segments, count(*) prompts from (select slug, ts_ms - lag(ts_ms) over (partition by slug order by ts_ms, line_id) gap from lines where type='user' and prompt_id is not null and k_content='str' and ts_ms is not null and not is_sidechain) group by slug"),
    "mt27_verification": S("select session_id, count(*) edits, count(*) filter (where checked > 0) checked_after from (select session_id, name, coalesce(sum(case when name in ('Read','Grep') then 1 else 0 end) over (partition by session_id order by line_id, pos rows between 1 following and unbounded following), 0) checked from uses) where name='Edit' group by session_id"),
    "mt28_rework": S("select session_id, file_path, count(*) n from uses where name='Edit' and file_path is not null group by session_id, file_path having count(*) > 1"),
    "mt29_difficulty": S("select session_id, count(distinct file_path) files, count(distinct name) tools, count(*) calls from uses group by session_id"),
    "mt30_turn_durations": S("select session_id, count(*) n, sum(duration_ms) ms, sum(message_count) messages, round(cast(sum(message_count) as double)*1000/nullif(sum(duration_ms),0), 6) per_second from lines where subtype='turn_duration' group by session_id"),
    "mt32_trace_duration": S("select file_name, max(ts_ms)-min(ts_ms) ms from lines where container='subagent-trace' and ts_ms is not null group by file_name"),
    "mt32_gaps": S("select file_name, max(gap) longest from (select file_name, ts_ms - lag(ts_ms) over (partition by file_name order by ts_ms, line_id) gap from lines where ts_ms is not null) group by file_name"),
    "mt33_hook_outcomes": S(f"select case when first_hook_error is null and k_hook_context<>'absent' then 'context' when first_hook_error is null then 'allowed' when left(first_hook_error, {len(HOOK_FAILURE)})='{HOOK_FAILURE}' then 'failed' else 'blocked' end outcome, count(*) n, sum(hook_count) hooks from lines where subtype='stop_hook_summary' group by 1"),
    "mt34_decisions": S("select decision, decision_source, reason_type, count(*) n from lines where k_decision='dict' group by 1, 2, 3"),
    "mt35_api_retries": S("select count(*) n, count(retry_ms) retries, sum(retry_ms) ms, max(retry_attempt) most from lines where type='system'"),
    "mt37_session_index": S("select session_id, max_by(ai_title, case when ai_title is not null then line_id end) title, max_by(git_branch, case when git_branch is not null then line_id end) branch, count(*) n, max(ts_ms) last_activity from lines group by session_id"),
    "mt41_usage": S("select line_id, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens from lines where type='assistant' and k_usage='dict'"),
    "mt42_events": S("select line_id, pos, 'call' event, id, name, false is_error from blocks where block_type='tool_use' union all select line_id, pos, 'result' event, tool_use_id id, null name, is_error from blocks where block_type='tool_result'"),
    "mt43_trace_turns": S("select file_name, count(*) assistant_lines from lines where container='subagent-trace' and type='assistant' group by file_name"),
    "w10_block_position": S("select line_id, pos, row_number() over (partition by request_id order by line_id, pos) place from blocks where request_id is not null and type='assistant'"),
}

_FIRINGS = (
    "firings as (select session_id, pid, FIRST(tool_use_id) tool_use_id, FIRST(hook_event) event, FIRST(tool) tool, FIRST(route) route, min(case when phase='enter' then ts_ms end) start_ms, "
    "max(case when phase<>'enter' then ts_ms end) end_ms, max_by(decision, case when decision is not null then o end) decision, count(*) filter (where phase='killed') killed, count(*) filter (where phase='exit') exits, max_by(duration_ms, case when duration_ms is not null then o end) duration_ms "
    "from (select *, row_number() over (partition by session_id, pid order by ts_ms, phase, coalesce(hook_event,''), coalesce(tool_use_id,''), coalesce(decision,''), coalesce(duration_ms,-1)) o from dispatch) group by session_id, pid)"
)
#: the value on the first line of a firing, even if it is null
_FIRINGS_DUCK = re.sub(r"FIRST\((\w+)\)", r"(min_by({'v': \1}, o)).v", _FIRINGS)
_FIRINGS = re.sub(r"FIRST\((\w+)\)", r"min_by(struct(\1), o).\1", _FIRINGS)


def _fired(sql: str) -> Statement:
    return S(f"with {_FIRINGS} {sql}", f"with {_FIRINGS_DUCK} {sql}")


FIRINGS = _fired("select * from firings")
_P90_DUCK = "list_sort(list(v) filter (where v is not null))[cast(round_even(0.9::double*(count(v)-1),0) as int)+1]"

CAPTURE: dict[str, Statement] = {
    "ag28_firings": _fired("select session_id, pid, tool_use_id, event, tool, route, decision, start_ms, end_ms, killed, exits from firings"),
    "ag29_durations": S(
        "with d as (select coalesce(hook_event,'-') hook_event, duration_ms v, count(*) c from dispatch where duration_ms is not null group by 1, 2), "
        "r as (select *, sum(c) over (partition by hook_event order by v) upto, sum(c) over (partition by hook_event) every from d) "
        "select hook_event, sum(c) n, percentile(v, 0.5D, c) med, min(case when upto >= cast(bround(0.9D*(every-1)) as int)+1 then v end) p90, min(v) least, max(v) most from r group by hook_event",
        f"select hook_event, count(v) n, median(v) med, {_P90_DUCK} p90, min(v) least, max(v) most from (select coalesce(hook_event,'-') hook_event, duration_ms v from dispatch where duration_ms is not null) group by hook_event",
    ),
    "ag30_decisions": S("select hook_event, tool, route, decision, exit_signal, phase, count(*) n from dispatch group by 1, 2, 3, 4, 5, 6"),
    "ag32_judge_totals": S("select model, count(*) requests, sum(coalesce(usage.input_tokens,0)) input, sum(coalesce(usage.output_tokens,0)) output, sum(coalesce(usage.cache_creation_input_tokens,0)) creation, sum(coalesce(usage.cache_read_input_tokens,0)) cache_read from judge group by model"),
    "ag35_session_tallies": S("select session_id, count(*) n, count(*) filter (where type='system') system_lines, count(*) filter (where k_hook_count<>'absent') hook_lines from lines group by session_id"),
    "ag37_overhead": _fired("select session_id, pid, round(end_ms - start_ms - duration_ms, 1) + 0.0 overhead from firings where end_ms is not null and start_ms is not null and duration_ms is not null"),
    "jn14_overlaps": _fired("select session_id, pid, start_ms <= max(coalesce(end_ms, start_ms)) over (partition by session_id order by start_ms, pid rows between unbounded preceding and 1 preceding) is_overlap from firings where start_ms is not null"),
    "jn14_firing_overlaps": S(
        f"with {_FIRINGS} select session_id, pid, coalesce(start_ms <= max(coalesce(end_ms, start_ms)) over (partition by session_id order by start_ms, pid rows between unbounded preceding and 1 preceding), false) "
        "or coalesce(lead(start_ms) over (partition by session_id order by start_ms, pid) <= coalesce(end_ms, start_ms), false) is_overlap from firings where start_ms is not null",
        f"with {_FIRINGS_DUCK}, p as (select a.session_id, a.pid a_pid, b.pid b_pid from firings a join firings b on a.session_id is not distinct from b.session_id and (a.start_ms < b.start_ms or a.start_ms = b.start_ms and a.pid < b.pid) and b.start_ms <= coalesce(a.end_ms, a.start_ms)) "
        "select session_id, pid, exists (select 1 from p where p.session_id is not distinct from f.session_id and (a_pid=pid or b_pid=pid)) is_overlap from firings f where start_ms is not null",
    ),
    "jn15_asof_back": S("select session_id, ts_ms, phase, pid, max(case when hook_event='PreToolUse' and phase='exit' then ts_ms end) over (partition by session_id order by ts_ms range between unbounded preceding and 1 preceding) before from (select session_id, cast(floor(ts_ms) as bigint) ts_ms, phase, pid, hook_event from dispatch)"),
    "jn16_tool_decisions": S(
        f"with {_FIRINGS} select u.id, u.name, x.f.route, x.f.decision from (select id, max_by(name, struct(line_id, pos)) name from uses group by id) u left join (select tool_use_id, max_by(struct(route, decision), struct(start_ms, session_id, pid)) f from firings where event='PreToolUse' group by tool_use_id) x on u.id=x.tool_use_id",
        f"with {_FIRINGS_DUCK} select u.id, u.name, f.route, f.decision from (select id, name from (select id, name, row_number() over (partition by id order by line_id desc, pos desc) rn from uses) where rn=1) u "
        "left join (select * from (select *, row_number() over (partition by tool_use_id order by start_ms desc nulls last, session_id desc nulls last, pid desc) rn from firings where event='PreToolUse') where rn=1) f on u.id=f.tool_use_id",
    ),
    "jn17_asof_forward": S("select session_id, ts_ms, pid, min(case when phase='exit' then ts_ms end) over (partition by session_id, hook_event order by ts_ms range between 1 following and unbounded following) next from (select session_id, cast(floor(ts_ms) as bigint) ts_ms, phase, pid, hook_event from dispatch) where session_id is not null"),
    "jn18_range": _fired("select f.session_id, f.pid, count(j.ts_ms) calls from firings f join judge j on f.session_id=j.session_id and f.start_ms < j.ts_ms and j.ts_ms < f.end_ms group by f.session_id, f.pid"),
    "jn19_silent_allow": _fired("select a.session_id, a.pid, a.tool_use_id from firings a where a.event='PreToolUse' and a.decision is null and exists (select 1 from firings b where b.tool_use_id=a.tool_use_id and b.event='PostToolUse' and b.exits > 0)"),
    "jn20_uses_results": S("select u.file_name, u.id, u.name, coalesce(r.n, 0) results_seen, coalesce(r.err, false) is_error from uses u left join (select file_name, tool_use_id, count(*) n, max(is_error) err from results group by 1, 2) r on u.file_name=r.file_name and u.id=r.tool_use_id", "select u.file_name, u.id, u.name, coalesce(r.n, 0) results_seen, coalesce(r.err, false) is_error from uses u left join (select file_name, tool_use_id, count(*) n, bool_or(is_error) err from results group by 1, 2) r on u.file_name=r.file_name and u.id=r.tool_use_id"),
    "mt46_judge": S("select session_id, tool_use_id, decision, import_ms, api_ms, total_ms, ok, usage.input_tokens, usage.output_tokens from judge"),
    "str07_late": S("select hook_event, count(*) n, count(*) filter (where duration_ms > 5000) late from dispatch where phase='exit' group by hook_event"),
    "ag20_manifest_keys": S("select count(agent_id) as agent_id, count(session_id) as session_id, count(agent_type) as agent_type, count(description) as description, count(tool_use_id) as tool_use_id, count(model) as model, count(spawn_depth) as spawn_depth, count(parent_agent_id) as parent_agent_id, count(worktree_path) as worktree_path from manifests"),
    "ag25_spawn_depth": S("select coalesce(cast(spawn_depth as string),'<absent>') depth, count(*) n from manifests group by 1", "select coalesce(cast(spawn_depth as varchar),'<absent>') \"depth\", count(*) n from manifests group by 1"),
    "jn04_manifest_versions": _both("select m.agent_id, min_by(l.version, l.o) as first_version, count(distinct l.version) versions from (select distinct agent_id, replace(file_name,'.meta.json','.jsonl') trace from manifests) m join (select file_name, version, VKEY o from lines where VOK) l on m.trace=l.file_name group by m.agent_id", {"VKEY": _VKEY, "VOK": _vs}, {"VKEY": _VKEY, "VOK": _vd}),
    "jn05_located": S("select m.spawn_depth, count(*) sites, count(distinct m.tool_use_id) ids, count(*) filter (where b.k_envelope<>'absent') with_envelope from (select tool_use_id, max(spawn_depth) as spawn_depth from manifests where tool_use_id is not null group by tool_use_id) m join results b on m.tool_use_id=b.tool_use_id group by m.spawn_depth"),
    "jn06_traces": S("select m.agent_id, count(l.line_id) n from (select distinct agent_id, slug, session_id from manifests) m left join lines l on l.agent_id=m.agent_id and l.slug=m.slug and l.session_id=m.session_id group by m.agent_id"),
    "jn24_rollup": S("select m.agent_id, t.tokens, t.tokens is not null covered from (select distinct agent_id, replace(file_name,'.meta.json','.jsonl') trace from manifests) m full outer join (select file_name, sum(coalesce(input_tokens,0)+coalesce(output_tokens,0)+coalesce(cache_creation_tokens,0)+coalesce(cache_read_tokens,0)) tokens from turns where container='subagent-trace' group by file_name) t on m.trace=t.file_name"),
    "ag33_metric_merge": S("select user_id, event_type, case when temporality=1 then round(sum(value), 4) else max_by(value, o) end merged from (select user_id, event_type, value, event_id o, first_value(event_id % 2) over (partition by user_id, event_type order by ts, event_id) temporality from events) group by user_id, event_type, temporality"),
    "str03_session_windows": S("select user_id, count(*) filter (where gap is null or gap > 3600) segments from (select user_id, UNIX - lag(UNIX) over (partition by user_id order by UNIX, event_id) gap from events) group by user_id".replace("UNIX", "unix_micros(ts)/1000000"), "select user_id, count(*) filter (where gap is null or gap > 3600) segments from (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id))/1000000 gap from events) group by user_id"),
}

_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
SANITIZER: dict[str, Statement] = {
    "san03_paths": S("select line_id, replace(cwd, '/home/dev/', '/home/user/') as cwd from lines where cwd is not null"),
    "san05_branches": S("select git_branch is null or git_branch in ('', '<branch>') passed, case when git_branch is null or git_branch in ('', '<branch>') then git_branch else '<branch>' end branch, count(*) n from lines where git_branch is not null group by 1, 2"),
    "san06_remap": S("select uuid, concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12)) remapped from (select uuid, sha2(concat(encode('seed','utf-8'), unhex('00'), encode(uuid,'utf-8')), 256) h from (select distinct uuid from lines where uuid is not null))", "select uuid, concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12)) remapped from (select uuid, sha256('seed'::blob || '\\x00'::blob || encode(uuid)) h from (select distinct uuid from lines where uuid is not null))"),
    "san08_redact": S(f"select doc_id, regexp_replace(text, '{_EMAIL}', '<REDACTED:email>') text from documents where text is not null", f"select doc_id, regexp_replace(text, '{_EMAIL}', '<REDACTED:email>', 'g') \"text\" from documents where text is not null"),
    "san10_residual": S(f"select count(*) n, count(*) filter (where rlike(text, '{_EMAIL}')) hits from documents", f"select count(*) n, count(*) filter (where regexp_matches(text, '{_EMAIL}')) hits from documents"),
    "ag38_substitutions": S("select original, replacement, count(*) occurrences from (select cwd original, replace(cwd, '/home/dev/', '/home/user/') replacement from lines where contains(cwd, '/home/dev/')) group by 1, 2"),
    "ag39_conflicts": S("select original from (select cwd original, concat('/p/', slug) replacement from lines where cwd is not null) group by original having count(distinct replacement) > 1"),
    "ag41_line_counts": _both(f"select file_name, count(*) lines_processed, count(*) filter (where CLASS='blank') blanks, count(*) filter (where CLASS='object') survivors from classes group by file_name", {"CLASS": "class"}, {"CLASS": '"class"'}),
    "w08_placeholders": S("select cwd, row_number() over (order by first) place from (select cwd, min(line_id) first from lines where cwd is not null group by cwd)"),
}

ALL = PROFILE | METRICS | CAPTURE | SANITIZER
