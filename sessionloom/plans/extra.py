"""Queries of operators whose fields the transcripts of the driver do not carry, or
that need more than one statement.

Where a field is missing there (rollups, costs with all their terms, telemetry,
debug logs, spilled results), the records are written from the rows of another
whole table, run through the same parsing and operators as delivered lines, and
checked by SQL that computes from that table directly, without any JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.operators import captures, hierarchy, ordered, rollups, sanitize, tables, telemetry
from sessionloom.plans import corpus, statements
from sessionloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _made(spark: SparkSession, folder: str, source: str, statement: str) -> DataFrame:
    """The lines table of records that a statement writes from ``source``."""
    rows = spark.sql(statement, src=corpus._timed(table(spark, folder, source)))
    return tables.lines(rows)


# --- rollups, from manifests: token counts are lengths of their texts
_ROLLED = """select cast(row_number() over (order by agent_id, coalesce(description,''), coalesce(tool_use_id,''), coalesce(model,'')) as bigint) line_id, file_name, slug,
to_json(named_struct('type','user','uuid',agent_id,'sessionId',session_id,'toolUseResult', named_struct('agentId',agent_id,'totalTokens',length(coalesce(description,''))+length(session_id)+length(coalesce(file_name,''))+if(spawn_depth=2,1,0),
'totalDurationMs',length(slug)*1000,'totalToolUseCount',length(coalesce(description,''))%7,'usage',named_struct('input_tokens',length(coalesce(description,'')),'output_tokens',length(session_id),'cache_creation_input_tokens',length(coalesce(file_name,'')),'cache_read_input_tokens',0)))) raw from {src}"""
_ROLLED_DUCK = "r as (select agent_id, length(coalesce(description,'')) e_input, length(session_id) e_output, length(coalesce(file_name,'')) e_creation, 0 e_read, length(coalesce(description,''))+length(session_id)+length(coalesce(file_name,''))+case when spawn_depth=2 then 1 else 0 end total_tokens, length(slug)*1000 e_duration_ms, length(coalesce(description,''))%7 e_tool_uses from manifests)"


def _rolled(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.rollups(_made(spark, folder, "manifests", _ROLLED))


@query(f"with {_ROLLED_DUCK} select agent_id, total_tokens, e_input, e_output, e_creation, e_read, e_duration_ms, e_tool_uses from r")
def mt13_rollup_rows(spark, folder):
    return _rolled(spark, folder).drop("line_id", "adds_up")


@query(f"with {_ROLLED_DUCK} select count(*) n, count(*) filter (where e_input+e_output+e_creation=total_tokens) holds, count(*) filter (where e_input+e_output+e_creation<>total_tokens) fails from r")
def mt05_rollup_identity(spark, folder):
    return _rolled(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_if("adds_up").alias("holds"), F.count_if(~F.col("adds_up")).alias("fails"))


@query(f"with {_ROLLED_DUCK} select e_tool_uses % 7 calls, count(*) n, sum(e_duration_ms) ms, sum(total_tokens) tokens from r group by 1")
def mt16_agent_listing(spark, folder):
    return _rolled(spark, folder).groupBy(F.col("e_tool_uses").alias("calls")).agg(F.count(F.lit(1)).alias("n"), F.sum("e_duration_ms").alias("ms"), F.sum("total_tokens").alias("tokens"))


_TRACES_DUCK = """best as (select line_id, json_extract_string(raw,'$.agentId') agent_id, row_number() over (partition by file_name, json_extract_string(raw,'$.message.id') order by coalesce(try_cast(json_extract_string(raw,'$.message.usage.output_tokens') as bigint),0) desc, line_id desc) rn,
coalesce(try_cast(json_extract_string(raw,'$.message.usage.input_tokens') as bigint),0)+coalesce(try_cast(json_extract_string(raw,'$.message.usage.output_tokens') as bigint),0)+coalesce(try_cast(json_extract_string(raw,'$.message.usage.cache_creation_input_tokens') as bigint),0)+coalesce(try_cast(json_extract_string(raw,'$.message.usage.cache_read_input_tokens') as bigint),0) t
from transcript_lines where file_name like '%/subagents/%' and json_valid(raw) and json_extract_string(raw,'$.type')='assistant' and json_type(raw,'$.message.id')='VARCHAR' and json_type(raw,'$.message.usage')='OBJECT' and coalesce(json_extract_string(raw,'$.isApiErrorMessage'),'false')<>'true'),
t as (select agent_id, sum(t)::bigint trace_tokens from best where rn=1 and agent_id is not null group by 1), m as (select agent_id, max(total_tokens) total_tokens from r group by 1)"""


def _covered(spark, folder) -> DataFrame:
    turns = corpus.shared(spark, folder, ["turns"])["turns"]
    return rollups.against_traces(_rolled(spark, folder), turns)


@query(f"with {_ROLLED_DUCK}, {_TRACES_DUCK} select coalesce(m.agent_id,t.agent_id) agent_id, total_tokens, trace_tokens, trace_tokens/total_tokens as ratio, case when total_tokens is null then 'trace only' when trace_tokens is null then 'rollup only' else 'both' end coverage from m full join t on m.agent_id=t.agent_id")
def jn24_rollup_traces(spark, folder):
    return _covered(spark, folder)


@query(f"with {_ROLLED_DUCK}, {_TRACES_DUCK} select count(*) n, median(trace_tokens/total_tokens) middle, min(trace_tokens/total_tokens) least, max(trace_tokens/total_tokens) most from m join t on m.agent_id=t.agent_id")
def mt06_undercount(spark, folder):
    both = _covered(spark, folder).where("coverage = 'both'")
    return both.agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("middle"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))


# --- costs with every term, from lineitem: one request per line
_RATES = [
    ("quill-large-4", "1990-01-01", "1995-01-01", 15.0, 75.0, None, None), ("quill-large-4", "1995-01-01", None, 5.0, 25.0, 10.0, 50.0),
    ("quill-medium-4", "1990-01-01", None, 3.0, 15.0, None, None), ("quill-small-4", "1994-01-01", None, 1.0, 5.0, None, None),
]
RATES_DDL = "model string, valid_from string, valid_to string, input double, output double, fast_input double, fast_output double"
ALIASES = {"large": "quill-large-4"}
_REQUESTS = """select cast(l_orderkey * 10 + l_linenumber as bigint) line_id, 'f.jsonl' file_name, 's' slug, to_json(named_struct('type','assistant','timestamp', date_format(l_shipdate, "yyyy-MM-dd'T'12:00:00'Z'"),
'attributionAgent', if(l_linenumber % 4 = 0, 'Explore', null), 'attributionMcpServer', if(l_linenumber % 4 = 1, 'hub', null), 'attributionMcpTool', if(l_linenumber % 4 = 1, 'get', null), 'attributionSkill', if(l_linenumber % 4 = 2, 'sum', null),
'message', named_struct('id', concat('m', l_orderkey), 'model', element_at(array('quill-large-4[1m]', 'quill-medium-4', 'quill-small-4-20250101', 'large', '<synthetic>', 'unheard-of'), cast(l_partkey % 6 + 1 as int)),
'usage', named_struct('input_tokens', cast(l_quantity as int) * 100, 'output_tokens', l_linenumber * 10, 'cache_read_input_tokens', 5000, 'cache_creation_input_tokens', 700, 'speed', if(l_returnflag = 'R', 'fast', 'standard'), 'service_tier', if(l_linestatus = 'F', 'batch', 'standard'),
'inference_geo', if(l_returnflag = 'A', 'us', 'global'), 'server_tool_use', named_struct('web_search_requests', l_linenumber - 1),
'cache_creation', if(l_suppkey % 2 = 0, named_struct('ephemeral_5m_input_tokens', 500, 'ephemeral_1h_input_tokens', 200), null))))) raw from {src}"""
_COST_DUCK = """c as (select *, l_partkey % 6 k, case when l_partkey % 6 in (0,3) then case when l_shipdate < date '1995-01-01' then 15 else 5 end when l_partkey % 6 = 1 then 3 when l_partkey % 6 = 2 and l_shipdate >= date '1994-01-01' then 1 end::double i0,
l_returnflag='R' and l_partkey % 6 in (0,3) and l_shipdate >= date '1995-01-01' fast from lineitem),
d as (select *, case when fast then 10 else i0 end::double i, case when fast then 50 else i0*5 end::double o, case when l_linestatus='F' then 0.5::double else 1 end b from c where k <> 4),
e as (select *, case when i0 is not null then (cast(l_quantity as int)*100*i*b + l_linenumber*10*o*b + i*(5000*0.1::double + case when l_suppkey % 2 = 0 then 500*1.25::double+200*2 else 700*1.25::double end))/1000000*case when l_returnflag='A' then 1.1::double else 1 end + (l_linenumber-1)*0.01::double end cost,
case k when 0 then 'quill-large-4' when 3 then 'quill-large-4' when 1 then 'quill-medium-4' when 2 then 'quill-small-4' else 'unheard-of' end canonical from d)"""


def _costs(spark, folder) -> DataFrame:
    rates = spark.createDataFrame(_RATES, RATES_DDL).withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})
    return rollups.priced(_made(spark, folder, "lineitem", _REQUESTS), rates, ALIASES)


@query(f"with {_COST_DUCK} select canonical, count(*) n, count(*) filter (where cost is null) unpriced, round(sum(cost), 6) as cost from e group by 1")
def mt07_cost_terms(spark, folder):
    return rollups.cost_by(_costs(spark, folder), "canonical")


@query(f"with {_COST_DUCK} select case l_linenumber % 4 when 0 then 'agent' when 1 then 'mcp' when 2 then 'skill' else 'main' end origin, case l_linenumber % 4 when 0 then 'Explore' when 1 then 'hub/get' when 2 then 'sum' else '(main loop)' end \"name\", count(*) n, count(*) filter (where cost is null) unpriced, round(sum(cost), 6) as cost from e group by 1, 2")
def mt09_cost_by_origin(spark, folder):
    return rollups.cost_by(_costs(spark, folder), *rollups.origin())


_STATES = """select cast(row_number() over (order by session_id) as bigint) line_id, 'f.jsonl' file_name, 's' slug, to_json(named_struct('type','cost-state','sessionId',session_id,'modelUsage',map_from_entries(collect_list(struct(model, c))))) raw
from (select session_id, model, named_struct('inputTokens', sum(usage.input_tokens), 'outputTokens', sum(usage.output_tokens), 'costUSD', sum(usage.input_tokens + 5 * usage.output_tokens) / 1000000.0) c from {src} where ok and session_id is not null and model is not null group by session_id, model) group by session_id"""


@query("select session_id, model, sum(usage.input_tokens) stated_input, sum(usage.input_tokens) counted_input, round(sum(usage.input_tokens+5*usage.output_tokens)/1000000, 6) stated_cost, 0.0::double gap from judge where ok and session_id is not null and model is not null group by 1, 2")
def mt40_cost_states(spark, folder):
    """What cost-state records say of each model, beside the calls themselves."""
    made = _made(spark, folder, "judge", _STATES)
    stated = captures.cost_states(made)
    calls = table(spark, folder, "judge").where("ok").groupBy("session_id", "model").agg(
        F.sum("usage.input_tokens").alias("counted_input"), F.sum(F.expr("usage.input_tokens + 5 * usage.output_tokens")).alias("units")
    )
    met = stated.join(calls, ["session_id", "model"], "left")
    gap = F.round(F.col("stated_cost") - F.col("units") / 1_000_000, 6) + F.lit(0.0)
    return met.select("session_id", "model", "stated_input", "counted_input", F.round("stated_cost", 6).alias("stated_cost"), gap.alias("gap"))


# --- results: partial reads, spilled results, restore points
_READS = """select o_orderkey line_id, 'f.jsonl' file_name, 's' slug, to_json(named_struct('type','user','sessionId',cast(o_custkey as string),'toolUseResult',named_struct('file',named_struct('startLine',1+o_orderkey%7,'numLines',o_orderkey%50,'totalLines',o_custkey%90)))) raw from {src}"""


@query("select o_custkey::varchar session_id, count(*) reads, sum(greatest(o_custkey%90 - least(o_orderkey%50, o_custkey%90), 0)) unread, round(sum(greatest(o_custkey%90 - least(o_orderkey%50, o_custkey%90), 0))/nullif(sum(o_custkey%90), 0), 6) as share from orders group by 1")
def mt31_partial_reads(spark, folder):
    lines = _made(spark, folder, "orders", _READS).where("e_total_lines is not null")
    unread = F.greatest(F.col("e_total_lines") - F.least("e_num_lines", "e_total_lines"), F.lit(0))
    return lines.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("reads"), F.sum(unread).alias("unread"), F.round(F.try_divide(F.sum(unread), F.nullif(F.sum("e_total_lines"), F.lit(0))), 6).alias("share")
    )


_SPILLED = """select o_orderkey line_id, 'f.jsonl' file_name, 's' slug, case when o_orderkey % 3 = 0 then to_json(named_struct('type','user','toolUseResult',named_struct('persistedOutputPath',concat('/p/s/tool-results/toolu_',o_orderkey,'.txt')))) when o_orderkey % 3 = 1 then
to_json(named_struct('type','user','message',named_struct('content',array(named_struct('type','tool_result','tool_use_id','t','content',concat('<persisted-output>\\nOutput too large (9KB). Full output saved to: /p/s/tool-results/toolu_',o_orderkey,'.txt\\n\\nPreview</persisted-output>')))))) else '{{"type":"user"}}' end raw from {src}"""


@query("select o_orderkey line_id, case when o_orderkey % 3 = 0 then 'envelope' else 'text' end pointer, 'toolu_'||o_orderkey||'.txt' \"file\", o_orderkey % 2 = 0 as present, case when o_orderkey % 2 = 0 then o_custkey end bytes from orders where o_orderkey % 3 in (0, 1)")
def jn23_spilled_results(spark, folder):
    """Pointers to spilled results with the files they lead to, if those are there."""
    files = table(spark, folder, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("/else/tool-results/toolu_"), "o_orderkey", F.lit(".txt")).alias("path"), F.col("o_custkey").alias("bytes"))
    return captures.spill_pointers(_made(spark, folder, "orders", _SPILLED), files)


_RESTORE = """select event_id line_id, 'f.jsonl' file_name, 's' slug, to_json(named_struct('type','file-history-snapshot','messageId',concat('m',event_id),'snapshot',named_struct('messageId',concat('m',event_id),'timestamp',date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
'trackedFileBackups', map(concat('/f', user_id), named_struct('backupFileName', concat('b', event_id), 'version', 1), concat('/g', user_id % 3), named_struct('backupFileName', concat('c', event_id), 'version', 2))))) raw from {src}"""
_RESTORE_AT = "2024-01-04 00:00:00"


@query(f"select path, max_by(b, event_id) backup, count(*) versions from (select '/f'||user_id path, 'b'||event_id b, event_id, ts from events union all select '/g'||(user_id%3), 'c'||event_id, event_id, ts from events) where ts <= timestamp '{_RESTORE_AT}' group by path")
def mt39_restore_points(spark, folder):
    """Latest backup of each file before a checkpoint."""
    return captures.restore_points(_made(spark, folder, "events", _RESTORE), _RESTORE_AT)


@query("select file_name, date_diff('day', max(ingested_at), timestamp '2026-12-31 00:00:00') > 120 expired from transcript_lines group by 1")
def mt36_expired_files(spark, folder):
    """Transcripts whose last arrival is longer ago than the cleanup period."""
    lines = corpus._timed(table(spark, folder, "transcript_lines"))
    files = lines.groupBy("file_name").agg(F.max("ingested_at").alias("modified"))
    return captures.expired(files, now="2026-12-31 00:00:00", days=120)


@query("""with o as materialized (select line_id, raw from transcript_lines where json_valid(raw) and json_type(raw)='OBJECT'),
l as materialized (select line_id, raw->>'$.sessionId' s, raw->>'$.cwd' c, raw->>'$.gitBranch' b, epoch_ms(try_cast(case when json_type(raw,'$.timestamp')='VARCHAR' then raw->>'$.timestamp' end as timestamp)) t from o where json_type(raw,'$.cwd')='VARCHAR' and json_type(raw,'$.gitBranch')='VARCHAR' and json_type(raw,'$.sessionId')='VARCHAR'),
w as (select s, c, b, min(t) t0, max(t) t1 from l group by all) select w.s session_id, count(*) candidates, count(distinct l.line_id) commits from w join l on w.c=l.c and w.b=l.b and l.line_id % 40 = 0 and l.t+60000 between w.t0 and w.t1+600000 group by 1""")
def jn22_commit_candidates(spark, folder):
    """Commits (here a minute after every fortieth line) that a session may have
    made: same folder and branch, within the session or ten minutes after."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"].select("line_id", "session_id", "cwd", "git_branch", "ts_text", "ts_ms").where("ts_text is not null")
    commits = lines.where("line_id % 40 = 0").select(F.col("line_id").alias("commit_id"), "cwd", "git_branch", (F.col("ts_ms") + 60_000).alias("at_ms"))
    met = captures.commit_candidates(lines, commits)
    return met.groupBy("session_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("commit_id").alias("commits"))


# --- telemetry, from judge and dispatch: one export per row
_PREFIX = captures.EVENT_PREFIX
_ATTR = "named_struct('key','{k}','value',{v})"


def _attrs(**values: str) -> str:
    return "array(" + ", ".join(f"named_struct('key','{k.replace('__', '.')}','value',map('{kind}', cast({v} as string)))" for k, (kind, v) in values.items()) + ")"


_REQUEST_LOG = f"""select cast(ts_ms as bigint) recv_ms, to_json(named_struct('resourceLogs',array(named_struct('resource',named_struct('attributes',{_attrs(session__id=("stringValue", "session_id"))}),'scopeLogs',array(named_struct('logRecords',array(named_struct(
'timeUnixNano',cast(cast(ts_ms as bigint)*1000000 as string),'body',named_struct('stringValue','{_PREFIX}api_request'),'attributes',{_attrs(event__sequence=("intValue", "floor(ts_ms) - 1770000000000"), model=("stringValue", "coalesce(model, 'm')"), query_source=("stringValue", "if(ok, 'judge', 'retry')"), input_tokens=("stringValue", "coalesce(cast(usage.input_tokens as string), 'none')"), output_tokens=("stringValue", "coalesce(usage.output_tokens, 0)"), cost_usd=("stringValue", "'0.25'"), session__id=("stringValue", "coalesce(session_id, '-')"), user__secret=("stringValue", "'abc'"))})))))))) raw from {{src}}"""
_HOOK_LOG = f"""select cast(ts_ms as bigint) recv_ms, to_json(named_struct('resourceLogs',array(named_struct('scopeLogs',array(named_struct('logRecords',array(named_struct('timeUnixNano',cast(cast(ts_ms as bigint)*1000000 as string),
'body',named_struct('stringValue',concat('{_PREFIX}', case when phase='enter' then 'hook_execution_start' when phase='exit' and decision is not null then 'tool_decision' else 'hook_execution_complete' end)),
'attributes',{_attrs(event__sequence=("intValue", "floor(ts_ms) - 1770000000000"), hook_event=("stringValue", "coalesce(hook_event, '-')"), hook_name=("stringValue", "concat(coalesce(hook_event, '-'), ':', coalesce(tool, '-'))"), tool_use_id=("stringValue", "coalesce(tool_use_id, '-')"), session__id=("stringValue", "coalesce(session_id, '-')"), decision=("stringValue", "coalesce(decision, '-')"))})))))),
'resourceSpans',array(named_struct('scopeSpans',array(named_struct('spans',array(named_struct('name',if(phase='enter','hook','hook.end'),'traceId',cast(pid as string),'spanId','s','startTimeUnixNano','1','endTimeUnixNano','2')))))))) raw from {{src}}"""


def _signals(spark, folder, source: str, statement: str) -> DataFrame:
    rows = spark.sql(statement, src=table(spark, folder, source))
    return telemetry.flatten_exports(rows, captures.ALLOWED)


@query(f"select 'log' signal, case when phase='enter' then '{_PREFIX}hook_execution_start' when phase='exit' and decision is not null then '{_PREFIX}tool_decision' else '{_PREFIX}hook_execution_complete' end \"name\", count(*) n from dispatch group by 1, 2 union all select 'span', case when phase='enter' then 'hook' else 'hook.end' end, count(*) from dispatch group by 1, 2")
def ag31_signals(spark, folder):
    return captures.signal_counts(_signals(spark, folder, "dispatch", _HOOK_LOG))


@query("select case when phase='enter' then 'hook' else 'hook.end' end \"name\", count(*) n from dispatch group by 1")
def ag34_spans(spark, folder):
    return captures.span_counts(_signals(spark, folder, "dispatch", _HOOK_LOG))


@query("select 'user.secret' \"name\", count(*) n from judge")
def ag31_redacted_names(spark, folder):
    return captures.redacted_names(_signals(spark, folder, "judge", _REQUEST_LOG))


@query("select case when ok then 'judge' else 'retry' end source, coalesce(model,'m') model, '-' agent, count(*) requests, sum(coalesce(usage.input_tokens,0)) input, sum(coalesce(usage.output_tokens,0)) output, 0 cache_read, 0 creation, count(*)*0.25 cost from judge group by 1, 2")
def ag32_request_totals(spark, folder):
    return captures.request_totals(captures.events(_signals(spark, folder, "judge", _REQUEST_LOG), "api_request"))


_SEQ_DUCK = "d as (select *, floor(ts_ms)::bigint - 1770000000000 seq, coalesce(hook_event,'-') ev, coalesce(hook_event,'-')||':'||coalesce(tool,'-') hook_name, coalesce(session_id,'-') sid, coalesce(tool_use_id,'-') tid, case when phase='enter' then 'start' when phase='exit' and decision is not null then 'decision' else 'complete' end kind from dispatch)"


def _hook_events(spark, folder) -> DataFrame:
    return _signals(spark, folder, "dispatch", _HOOK_LOG)


@query(f"with {_SEQ_DUCK} select sid session_id, seq, tid tool_use_id, (select max(c.seq) from d c where c.kind='complete' and c.ev='PreToolUse' and c.sid=t.sid and c.seq<t.seq) before from d t where kind='decision'")
def jn15_decision_asof(spark, folder):
    """Each tool decision with the last PreToolUse completion before it, by sequence."""
    return captures.asof_before(_hook_events(spark, folder))


@query(f"with {_SEQ_DUCK} select sid session_id, hook_name, seq, (select min(c.seq) from d c where c.kind='complete' and c.hook_name=t.hook_name and c.sid=t.sid and c.seq>t.seq) complete from d t where kind='start'")
def jn17_start_asof(spark, folder):
    """Each hook start with its first completion of the same hook after it."""
    return captures.asof_after(_hook_events(spark, folder))


@query(f"with {_SEQ_DUCK}, s as (select sid, hook_name, seq s0, (select min(c.seq) from d c where c.kind='complete' and c.hook_name=t.hook_name and c.sid=t.sid and c.seq>t.seq) s1 from d t where kind='start'), j as (select coalesce(session_id,'-') sid, coalesce(nullif(floor(ts_ms)::bigint-1770000000000, 0), -1) q from judge) select s.sid session_id, hook_name, s0 seq, s1 complete, q request from s join j on s.sid=j.sid and s0<q and q<s1")
def jn18_requests_inside(spark, folder):
    """Requests strictly between a hook's start and completion."""
    requests = captures.events(_signals(spark, folder, "judge", _REQUEST_LOG), "api_request")
    return captures.requests_inside(captures.asof_after(_hook_events(spark, folder)), requests)


@query("""with f as (select session_id, pid, (min_by({'v': tool_use_id}, o)).v tid, (min_by({'v': hook_event}, o)).v ev, (min_by({'v': route}, o)).v route, max_by(decision, case when decision is not null then o end) decision, min(case when phase='enter' then ts_ms end) start_ms
from (select *, row_number() over (partition by session_id, pid order by ts_ms, phase, coalesce(hook_event,''), coalesce(tool_use_id,''), coalesce(decision,''), coalesce(duration_ms,-1)) o from dispatch) group by session_id, pid),
l as (select * from (select *, row_number() over (partition by tid order by start_ms desc nulls last, session_id desc nulls last, pid desc) rn from f where ev='PreToolUse' and tid is not null) where rn=1)
select coalesce(d.session_id,'-') session_id, floor(d.ts_ms)::bigint-1770000000000 seq, coalesce(d.tool_use_id,'-') tool_use_id, d.decision, l.route, l.decision fired from dispatch d left join l on coalesce(d.tool_use_id,'-')=l.tid where d.phase='exit' and d.decision is not null""")
def jn16_decisions_fired(spark, folder):
    """Each tool decision with the last PreToolUse firing of its call, if any."""
    firings = corpus.run(spark, folder, statements.FIRINGS)
    return captures.decisions_fired(captures.events(_hook_events(spark, folder), "tool_decision"), firings)


_DEBUG = """select 'debug.txt' file_name, row_number() over (order by ts_ms, pid, phase) line_no, concat(date_format(timestamp_millis(cast(ts_ms as bigint)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ' [DEBUG] Hooks: ', coalesce(hook_event,'Stop'), if(tool is null, '', concat(':', tool)), ' [python3 "/h/guard.', if(pid % 2 = 0, 'py', 'exe'), '"] ',
case when phase='killed' then 'timed out after 5000ms' when phase='enter' then 'cancelled' else concat('completed with status ', coalesce(exit_code, -1), ' (', cast(coalesce(duration_ms, 0) as int), 'ms)') end) raw from {src}"""


@query("select coalesce(hook_event,'Stop') \"event\", tool target, case when pid%2=0 then 'guard.py' end script, case phase when 'killed' then 'timed out' when 'enter' then 'cancelled' else 'finished' end outcome, case when phase='exit' then coalesce(exit_code,-1) end status, case when phase='killed' then 5000 end timeout_ms, count(*) n from dispatch group by all")
def ag36_debug_outcomes(spark, folder):
    log = spark.sql(_DEBUG, src=table(spark, folder, "dispatch"))
    return telemetry.debug_outcomes(telemetry.debug_hooks(log))


@query("select session_id, coalesce('…'||right(tool_use_id,8), '-') tool, case when ok then 'true' else 'false' end delivered, round(total_ms, 1) held_ms from judge")
def mt45_guard_table(spark, folder):
    requests = table(spark, folder, "judge").select("session_id", "tool_use_id", F.col("ts_ms").alias("recv_ms"), (F.col("ts_ms") + F.col("total_ms")).alias("sent_ms"), F.col("ok").alias("delivered"))
    return captures.guard_table(requests)


# --- manifests by version and depth
@query("""with v as (select file_name, raw->>'$.version' v from transcript_lines where json_valid(raw) and json_type(raw)='OBJECT' and json_type(raw,'$.version')='VARCHAR' and regexp_full_match(raw->>'$.version','[0-9]+\\.[0-9]+\\.[0-9]+')),
f as (select file_name, count(distinct v) n, min_by(v, split_part(v,'.',1)::bigint*1000000000000+split_part(v,'.',2)::bigint*1000000+split_part(v,'.',3)::bigint) v from v group by 1),
m as (select f.v, f.n, k.* from (select *, replace(file_name,'.meta.json','.jsonl') trace from manifests) k left join f on f.file_name=k.trace),
c as (select coalesce(v,'<unattributed>') "version", unnest([{'k':'<manifests>','p':1},{'k':'<several versions>','p':case when n>1 then 1 else 0 end},{'k':'agent_type','p':case when agent_type is not null then 1 else 0 end},{'k':'description','p':case when description is not null then 1 else 0 end},{'k':'tool_use_id','p':case when tool_use_id is not null then 1 else 0 end},{'k':'model','p':case when model is not null then 1 else 0 end},
{'k':'spawn_depth='||coalesce(spawn_depth::varchar,''),'p':case when spawn_depth is not null then 1 else 0 end},{'k':'parent_agent_id','p':case when parent_agent_id is not null then 1 else 0 end},{'k':'worktree_path','p':case when worktree_path is not null then 1 else 0 end}]) e from m)
select "version", e.k shape, sum(e.p)::bigint n from c group by 1, 2 having sum(e.p) > 0""")
def ag21_manifest_shapes(spark, folder):
    """Shape of manifests by the earliest version on their own trace."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"]
    return captures.manifest_shapes(table(spark, folder, "manifests"), lines)


@query("""with r as (select t.file_name, t.raw, b->>'$.tool_use_id' id, b from (select file_name, raw, unnest(json_extract(raw,'$.message.content[*]')) b from transcript_lines where json_valid(raw) and json_type(raw,'$.message.content')='ARRAY') t where b->>'$.type'='tool_result'),
m as (select tool_use_id, max(spawn_depth) d from manifests where tool_use_id is not null group by 1)
select coalesce(d::varchar,'<absent>') "depth", count(id) sites, count(distinct id) located, count(distinct m.tool_use_id) - count(distinct id) not_located, count(*) filter (where file_name like '%/subagents/%') in_traces, count(*) filter (where file_name not like '%/subagents/%') in_parents,
count(*) filter (where json_type(raw,'$.toolUseResult') is not null) with_envelope, count(*) filter (where contains(b->>'$.content','subagent_tokens')) with_trailer from m left join r on m.tool_use_id=r.id group by 1""")
def ag26_depth_contrast(spark, folder):
    """Spawn sites of manifests by depth, every match counted."""
    return captures.depth_contrast(table(spark, folder, "manifests"), corpus.shared(spark, folder, ["results"])["results"])


@query("select count(*) listed, count(*) filter (where f not in (select file_name from transcript_lines)) dropped from (select distinct replace(file_name,'.meta.json','.jsonl') f from manifests where file_name is not null)")
def ag17_files_dropped(spark, folder):
    """Traces that are listed but have no line that was read."""
    listed = table(spark, folder, "manifests").where("file_name is not null").select(F.regexp_replace("file_name", r"\.meta\.json$", ".jsonl").alias("file_name")).distinct()
    read = table(spark, folder, "transcript_lines").select("file_name").distinct().withColumn("was_read", F.lit(True))
    return listed.join(read, "file_name", "left").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("was_read").isNull()).alias("dropped"))


@query("select session_id, count(*) calls, list(n order by n desc)[1] most, max_by(tool, n*1000-ascii(tool)) as top_tool from (select session_id, coalesce(tool,'-') tool, count(*) n from dispatch group by 1, 2) group by 1")
def mt44_session_tools(spark, folder):
    """Per session its hooked tools: how many, and the most frequent with its count."""
    by = table(spark, folder, "dispatch").groupBy("session_id", F.coalesce("tool", F.lit("-")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.max("n").alias("most"), F.max_by("tool", F.col("n") * 1000 - F.ascii("tool")).alias("top_tool"))


@query("select slug, max_by(doc_id, (coalesce(created_at, timestamp '0001-01-01'), doc_id)) latest, count(*) n from documents where slug is not null group by slug")
def st07_latest_rows(spark, folder):
    """Per slug the latest row by (time, id); rows without a time come first."""
    docs = corpus._timed(table(spark, folder, "documents")).where("slug is not null")
    order = F.struct(F.coalesce("created_at", F.to_timestamp(F.lit("0001-01-01"))), F.col("doc_id"))
    return docs.groupBy("slug").agg(F.max_by("doc_id", order).alias("latest"), F.count(F.lit(1)).alias("n"))


@query("select session_id, ts_ms, coalesce(tool_duration_ms, 1e18) as place_value, row_number() over (order by tool_duration_ms nulls last, ts_ms, session_id nulls last, pid, phase, coalesce(decision,''), coalesce(hook_event,'')) place from (select * from dispatch where phase<>'enter') order by place limit 50")
def st06_null_last_order(spark, folder):
    """The fifty shortest tool calls, those without a duration last (a top-k report)."""
    ended = table(spark, folder, "dispatch").where("phase <> 'enter'")
    order = [F.asc_nulls_last("tool_duration_ms"), "ts_ms", F.asc_nulls_last("session_id"), "pid", "phase", F.coalesce("decision", F.lit("")), F.coalesce("hook_event", F.lit(""))]
    top = ended.orderBy(*order).limit(50)
    place = F.row_number().over(Window.orderBy(*order))  # over fifty rows
    return top.select("session_id", "ts_ms", F.coalesce("tool_duration_ms", F.lit(1e18)).alias("place_value"), place.alias("place"))


@query("select session_id, count(*) rows, case when count(distinct pid) = 1 then min(pid) end run from dispatch where session_id is not null and pid not in (select pid from dispatch where session_id is null) group by session_id")
def set06_new_runs(spark, folder):
    """The one run of each session that was not there before; null if ambiguous
    (``captures.only_new_run`` raises there)."""
    runs = table(spark, folder, "dispatch")
    known = runs.where("session_id is null").select("pid").distinct()
    new = runs.where("session_id is not null").join(known, "pid", "left_anti")
    one = F.when(F.count_distinct("pid") == 1, F.min("pid"))
    return new.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), one.alias("run"))


# --- projections to closed vocabularies, over dispatch
@query("select case when decision is null then '-' when regexp_full_match(decision,'[A-Za-z0-9_.:+-]{1,64}') then decision else '<other>' end decided, case when exit_signal is null then '-' when regexp_full_match(exit_signal,'[A-Za-z0-9_.:+-]{1,64}') then exit_signal else '<other>' end \"signal\", coalesce(exit_code::varchar,'-') code, count(*) n from dispatch group by 1, 2, 3")
def prj24_words(spark, folder):
    """Decisions, signals (as words) and exit codes (as numbers) of hook firings."""
    by = [captures.word(F.col("decision")).alias("decided"), captures.word(F.col("exit_signal")).alias("signal"), captures.number(F.col("exit_code")).alias("code")]
    return table(spark, folder, "dispatch").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


_PATHS_DUCK = "select split_part(file_name,'/',-1) base, slug from transcript_lines"


@query(f"select case when left(base, 6) = 'agent-' then '<other>' when base in ('a.jsonl') then base else '<other>' end sentinel, case when left(slug,10)='-home-dev-' then slug else '<other>' end named, count(*) n from ({_PATHS_DUCK}) group by 1, 2")
def prj27_sentinels(spark, folder):
    """File names and slugs folded to sentinels and names with a fixed prefix."""
    by = [captures.sentinel(F.col("file_name"), ["a.jsonl"]).alias("sentinel"), captures.safe_name(F.col("slug"), "-home-dev-").alias("named")]
    return table(spark, folder, "transcript_lines").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query("select case split_part(file_path,'/',-1) when 'README.md' then 'allow' when 'main.py' then 'deny' else 'no-decision' end route, count(*) n from (select unnest(json_extract(raw,'$.message.content[*]')) b from transcript_lines where json_valid(raw) and json_type(raw,'$.message.content')='ARRAY') x, lateral (select b->>'$.input.file_path' file_path) where b->>'$.type'='tool_use' and b->>'$.name'='Read' and json_type(b,'$.input.file_path')='VARCHAR' group by 1")
def prj32_routes(spark, folder):
    """Routes of reads by the name of the file they read."""
    reads = corpus.shared(spark, folder, ["blocks"])["blocks"].where("block_type = 'tool_use' and name = 'Read' and file_path is not null")
    return reads.groupBy(captures.routed(F.col("file_path"), {"README.md": "allow", "main.py": "deny"}).alias("route")).agg(F.count(F.lit(1)).alias("n"))


_OBJ = "o as materialized (select line_id, file_name, slug, raw from transcript_lines where json_valid(raw) and json_type(raw)='OBJECT')"


@query(f"with {_OBJ}, k as (select unnest(json_keys(raw)) k, line_id from o), h as (select k, count(*) n, min(line_id) first from k group by k) select k, n, row_number() over (order by n desc, first, k) place from h")
def st01_histogram_order(spark, folder):
    """Keys by count, ties by first appearance."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"]
    counts = lines.select("line_id", F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "first", "k"))  # over the distinct keys, a bounded report
    return counts.select("k", "n", place.alias("place"))


@query(f"""with {_OBJ}, c as (select count(distinct file_name) files, count(*) delivered, count(*) filter (where coalesce(trim(raw),'')<>'' and not json_valid(raw)) parse_errors from transcript_lines)
select files, delivered, parse_errors, (select count(*) from o) lines_seen, (select count(distinct split_part(file_name,'/subagents/',1)) from transcript_lines where file_name like '%/subagents/%') session_folders from c""")
def ag01_scan_totals(spark, folder):
    classes = corpus.shared(spark, folder, ["classes"])["classes"]
    inside = F.when(F.col("file_name").contains("/subagents/"), F.substring_index("file_name", "/subagents/", 1))
    return classes.agg(
        F.count_distinct("file_name").alias("files"), F.count(F.lit(1)).alias("delivered"), F.count_if(F.col("class") == "parse_error").alias("parse_errors"),
        F.count_if(F.col("class") == "object").alias("lines_seen"), F.count_distinct(inside).alias("session_folders"),
    )


_MKEYS = "agent_id session_id slug file_name agent_type description tool_use_id model spawn_depth parent_agent_id worktree_path".split()


@query("select e.k, e.t json_type, count(*) n from (select unnest([" + ", ".join(f"{{'k':'{k}','t':case when {k} is null then 'null' else '{'int' if k == 'spawn_depth' else 'str'}' end}}" for k in _MKEYS) + "]) e from manifests) group by 1, 2")
def ag20_manifest_key_types(spark, folder):
    """Keys of manifests by JSON type, manifests read as JSON documents."""
    docs = table(spark, folder, "manifests").select(F.to_json(F.struct(*_MKEYS), {"ignoreNullFields": "false"}).alias("raw"))
    each = docs.select(F.try_parse_json("raw").alias("v"))
    each = spark.sql("select e.key k, e.value x from {m} m, lateral variant_explode(m.v) e", m=each)
    return each.groupBy("k", tables.kind(F.col("x")).alias("json_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_OBJ}, l as (select raw->>'$.sessionId' session_id, coalesce(case when json_type(raw,'$.type')='VARCHAR' then raw->>'$.type' end,'<no-type>') t, raw, case when json_type(raw,'$.subtype')='VARCHAR' then raw->>'$.subtype' end st from o where json_type(raw,'$.sessionId')='VARCHAR'),
e as (select session_id, 'type' what, t label from l union all select session_id, 'subtype', case when st in ({statements.SUBTYPES}) then st else '<other>' end from l where st is not null
union all select session_id, 'hook key', k from (select session_id, unnest(json_keys(raw)) k from l) where k in ({", ".join(repr(k) for k in statements.HOOK_KEYS)}) union all select session_id, 'denial', case when raw->>'$.toolDenialKind'='permission-rule' then 'permission-rule' else '<other>' end from l where json_type(raw,'$.toolDenialKind') is not null)
select session_id, what, label, count(*) n from e group by 1, 2, 3""")
def ag35_session_tallies_by_label(spark, folder):
    """Types, subtypes, hook keys and denial kinds of each session."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"].where("session_id is not null")
    entry = lambda what, label: F.struct(F.lit(what).alias("what"), label.alias("label"))
    known = [x.strip("'") for x in statements.SUBTYPES.split(",")]
    subtype = F.when(F.col("subtype").isin(known), F.col("subtype")).when(F.col("subtype").isNotNull(), "<other>")
    denial = F.when(F.col("denial") == "permission-rule", F.col("denial")).when(F.col("k_denial") != "absent", "<other>")
    hooks = F.transform(F.array_intersect("keys", F.array(*[F.lit(k) for k in statements.HOOK_KEYS])), lambda k: entry("hook key", k))
    every = F.concat(F.array(entry("type", F.col("type")), entry("subtype", subtype), entry("denial", denial)), hooks)
    each = lines.select("session_id", F.explode(every).alias("e")).where("e.label is not null")
    return each.groupBy("session_id", "e.what", "e.label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with s as (select file_name, coalesce(trim(raw),'')='' blank, case when json_valid(raw) and json_type(raw)='OBJECT' then coalesce(case when json_type(raw,'$.type')='VARCHAR' then raw->>'$.type' end, '<no-type>') end t from transcript_lines)
select file_name, case when blank then '<blank>' when t is null then '<malformed>' when t in ({statements.STRIPPED}) then t else '<kept>' end fate, count(*) n from s group by 1, 2""")
def ag41_fates(spark, folder):
    """Per file the fate of its lines: kept, blank, malformed, or stripped by type;
    the fates of a file add up to its lines."""
    classes = corpus.shared(spark, folder, ["classes"])["classes"]
    kind = F.coalesce(tables.text(F.col("v"), "$.type"), F.lit("<no-type>"))
    stripped = [x.strip("'") for x in statements.STRIPPED.split(",")]
    fate = F.when(F.col("class") == "blank", "<blank>").when(F.col("class") != "object", "<malformed>").when(kind.isin(stripped), kind).otherwise("<kept>")
    return classes.groupBy("file_name", fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


# --- drift against a baseline vocabulary, six categories
_SEEN_DUCK = f"""{_OBJ}, seen as materialized (select 'top_level_types' category, coalesce(case when json_type(raw,'$.type')='VARCHAR' then raw->>'$.type' end,'<no-type>') item from o union select 'top_level_keys', unnest(json_keys(raw)) from o
union select 'content_block_types', b->>'$.type' from (select unnest(json_extract(raw,'$.message.content[*]')) b from o where json_type(raw,'$.message.content')='ARRAY') where json_type(b,'$.type')='VARCHAR'
union select 'session_subdirs', split_part(file_name,'/',3) from transcript_lines where length(file_name)-length(replace(file_name,'/',''))>=3
union select 'meta_json_keys', unnest(list_filter([{", ".join(f"case when {k} is not null then '{k}' end" for k in _MKEYS)}], lambda x: x is not null)) from manifests
union select 'versions', raw->>'$.version' from o where json_type(raw,'$.version')='VARCHAR'),
known as (select 'top_level_types' category, record_type item from schema_baseline union select 'top_level_keys', field_path from schema_baseline where not contains(field_path,'.') union values ('content_block_types','text'),('content_block_types','tool_use'),('content_block_types','image'),('session_subdirs','subagents'),('session_subdirs','tool-results'),('meta_json_keys','agent_id'),('meta_json_keys','name'),('versions','2.1.150'))"""


def _baseline(spark, folder) -> DataFrame:
    """(category, item) of the agreed vocabulary."""
    b = table(spark, folder, "schema_baseline")
    fixed = [("content_block_types", x) for x in ("text", "tool_use", "image")] + [("session_subdirs", x) for x in ("subagents", "tool-results")]
    fixed += [("meta_json_keys", x) for x in ("agent_id", "name")] + [("versions", "2.1.150")]
    made = b.select(F.lit("top_level_types").alias("category"), F.col("record_type").alias("item"))
    made = made.unionByName(b.where("not contains(field_path, '.')").select(F.lit("top_level_keys").alias("category"), F.col("field_path").alias("item")))
    return made.unionByName(spark.createDataFrame(fixed, "category string, item string")).distinct()


def _observed(spark, folder) -> DataFrame:
    made = corpus.shared(spark, folder, ["lines", "blocks"])
    lines, blocks = made["lines"], made["blocks"]
    entry = lambda what, item: F.struct(F.lit(what).alias("category"), item.alias("item"))
    of_line = F.concat(F.array(entry("top_level_types", F.col("type")), entry("versions", F.col("version"))), F.transform("keys", lambda k: entry("top_level_keys", k)))
    folder_of = F.when(F.size(F.split("file_name", "/")) >= 4, F.split("file_name", "/")[2])
    parts = [
        lines.select(F.explode(of_line).alias("e")), blocks.select(entry("content_block_types", F.col("block_type")).alias("e")),
        table(spark, folder, "transcript_lines").select(entry("session_subdirs", folder_of).alias("e")),
        table(spark, folder, "manifests").select(F.explode(F.array(*[entry("meta_json_keys", F.when(F.col(k).isNotNull(), k)) for k in _MKEYS])).alias("e")),
    ]
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    return each.select("e.*").where("item is not null").distinct()


@query(f"with {_SEEN_DUCK} select category, item, 'new' change from (select * from seen except select * from known) union all select category, item, 'removed' from (select * from known except select * from seen) where category<>'versions'")
def set01_vocabulary_diff(spark, folder):
    """New and removed items of six categories; versions are only ever added."""
    seen, known = _observed(spark, folder), _baseline(spark, folder)
    removed = known.exceptAll(seen).where("category <> 'versions'").withColumn("change", F.lit("removed"))
    return seen.exceptAll(known).withColumn("change", F.lit("new")).unionByName(removed)


# --- sessions, whole: verification, difficulty, retries, first-seen values
_CALLS_DUCK = f"""{_OBJ}, b as (select line_id, file_name, raw->>'$.sessionId' s, unnest(json_extract(raw,'$.message.content[*]')) b, generate_subscripts(json_extract(raw,'$.message.content[*]'),1) p from o where json_type(raw,'$.message.content')='ARRAY'),
uses as materialized (select * from (select line_id, file_name, s session_id, p, b->>'$.id' id, b->>'$.name' name, b->>'$.input.file_path' fp, b->>'$.input.command' cmd, row_number() over (partition by file_name, b->>'$.id' order by line_id desc, p desc) rn from b where b->>'$.type'='tool_use' and json_type(b,'$.id')='VARCHAR') where rn=1),
err as (select file_name, b->>'$.tool_use_id' id, bool_or(coalesce(json_type(b,'$.is_error')='BOOLEAN' and b->>'$.is_error'='true', false)) e from b where b->>'$.type'='tool_result' group by 1, 2),
calls as materialized (select u.*, coalesce(e, false) is_error from uses u left join err on u.file_name=err.file_name and u.id=err.id)"""
TESTS = r"(pytest|npm (run )?test|cargo test|go test|make test|unittest)"


def _calls(spark, folder) -> DataFrame:
    made = corpus.shared(spark, folder, ["uses", "results"])
    uses, results = made["uses"], made["results"]
    wrong = results.groupBy("file_name", F.col("tool_use_id").alias("id")).agg(F.max("is_error").alias("is_error"))
    met = uses.select("line_id", "pos", "file_name", "session_id", "id", "name", "file_path", "command").join(wrong, ["file_name", "id"], "left")
    return met.withColumn("is_error", F.coalesce("is_error", F.lit(False)))


@query(f"with {_CALLS_DUCK} select name tool, count(*) later, min(d) nearest, max(d) farthest, sum(case when d <= 3 then 1 else 0 end) immediate from (select name, n - max(case when is_error then n end) over (partition by session_id, name order by n rows between unbounded preceding and 1 preceding) d from (select *, row_number() over (partition by session_id order by line_id, p) n from calls)) where d is not null group by 1")
def w04_retry_distance(spark, folder):
    """Calls of a tool that failed before in the session, by the distance in calls."""
    calls = _calls(spark, folder).select("session_id", "name", "line_id", "pos", "is_error", F.lit(1).alias("one"))
    placed = ordered.before(calls, ["session_id"], ["line_id", "pos"], earlier=("sum", "one")).withColumn("n", F.coalesce("earlier", F.lit(0)) + 1)
    wrong = placed.withColumn("e", F.when(F.col("is_error"), F.col("n")))
    apart = ordered.before(wrong, ["session_id", "name"], ["n"], failed=("max", "e")).withColumn("d", F.col("n") - F.col("failed")).where("d is not null")
    return apart.groupBy(F.col("name").alias("tool")).agg(
        F.count(F.lit(1)).alias("later"), F.min("d").alias("nearest"), F.max("d").alias("farthest"), F.sum((F.col("d") <= 3).cast("int")).alias("immediate")
    )


@query(f"with {_CALLS_DUCK}, k as (select session_id, case when name='Edit' then 'edit' when name in ('Read','Grep') then 'check' when name='Bash' and regexp_matches(coalesce(cmd,''), '{TESTS}') then 'test' when name='Bash' and contains(coalesce(cmd,''), 'git commit') then 'commit' end kind, line_id, p from calls), t as (select kind, max(case when kind='check' then (line_id*1000+p) end) over (partition by session_id) last_check, min(case when kind='test' then (line_id*1000+p) end) over (partition by session_id) first_test, line_id*1000+p place from k) select count(*) filter (where kind='edit') edits, count(*) filter (where kind='edit' and last_check>place) checked, count(*) filter (where kind='commit') commits, count(*) filter (where kind='commit' and first_test<place) tested from t")
def mt27_verified(spark, folder):
    """Edits with a later Read or Grep, commits with an earlier test command."""
    command = F.coalesce("command", F.lit(""))
    kind = (
        F.when(F.col("name") == "Edit", "edit").when(F.col("name").isin("Read", "Grep"), "check").when((F.col("name") == "Bash") & command.rlike(TESTS), "test")
        .when((F.col("name") == "Bash") & command.contains("git commit"), "commit")
    )
    marked = _calls(spark, folder).select("session_id", kind.alias("kind"), F.struct("line_id", "pos").alias("at")).where("kind is not null")
    # the last check and first test of each session are aggregates, so no session is windowed
    ends = marked.groupBy("session_id").agg(F.max(F.when(F.col("kind") == "check", F.col("at"))).alias("last_check"), F.min(F.when(F.col("kind") == "test", F.col("at"))).alias("first_test"))
    met = marked.where("kind in ('edit', 'commit')").join(ends, "session_id")
    return met.agg(
        F.count_if(F.col("kind") == "edit").alias("edits"), F.count_if((F.col("kind") == "edit") & (F.col("last_check") > F.col("at"))).alias("checked"),
        F.count_if(F.col("kind") == "commit").alias("commits"), F.count_if((F.col("kind") == "commit") & (F.col("first_test") < F.col("at"))).alias("tested"),
    )


@query(f"with {_CALLS_DUCK}, s as (select session_id, count(distinct fp) files, count(distinct name) tools, count(*) calls, sum(is_error::int)/count(*) density from calls where session_id is not null group by 1) select count(*) sessions, round(avg(files),6) files, round(avg(tools),6) tools, round(avg(calls),6) calls, round(avg(density),6) density, round(corr(calls, files),6) calls_files, round(corr(calls, density),6) calls_density from s")
def mt29_difficulty_correlated(spark, folder):
    """Difficulty proxies of sessions and how they go together."""
    calls = _calls(spark, folder).where("session_id is not null")
    by = calls.groupBy("session_id").agg(
        F.count_distinct("file_path").alias("files"), F.count_distinct("name").alias("tools"), F.count(F.lit(1)).alias("calls"), F.avg(F.col("is_error").cast("int")).alias("density")
    )
    r = lambda c, name: F.round(c, 6).alias(name)
    return by.agg(
        F.count(F.lit(1)).alias("sessions"), r(F.avg("files"), "files"), r(F.avg("tools"), "tools"), r(F.avg("calls"), "calls"), r(F.avg("density"), "density"),
        r(F.corr("calls", "files"), "calls_files"), r(F.corr("calls", "density"), "calls_density"),
    )


@query(f"""with {_OBJ}, l as (select raw->>'$.version' v, unnest([{{'k':'subtype','x':case when json_type(raw,'$.subtype')='VARCHAR' then raw->>'$.subtype' end}},{{'k':'stop_reason','x':case when json_type(raw,'$.message.stop_reason')='VARCHAR' then raw->>'$.message.stop_reason' end}},{{'k':'type','x':case when json_type(raw,'$.type')='VARCHAR' then raw->>'$.type' end}}]) e from o where json_type(raw,'$.version')='VARCHAR' and regexp_full_match(raw->>'$.version','[0-9]+\\.[0-9]+\\.[0-9]+'))
select e.k "key", e.x "value", min_by(v, split_part(v,'.',1)::bigint*1000000000000+split_part(v,'.',2)::bigint*1000000+split_part(v,'.',3)::bigint) first_version, count(*) n from l where e.x is not null group by 1, 2""")
def mt25_first_seen_values(spark, folder):
    """First version with each value of the enumerated fields."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"].where((F.col("k_version") == "str") & F.col("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z"))
    entry = lambda k: F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))
    typed = lines.withColumn("type", F.nullif("type", F.lit("<no-type>")))
    each = typed.select("version", F.explode(F.array(entry("subtype"), entry("stop_reason"), entry("type"))).alias("e")).where("e.value is not null")
    parts = F.struct(*[F.split("version", r"\.")[i].cast("bigint") for i in range(3)])
    return each.groupBy("e.key", "e.value").agg(F.min_by("version", parts).alias("first_version"), F.count(F.lit(1)).alias("n"))


@query(f"""with {_OBJ}, l as (select line_id, raw->>'$.sessionId' s, case when json_type(raw,'$.aiTitle')='VARCHAR' then raw->>'$.aiTitle' end t, case when json_type(raw,'$.lastPrompt')='VARCHAR' then raw->>'$.lastPrompt' end p, case when json_type(raw,'$.gitBranch')='VARCHAR' then raw->>'$.gitBranch' end g from o where json_type(raw,'$.sessionId')='VARCHAR')
select s session_id, arg_max(t, line_id) filter (where t is not null) title, arg_max(p, line_id) filter (where p is not null) last_prompt, arg_max(g, line_id) filter (where g is not null) branch, count(*) n, max(line_id) last_line from l group by 1""")
def mt37_session_rows(spark, folder):
    """Index row of each session: title, last prompt, branch, lines, last line."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"].where("session_id is not null")
    last = lambda c, name: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_id"))).alias(name)
    return lines.groupBy("session_id").agg(last("ai_title", "title"), last("last_prompt", "last_prompt"), last("git_branch", "branch"), F.count(F.lit(1)).alias("n"), F.max("line_id").alias("last_line"))


# --- ordered functions over groups of any size: the statements' names, cut into blocks
def _replaces(f):
    """A query that takes the place of the statement of its name; the statement's
    checking text stays."""
    QUERIES[f.__name__] = f
    return f


@_replaces
def mt20_retry_rate(spark, folder):
    """Errors per tool, and later calls of the tool in the session."""
    calls = _calls(spark, folder).select("session_id", F.col("name").alias("tool"), "line_id", "pos", F.col("is_error").cast("int").alias("e"))
    placed = ordered.before(calls, ["session_id", "tool"], ["line_id", "pos"], failed=("sum", "e"))
    return placed.groupBy("tool").agg(F.count_if(F.col("e") == 1).alias("errors"), F.count_if(F.col("failed") > 0).alias("retries"))


@_replaces
def mt21_loose_retry(spark, folder):
    """Calls of the tool that the session called just before."""
    uses = corpus.shared(spark, folder, ["uses"])["uses"].select("session_id", "name", "line_id", "pos")
    placed = ordered.before(uses, ["session_id"], ["line_id", "pos"], previous=("last", "name"))
    return placed.where("name = previous").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@_replaces
def mt26_segments(spark, folder):
    """Stretches of prompts of a project without a pause of more than an hour."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"]
    prompts = lines.where("type = 'user' and prompt_id is not null and k_content = 'str' and ts_ms is not null and not is_sidechain").select("slug", "ts_ms", "line_id")
    placed = ordered.before(prompts, ["slug"], ["ts_ms", "line_id"], previous=("last", "ts_ms"))
    new = F.col("previous").isNull() | (F.col("ts_ms") - F.col("previous") > 3_600_000)
    return placed.groupBy("slug").agg(F.count_if(new).alias("segments"), F.count(F.lit(1)).alias("prompts"))


@_replaces
def mt32_gaps(spark, folder):
    """Longest pause of each transcript."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"].where("ts_ms is not null").select("file_name", "ts_ms", "line_id")
    placed = ordered.before(lines, ["file_name"], ["ts_ms", "line_id"], previous=("last", "ts_ms"))
    return placed.groupBy("file_name").agg(F.max(F.col("ts_ms") - F.col("previous")).alias("longest"))


@_replaces
def jn14_firing_overlaps(spark, folder):
    """Firings that overlap an earlier or a later one of their session."""
    fired = corpus.run(spark, folder, statements.FIRINGS).where("start_ms is not null").select("session_id", "pid", "start_ms", F.coalesce("end_ms", "start_ms").alias("stop"))
    ahead = ordered.before(fired, ["session_id"], ["start_ms", "pid"], latest=("max", "stop"))
    # backwards: the next start is the last of the negated order
    turned = ahead.withColumns({"back": -F.col("start_ms"), "pid_back": -F.col("pid")})
    both = ordered.before(turned, ["session_id"], ["back", "pid_back"], following=("last", "start_ms"))
    overlaps = F.coalesce(F.col("start_ms") <= F.col("latest"), F.lit(False)) | F.coalesce(F.col("following") <= F.col("stop"), F.lit(False))
    return both.select("session_id", "pid", overlaps.alias("is_overlap"))


@_replaces
def w08_placeholders(spark, folder):
    """Place of each folder by its first appearance."""
    lines = corpus.shared(spark, folder, ["lines"])["lines"].where("cwd is not null")
    firsts = lines.groupBy("cwd").agg(F.min("line_id").alias("first"))
    return ordered.ranked(firsts, ["first"], "place").select("cwd", F.col("place").cast("int").alias("place"))


# --- operators whose cases no delivered line has: records written from other tables
_SKILLS = """select o_orderkey line_id, concat('f', o_custkey % 5, '.jsonl') file_name, 's' slug, to_json(named_struct('type','assistant','attributionSkill',if(o_orderkey % 3 = 0, concat('skill', o_orderkey % 4), null),'isSidechain',o_orderkey % 2 = 0)) raw from {src}"""


@query("select 'f'||(o_custkey%5)||'.jsonl' file_name, 'skill'||(o_orderkey%4) attribution_skill, o_orderkey % 2 = 0 is_sidechain, count(*) n from orders where o_orderkey % 3 = 0 group by 1, 2, 3")
def mt24_skill_turns(spark, folder):
    """Turns by skill and file, sidechain apart."""
    lines = _made(spark, folder, "orders", _SKILLS).where("attribution_skill is not null")
    return lines.groupBy("file_name", "attribution_skill", "is_sidechain").agg(F.count(F.lit(1)).alias("n"))


_DECIDED = """select o_orderkey line_id, 'f.jsonl' file_name, 's' slug, to_json(named_struct('type','user','permissionDecision',named_struct('decision',if(o_orderkey % 2 = 0, 'allow', 'deny'),'source',lower(o_orderstatus),'reasonType',if(o_orderkey % 5 = 0, null, o_orderpriority)))) raw from {src}"""


@query("select case when o_orderkey%2=0 then 'allow' else 'deny' end decision, lower(o_orderstatus) decision_source, case when o_orderkey%5=0 then null else o_orderpriority end reason_type, count(*) n from orders group by 1, 2, 3")
def mt34_decisions(spark, folder):
    """Permission decisions by class; silent and failed ones are one class."""
    lines = _made(spark, folder, "orders", _DECIDED).where("k_decision = 'dict'")
    return lines.groupBy("decision", "decision_source", "reason_type").agg(F.count(F.lit(1)).alias("n"))


_TAGGED = """select o_orderkey line_id, 'f.jsonl' file_name, 's' slug, to_json(named_struct('type','user','message',named_struct('content',array(named_struct('type','tool_result','tool_use_id','t','content',
concat('a <Persisted-Output-', o_orderkey % 3, '> b <b> <not\\nclosed persist> </persisted-output> ', o_orderpriority)))))) raw from {src}"""


@query("select '<persisted-output-'||(o_orderkey%3)||'>' tag, count(*) n from orders group by 1 union all select '</persisted-output>', count(*) from orders")
def ag24_tags(spark, folder):
    """Tags of persisted output, in lower case."""
    texts = tables.result_texts(tables.blocks(_made(spark, folder, "orders", _TAGGED)))
    tags = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(<[^>\n]{1,40}>)"), F.lit(1))).alias("tag"))
    kept = tags.where(F.col("tag").contains("persist") | F.col("tag").contains("output"))
    return kept.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("""with f as (select session_id, pid, session_id || ':' || coalesce((min_by({'v': tool}, o)).v,'-') tid, (min_by({'v': hook_event}, o)).v ev, max_by(decision, case when decision is not null then o end) decision, count(*) filter (where phase='exit') exits
from (select *, row_number() over (partition by session_id, pid order by ts_ms, phase, coalesce(hook_event,''), coalesce(tool_use_id,''), coalesce(decision,''), coalesce(duration_ms,-1)) o from dispatch) group by session_id, pid)
select session_id, pid, tid tool_use_id from f a where ev='PreToolUse' and decision is null and exists (select 1 from f b where b.tid=a.tid and b.ev='PostToolUse' and b.exits>0)""")
def jn19_silent_allow(spark, folder):
    """PreToolUse firings without a decision whose call (here: a tool of a session)
    ran to its PostToolUse."""
    fired = corpus.run(spark, folder, statements.FIRINGS)
    fired = fired.withColumn("tool_use_id", F.concat("session_id", F.lit(":"), F.coalesce("tool", F.lit("-"))))
    ran = fired.where("event = 'PostToolUse' and exits > 0").select("tool_use_id").distinct()
    silent = fired.where("event = 'PreToolUse' and decision is null").join(ran, "tool_use_id", "left_semi")
    return silent.select("session_id", "pid", "tool_use_id")


# --- the sanitizer over all values and rules of every line
_PATH_RULES = {"version": 1, "paths": [{"match": "/home/dev/", "replace": "/home/user/"}, {"match": "/srv/work/", "replace": "/srv/p/"}], "options": {"scrub_git_branch": False}}


def _rewritten(spark, folder, rules: dict) -> DataFrame:
    lines = table(spark, folder, "transcript_lines").select("file_name", F.col("line_id").alias("line_no"), "raw")
    return sanitize.rewrite(lines, sanitize.load_rules(rules))


_KEPT_DUCK = f"k as materialized (select line_id, file_name, json(raw)::varchar j from transcript_lines where json_valid(raw) and json_type(raw)='OBJECT' and json_type(raw,'$.type')='VARCHAR' and raw->>'$.type' not in ({statements.STRIPPED}))"


@query(f"with {_KEPT_DUCK}, r(m, p) as (values ('/home/dev/','/home/user/'),('/srv/work/','/srv/p/')) select 'paths' layer, m original, p replacement, sum((length(j)-length(replace(j,m,'')))/length(m))::bigint occurrences, min(line_id) first_line from k, r where contains(j, m) group by 2, 3")
def ag38_substitutions(spark, folder):
    """What the path rules replace in all values of all lines."""
    return sanitize.substitutions(_rewritten(spark, folder, _PATH_RULES)).where("layer = 'paths'")


@query(f"with {_KEPT_DUCK} select file_name, count(*) filter (where contains(j,'/home/dev/') or contains(j,'/srv/work/')) changed, count(*) survivors from k group by 1")
def san03_paths(spark, folder):
    """Per file the lines that the path rules change, and all that survive."""
    done = _rewritten(spark, folder, _PATH_RULES).where("state = 'kept'")
    changed = F.exists("layer", lambda x: x == "paths")
    return done.groupBy("file_name").agg(F.count_if(changed).alias("changed"), F.count(F.lit(1)).alias("survivors"))


_TORN_RULES = {"version": 1, "paths": [{"match": "re:/home/dev/(?=[a-m])", "replace": "/h1/"}, {"match": "/home/dev/", "replace": "/h2/"}], "options": {"scrub_git_branch": False}}


@query(f"with {_KEPT_DUCK}, c as (select sum((length(j)-length(regexp_replace(j,'/home/dev/[a-m]','/home/dev/','g'))))::bigint a, sum((length(j)-length(replace(j,'/home/dev/','')))/10)::bigint b from k) select 'paths' layer, '/home/dev/' original, case when a > 0 and a < b then 2 else 1 end replacements from c where a > 0 and a < b")
def ag39_conflicts(spark, folder):
    """Originals that rules replace in different ways."""
    found = sanitize.substitutions(_rewritten(spark, folder, _TORN_RULES)).where("layer <> 'secrets'")
    by = found.groupBy("layer", "original").agg(F.count_distinct("replacement").alias("replacements"))
    return by.where("replacements > 1")


@query()
def ag40_secret_counts(spark, folder):
    """Credentials by kind in all values of all lines."""
    found = sanitize.substitutions(_rewritten(spark, folder, _PATH_RULES)).where("layer = 'secrets'")
    return found.groupBy(F.col("original").alias("kind")).agg(F.sum("occurrences").alias("n"))


_REMAP_RULES = {"version": 1, "options": {"remap_uuids": True, "uuid_seed": "seed", "scrub_git_branch": True}}


@query("""with k as materialized (select raw from transcript_lines where json_valid(raw) and json_type(raw)='OBJECT' and json_type(raw,'$.type')='VARCHAR' and raw->>'$.type' not in (""" + statements.STRIPPED + """)),
u as (select distinct unnest(list_filter([case when json_type(raw,'$.uuid')='VARCHAR' then raw->>'$.uuid' end, case when json_type(raw,'$.parentUuid')='VARCHAR' then raw->>'$.parentUuid' end, case when json_type(raw,'$.sessionId')='VARCHAR' then raw->>'$.sessionId' end, case when json_type(raw,'$.agentId')='VARCHAR' then raw->>'$.agentId' end, case when json_type(raw,'$.toolUseResult.agentId')='VARCHAR' then raw->>'$.toolUseResult.agentId' end], lambda x: x is not null)) id from k),
h as (select id, sha256('seed'::blob || '\\x00'::blob || encode(id)) h from u),
b as (select distinct raw->>'$.gitBranch' id from k where json_type(raw,'$.gitBranch')='VARCHAR' and raw->>'$.gitBranch' not in ('', '<branch>'))
select id original, concat_ws('-', substr(h,1,8), substr(h,9,4), substr(h,13,4), substr(h,17,4), substr(h,21,12)) replacement from h union all select id, '<branch>' from b""")
def san06_remap(spark, folder):
    """New ids at all id positions, and branches at theirs."""
    return sanitize.substitutions(_rewritten(spark, folder, _REMAP_RULES)).where("layer = 'identifiers'").select("original", "replacement")


# --- delegation trees by where each subagent was called
@query("""with recursive b as (select file_name, b->>'$.id' id from (select file_name, unnest(json_extract(raw,'$.message.content[*]')) b from transcript_lines where json_valid(raw) and json_type(raw,'$.message.content')='ARRAY') where b->>'$.type'='tool_use' and json_type(b,'$.id')='VARCHAR'),
w as (select id, min(case when file_name like '%/subagents/agent-%' then regexp_extract(file_name, 'agent-([^/]*)\\.jsonl$', 1) else '' end) caller from b group by id),
m as materialized (select agent_id, max(tool_use_id) t, max(parent_agent_id) p, max(spawn_depth) d from manifests where agent_id is not null group by 1),
n as materialized (select agent_id, d, coalesce(nullif(w.caller,''), p) parent, w.id is not null located from m left join w on m.t=w.id),
t(agent_id, root_id, "depth") as (select agent_id, agent_id, 0 from n where parent is null or parent not in (select agent_id from n) union all select n.agent_id, t.root_id, t."depth"+1 from n join t on n.parent=t.agent_id)
select n.agent_id, coalesce(t.root_id,'') root_id, coalesce(t."depth", -1) as "depth", n.located, n.d = t."depth"+1 agrees from n left join t on n.agent_id=t.agent_id""")
def jn07_located_tree(spark, folder):
    """Trees of subagents: each hangs on the trace that holds its call (any file is
    searched; calls of main sessions make roots), else on its stated parent; and
    whether the depth is the one stated."""
    uses = corpus.shared(spark, folder, ["blocks"])["blocks"].where("block_type = 'tool_use' and id is not null")
    caller = F.when(F.col("file_name").contains("/subagents/agent-"), F.regexp_extract("file_name", r"agent-([^/]*)\.jsonl$", 1)).otherwise("")
    where = uses.groupBy(F.col("id").alias("tool_use_id")).agg(F.min(caller).alias("caller"))
    m = table(spark, folder, "manifests").where("agent_id is not null").groupBy("agent_id").agg(
        F.max("tool_use_id").alias("tool_use_id"), F.max("parent_agent_id").alias("p"), F.max("spawn_depth").alias("stated"), F.min("session_id").alias("near")
    )
    met = m.join(where, "tool_use_id", "left")
    edges = met.select(F.col("agent_id").alias("id"), F.coalesce(F.nullif("caller", F.lit("")), "p").alias("parent"), "near", "stated", F.col("caller").isNotNull().alias("located"))
    solved = hierarchy.hierarchy(edges, near=["near"], carry=("stated", "located"))
    agrees = F.when(F.col("depth") >= 0, F.col("stated") == F.col("depth") + 1)
    return solved.select(F.col("id").alias("agent_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth", "located", agrees.alias("agrees"))


#: Rates per million tokens of the models in the test tables: data, given to the operator as a table.
_TABLE_RATES = [("quill-large-4", 5.0, 25.0), ("quill-medium-4", 3.0, 15.0), ("quill-medium-5", 3.0, 15.0), ("quill-small-4", 1.0, 5.0)]


@query("with recursive " + corpus.oracle(statements.ALL["mt01_snapshots"])[5:].rpartition("select file_name, message_id")[0] + """, r(model, i) as (values ('quill-large-4', 5.0::double), ('quill-medium-4', 3.0::double), ('quill-medium-5', 3.0::double), ('quill-small-4', 1.0::double))
select t.model canonical, count(*) n, count(*) filter (where r.i is null) unpriced, round(sum(r.i*(coalesce(input_tokens,0) + 5*coalesce(output_tokens,0) + coalesce(cache_read_tokens,0)*0.1::double + case when k_cache_creation='dict' then coalesce(write_5m,0)*1.25::double+coalesce(write_1h,0)*2 else coalesce(cache_creation_tokens,0)*1.25::double end)/1000000), 6) as cost
from turns t left join r on t.model=r.model and t.ts_ms is not null where coalesce(t.model,'')<>'<synthetic>' group by 1""")
def mt07_cost(spark, folder):
    """Cost per model of all reduced turns; turns of models without a rate are counted."""
    rates = spark.createDataFrame([(m, "1970-01-01", None, i, o, None, None) for m, i, o in _TABLE_RATES], RATES_DDL).withColumns({c: F.to_date(c) for c in ("valid_from", "valid_to")})
    return rollups.cost_by(rollups.priced(corpus.shared(spark, folder, ["turns"])["turns"], rates), "canonical")


@query(f"with {_KEPT_DUCK}, r(m, i) as (values ('/home/dev/', 0), ('/srv/work/', 1)) select 'paths' section, i::integer \"index\", count(*) n, min(line_id) first_line from k, r where contains(j, m) group by 2")
def san11_literal_survivors(spark, folder):
    """What the residual scan finds in lines that were not rewritten, by rule, with
    the first violation (the scan of rewritten lines is ``san12_residual``)."""
    done = _rewritten(spark, folder, _PATH_RULES).where("state = 'kept'").select("file_name", "line_no")
    raw = table(spark, folder, "transcript_lines").select(F.col("line_id").alias("line_no"), F.col("raw").alias("out"))
    found = sanitize.residual(done.join(raw, "line_no"), sanitize.load_rules(_PATH_RULES)).where("section = 'paths'")
    return found.groupBy("section", "index").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


@_replaces
def jn15_asof_back(spark, folder):
    """Each dispatch row with the last PreToolUse exit before it in its session, by time."""
    rows = table(spark, folder, "dispatch").select("session_id", F.floor("ts_ms").cast("bigint").alias("ts_ms"), "phase", "pid", "hook_event")
    done = F.when((F.col("hook_event") == "PreToolUse") & (F.col("phase") == "exit"), F.col("ts_ms"))
    placed = ordered.asof(rows.withColumn("done", done), ["session_id"], "ts_ms", "done", "before")
    return placed.select("session_id", "ts_ms", "phase", "pid", "before")


@_replaces
def jn17_asof_forward(spark, folder):
    """Each dispatch row with the first exit of the same event after it, by time."""
    rows = table(spark, folder, "dispatch").where("session_id is not null").select("session_id", "hook_event", F.floor("ts_ms").cast("bigint").alias("ts_ms"), "phase", "pid")
    placed = ordered.asof(rows.withColumn("done", F.when(F.col("phase") == "exit", F.col("ts_ms"))), ["session_id", "hook_event"], "ts_ms", "done", "next", later=True)
    return placed.select("session_id", "ts_ms", "pid", "next")
