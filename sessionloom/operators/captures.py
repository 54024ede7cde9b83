"""Reports over captures: telemetry by sequence, hook guards, manifests, restore
points, spilled results and commits.

Events of one session are ordered by their sequence, which may be missing; joins
by order go through ``ordered.asof``, which splits a hot session.

Defined cases: a sequence that is missing or no number is null and meets nothing,
in requests also zero counts as missing; an attribute off the allow-list has a name
but no value; counts that are no numbers are 0; a row without its counterpart keeps
nulls; empty tables give empty reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import ordered, tables

#: Fixed value: what the names of logged events start with.
EVENT_PREFIX = "claude_code."
#: Attributes whose values reports may show.
ALLOWED = frozenset(
    "event.name event.timestamp event.sequence session.id prompt.id app.version service.name service.version terminal.type "
    "hook_event hook_name hook_type hook_source hook_matcher num_hooks num_success num_blocking num_non_blocking_error num_cancelled total_duration_ms "
    "stdout_chars additional_context_chars system_message_chars initial_user_message_chars num_outputs_persisted managed_only "
    "tool_name tool_use_id decision source tool_source success duration_ms error_type decision_type decision_source "
    "tool_input_size_bytes tool_result_size_bytes mcp_server_scope "
    "model cost_usd cost_usd_micros input_tokens output_tokens cache_read_tokens cache_creation_tokens query_source speed effort type agent.name "
    "agent_type agent.source is_built_in is_async total_tokens total_tool_uses final_model model_swapped agent_id parent_agent_id "
    "permission_mode trigger".split()
)
#: Fixed value: the mark of a trailer that counts a subagent's tokens.
TRAILER = "subagent_tokens"
#: Fixed value: the words before the path in a wrapper of spilled output.
SAVED_TO = "saved to: "
WORD = r"^[A-Za-z0-9_.:+-]{1,64}\z"  #: a value of a closed vocabulary


def word(value: Column) -> Column:
    """A word of a closed vocabulary, ``-`` for null, else ``<other>``."""
    return F.when(value.isNull(), "-").when(value.cast("string").rlike(WORD), value.cast("string")).otherwise("<other>")


def number(value: Column) -> Column:
    """A number as text, ``-`` where there is none."""
    return F.coalesce(value.cast("string").try_cast("bigint").cast("string"), F.when(value.cast("string").try_cast("double").isNotNull(), value.cast("string")), F.lit("-"))


def id_tail(value: Column) -> Column:
    """The last eight characters of an opaque id, ``-`` for anything else."""
    return F.when(value.rlike(r"^[A-Za-z0-9_-]+\z"), F.concat(F.lit("…"), F.right(value, F.lit(8)))).otherwise("-")


def sentinel(path: Column, known: list[str]) -> Column:
    """The file name of a path if it is a known sentinel, else ``<other>``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.isin(known), name).otherwise("<other>")


def safe_name(name: Column, prefix: str = EVENT_PREFIX) -> Column:
    """A signal's name where it has the fixed prefix, else ``<other>``."""
    return F.when(name.startswith(prefix), name).otherwise("<other>")


def routed(path: Column, routes: dict[str, str], otherwise: str = "no-decision") -> Column:
    """Route of a call by the file name it reads."""
    name, out = F.element_at(F.split(path, "/"), -1), F.lit(otherwise)
    for file, route in routes.items():
        out = F.when(name == file, route).otherwise(out)
    return out


def sequence(attrs: str = "attrs") -> Column:
    """The place of an event in its session, null if it has none."""
    return F.try_element_at(attrs, F.lit("event.sequence")).try_cast("bigint")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def events(signals: DataFrame, name: str) -> DataFrame:
    """Logged events of a name, with session and sequence."""
    some = signals.where((F.col("signal") == "log") & (F.col("body") == EVENT_PREFIX + name))
    return some.select(_attr("session.id").alias("session_id"), sequence().alias("seq"), "attrs")


def signal_counts(signals: DataFrame) -> DataFrame:
    """Signals by kind and name, names only from the closed vocabulary."""
    name = F.when(F.col("signal") == "log", F.col("body")).otherwise(F.col("name"))
    return signals.groupBy("signal", word(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def span_counts(signals: DataFrame) -> DataFrame:
    return signals.where("signal = 'span'").groupBy(word(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def redacted_names(signals: DataFrame) -> DataFrame:
    """Names of the attributes whose values the allow-list held back."""
    each = signals.select(F.explode(F.map_keys("attrs")).alias("name")).where(~F.col("name").isin(sorted(ALLOWED)))
    return each.groupBy(word(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def request_totals(requests: DataFrame) -> DataFrame:
    """Requests, four token sums and cost by source, model and agent."""
    whole = lambda c: F.sum(F.coalesce(_attr(c).try_cast("bigint"), F.lit(0)))
    cost = F.sum(F.coalesce(_attr("cost_usd").try_cast("double"), F.lit(0.0)))
    by = [word(_attr("query_source")).alias("source"), word(_attr("model")).alias("model"), word(_attr("agent.name")).alias("agent")]
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), whole("input_tokens").alias("input"), whole("output_tokens").alias("output"),
        whole("cache_read_tokens").alias("cache_read"), whole("cache_creation_tokens").alias("creation"), cost.alias("cost"),
    )


def _hooks(signals: DataFrame) -> DataFrame:
    body = F.col("body")
    kind = F.when(body == EVENT_PREFIX + "tool_decision", "decision").when(body == EVENT_PREFIX + "hook_execution_start", "start").when(body == EVENT_PREFIX + "hook_execution_complete", "complete")
    some = signals.where("signal = 'log'").withColumn("kind", kind).where("kind is not null")
    return some.select(_attr("session.id").alias("session_id"), sequence().alias("seq"), "kind", _attr("hook_event").alias("hook_event"), _attr("hook_name").alias("hook_name"), _attr("tool_use_id").alias("tool_use_id"))


def asof_before(signals: DataFrame) -> DataFrame:
    """(session_id, seq, tool_use_id, before): decisions with the last PreToolUse
    completion whose sequence is lower."""
    done = F.when((F.col("kind") == "complete") & (F.col("hook_event") == "PreToolUse"), F.col("seq"))
    marked = ordered.asof(_hooks(signals).withColumn("done", done), ["session_id"], "seq", "done", "before")
    return marked.where("kind = 'decision'").select("session_id", "seq", "tool_use_id", "before")


def asof_after(signals: DataFrame) -> DataFrame:
    """(session_id, hook_name, seq, complete): starts with the first completion of
    the same hook whose sequence is higher."""
    done = F.when(F.col("kind") == "complete", F.col("seq"))
    marked = ordered.asof(_hooks(signals).withColumn("done", done), ["session_id", "hook_name"], "seq", "done", "complete", later=True)
    return marked.where("kind = 'start'").select("session_id", "hook_name", "seq", "complete")


def requests_inside(starts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests strictly between start and completion; no or zero sequence is -1."""
    asked = requests.select("session_id", F.coalesce(F.nullif("seq", F.lit(0)), F.lit(-1)).alias("request"))
    met = starts.where("complete is not null").join(asked, "session_id").where("seq < request and request < complete")
    return met.select("session_id", "hook_name", "seq", "complete", "request")


def decisions_fired(decisions: DataFrame, firings: DataFrame) -> DataFrame:
    """Decisions with the last PreToolUse firing of their call."""
    last = firings.where("event = 'PreToolUse' and tool_use_id is not null").groupBy("tool_use_id").agg(
        F.max_by(F.struct("route", F.col("decision").alias("fired")), F.struct("start_ms", "session_id", "pid")).alias("f")
    )
    told = decisions.select("session_id", "seq", _attr("tool_use_id").alias("tool_use_id"), _attr("decision").alias("decision"))
    return told.join(last, "tool_use_id", "left").select("session_id", "seq", "tool_use_id", "decision", "f.route", "f.fired")


def guard_table(requests: DataFrame) -> DataFrame:
    """Requests of a guard: id tail, whether delivered, time held in ms to a tenth."""
    return requests.select(
        "session_id", id_tail(F.col("tool_use_id")).alias("tool"), word(F.col("delivered")).alias("delivered"), F.round(F.col("sent_ms") - F.col("recv_ms"), 1).alias("held_ms")
    )


def cost_states(lines: DataFrame) -> DataFrame:
    """(session_id, model, stated_input, stated_output, stated_cost) of cost-state records."""
    held = lines.where("type = 'cost-state'").select("session_id", tables.at(F.col("v"), "$.modelUsage").alias("u"))
    each = held.sparkSession.sql("select l.session_id, e.key model, e.value c from {l} l, lateral variant_explode(l.u) e", l=held)
    c = F.col("c")
    return each.select(
        "session_id", "model", F.try_variant_get(c, "$.inputTokens", "bigint").alias("stated_input"), F.try_variant_get(c, "$.outputTokens", "bigint").alias("stated_output"),
        F.try_variant_get(c, "$.costUSD", "double").alias("stated_cost"),
    )


def restore_points(lines: DataFrame, checkpoint: str) -> DataFrame:
    """(path, backup, versions): per file its latest backup up to the checkpoint."""
    v = F.col("v")
    held = lines.where("type = 'file-history-snapshot'").select(
        "line_id", F.try_to_timestamp(tables.text(v, "$.snapshot.timestamp")).alias("at"), tables.at(v, "$.snapshot.trackedFileBackups").alias("b")
    )
    held = held.where(F.col("at") <= F.lit(checkpoint).cast("timestamp"))
    each = held.sparkSession.sql("select l.line_id, l.at, e.key path, try_variant_get(e.value, '$.backupFileName', 'string') backup from {l} l, lateral variant_explode(l.b) e", l=held)
    return each.groupBy("path").agg(F.max_by("backup", F.struct("at", "line_id")).alias("backup"), F.count(F.lit(1)).alias("versions"))


def spill_pointers(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(line_id, pointer, file, present, bytes): where results were spilled to, by
    the envelope's pointer or else the wrapper's text, and the files found
    (``path``, ``bytes``), met by file name."""
    text = F.try_variant_get("v", "$.message.content[0].content", "string")
    wrapped = F.when(text.contains(SAVED_TO), F.regexp_extract(F.substring_index(text, SAVED_TO, -1), r"^(\S+)", 1))
    path = F.coalesce("e_spill_path", wrapped)
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    held = lines.select("line_id", F.when(F.col("e_spill_path").isNotNull(), "envelope").otherwise("text").alias("pointer"), base(path).alias("file")).where("file is not null")
    there = files.groupBy(base(F.col("path")).alias("file")).agg(F.max("bytes").alias("bytes"))
    return held.join(there, "file", "left").select("line_id", "pointer", "file", F.col("bytes").isNotNull().alias("present"), "bytes")


def expired(files: DataFrame, *, now: str, days: int = 30) -> DataFrame:
    """(file_name, expired): files whose last change is more than the cleanup period
    ago; the period is at least a day, and a session that is resumed changes again."""
    age = F.datediff(F.lit(now).cast("date"), F.col("modified").cast("date"))
    return files.select("file_name", (age > max(1, days)).alias("expired"))


def commit_candidates(lines: DataFrame, commits: DataFrame, *, after_ms: int = 600_000) -> DataFrame:
    """(session_id, commit_id): commits in a session's folder and branch, from its
    start to ``after_ms`` past its end; many to many, nothing is reduced."""
    held = lines.where("session_id is not null and cwd is not null and git_branch is not null")
    spans = held.groupBy("session_id", "cwd", "git_branch").agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"))
    met = commits.join(spans, ["cwd", "git_branch"])
    return met.where(F.col("at_ms").between(F.col("t0"), F.col("t1") + after_ms)).select("session_id", "commit_id")


MANIFEST_KEYS = ("agent_type", "description", "tool_use_id", "model", "parent_agent_id", "worktree_path")


def manifest_shapes(manifests: DataFrame, lines: DataFrame) -> DataFrame:
    """(version, shape, n): manifests, present keys, the allowed value (depth) and
    traces of several versions, by the earliest version on each one's trace."""
    part = lambda i: F.split("version", r"\.")[i].cast("bigint")
    sound = lines.where((F.col("k_version") == "str") & F.col("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z"))
    own = sound.groupBy(F.col("file_name").alias("trace")).agg(F.min_by("version", F.struct(part(0), part(1), part(2))).alias("version"), (F.count_distinct("version") > 1).alias("several"))
    held = manifests.withColumn("trace", F.regexp_replace("file_name", r"\.meta\.json$", ".jsonl")).join(own, "trace", "left")
    shapes = [F.lit("<manifests>"), F.when(F.col("several"), "<several versions>"), F.concat(F.lit("spawn_depth="), F.col("spawn_depth").cast("string"))]
    shapes += [F.when(F.col(k).isNotNull(), k) for k in MANIFEST_KEYS]
    each = held.select(F.coalesce("version", F.lit("<unattributed>")).alias("version"), F.explode(F.array(*shapes)).alias("shape")).where("shape is not null")
    return each.groupBy("version", "shape").agg(F.count(F.lit(1)).alias("n"))


def depth_contrast(manifests: DataFrame, results: DataFrame) -> DataFrame:
    """Per spawn depth the result blocks of its calls: every match, distinct calls
    located and not, containers, envelopes beside them (null counts), trailers."""
    targets = manifests.where("tool_use_id is not null").groupBy("tool_use_id").agg(F.max("spawn_depth").alias("d"))
    trailer = F.coalesce(F.try_variant_get("inner", "$", "string"), F.to_json("inner")).contains(TRAILER)
    sites = results.select(F.col("tool_use_id").alias("id"), "container", F.col("k_envelope") != "absent", trailer).toDF("id", "container", "enveloped", "trailer")
    met = targets.join(sites, targets["tool_use_id"] == sites["id"], "left")
    return met.groupBy(F.coalesce(F.col("d").cast("string"), F.lit("<absent>")).alias("depth")).agg(
        F.count("id").alias("sites"), F.count_distinct("id").alias("located"), (F.count_distinct("tool_use_id") - F.count_distinct("id")).alias("not_located"),
        F.count_if(F.col("container") == "subagent-trace").alias("in_traces"), F.count_if(F.col("container") == "parent-session").alias("in_parents"),
        F.count_if("enveloped").alias("with_envelope"), F.count_if("trailer").alias("with_trailer"),
    )


def only_new_run(before: DataFrame, after: DataFrame, column: str = "run_id"):
    """The one id in ``after`` that is not in ``before``; anything else is an error."""
    found = after.select(column).distinct().join(before.select(column).distinct(), column, "left_anti").limit(2).collect()
    if len(found) != 1:
        raise ValueError("no new run" if not found else "several new runs")
    return found[0][0]
