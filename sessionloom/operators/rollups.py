"""Tokens and money of agent calls: rollups that a parent line holds, the trace
they sum up, and costs by a rate table.

Rates are data: a table ``model, valid_from, valid_to, input, output, fast_input,
fast_output`` (per million tokens; ``valid_to`` null: still valid; fast rates null:
no fast mode).  Models meet it in one writing, so suffixes, dates and aliases need
no rows of their own.

Defined cases: a turn of a model without a rate, or outside every rate's dates,
keeps a null cost and is counted as unpriced; ``<synthetic>`` is no call and has no
cost; absent token counts are 0; without ``cache_creation`` all writes are of the
short kind; fast mode on a model without fast rates is priced as standard; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factors of the input rate for cache writes of five minutes, of an hour, and for hits;
#: the batch factor on input and output; the regional factor on all tokens; money per web search.
WRITE_5M, WRITE_1H, HIT, BATCH, REGIONAL, SEARCH = 1.25, 2.0, 0.1, 0.5, 1.1, 0.01
MAX_RATES = 100_000  #: rows of a rate table, which is broadcast


def one_model(model: Column, aliases: dict[str, str]) -> Column:
    """A model's name without window suffix and date, aliases resolved."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(model), r"\[[^\]]*\]$", ""), r"-20[0-9]{6}$", "")
    if not aliases:
        return bare
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, bare), bare)


def priced(turns: DataFrame, rates: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """The turns with ``canonical`` model and ``cost``; columns as in the lines table."""
    if rates.limit(MAX_RATES + 1).count() > MAX_RATES:
        raise ValueError(f"a rate table has at most {MAX_RATES} rows")
    turns = turns.withColumn("canonical", one_model(F.col("model"), aliases or {}))
    day = F.to_date(F.timestamp_millis("ts_ms"))
    r = rates.select([F.col(c).alias(f"r_{c}") for c in ("model", "valid_from", "valid_to", "input", "output", "fast_input", "fast_output")])
    valid = (F.col("canonical") == F.col("r_model")) & (day >= F.col("r_valid_from")) & (F.col("r_valid_to").isNull() | (day < F.col("r_valid_to")))
    met = turns.join(F.broadcast(r), valid & (F.col("model") != "<synthetic>"), "left")  # at most MAX_RATES rows
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    fast = (F.coalesce("speed", F.lit("")) == "fast") & F.col("r_fast_input").isNotNull()
    rate_in, rate_out = F.when(fast, F.col("r_fast_input")).otherwise(F.col("r_input")), F.when(fast, F.col("r_fast_output")).otherwise(F.col("r_output"))
    batch = F.when(F.col("service_tier") == "batch", BATCH).otherwise(1.0)
    short = F.when(F.col("k_cache_creation") == "dict", n("write_5m")).otherwise(n("cache_creation_tokens"))
    long = F.when(F.col("k_cache_creation") == "dict", n("write_1h")).otherwise(0)
    tokens = n("input_tokens") * rate_in * batch + n("output_tokens") * rate_out * batch + rate_in * (n("cache_read_tokens") * HIT + short * WRITE_5M + long * WRITE_1H)
    regional = F.when(F.col("inference_geo") == "us", REGIONAL).otherwise(1.0)
    cost = F.when(F.col("r_model").isNotNull(), tokens / 1_000_000.0 * regional + n("searches") * SEARCH)
    return met.withColumn("cost", cost).drop(*r.columns)


def cost_by(turns: DataFrame, *by: Column | str) -> DataFrame:
    """Turns, unpriced turns and cost of priced turns by the given columns."""
    real = turns.where("coalesce(model, '') <> '<synthetic>'")
    return real.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.round(F.sum("cost"), 6).alias("cost"))


def origin() -> list[Column]:
    """What launched a turn: kind and name, the main loop where nothing did."""
    server = F.concat_ws("/", "attribution_server", "attribution_tool")
    kind = F.when(F.col("attribution_agent").isNotNull(), "agent").when(F.col("attribution_server").isNotNull(), "mcp").when(F.col("attribution_skill").isNotNull(), "skill").otherwise("main")
    name = F.coalesce("attribution_agent", F.when(F.col("attribution_server").isNotNull(), server), "attribution_skill", F.lit("(main loop)"))
    return [kind.alias("origin"), name.alias("name")]


def rollups(lines: DataFrame) -> DataFrame:
    """Rollups of agent calls that parent lines hold, a snapshot of the last turn."""
    four = ("e_input", "e_output", "e_creation", "e_read")
    total = sum((F.coalesce(c, F.lit(0)) for c in four[1:]), F.coalesce(four[0], F.lit(0)))
    held = lines.where("type = 'user' and e_agent_id is not null and e_total_tokens is not null")
    return held.select("line_id", F.col("e_agent_id").alias("agent_id"), F.col("e_total_tokens").alias("total_tokens"), *four, "e_duration_ms", "e_tool_uses", (total == F.col("e_total_tokens")).alias("adds_up"))


def against_traces(rolled: DataFrame, turns: DataFrame) -> DataFrame:
    """(agent_id, total_tokens, trace_tokens, ratio, coverage), rollups beside the
    reduced turns of the agents' traces; either side may be missing."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    spent = n("input_tokens") + n("output_tokens") + n("cache_creation_tokens") + n("cache_read_tokens")
    traces = turns.where("container = 'subagent-trace' and agent_id is not null").groupBy("agent_id").agg(F.sum(spent).alias("trace_tokens"))
    last = rolled.groupBy("agent_id").agg(F.max_by("total_tokens", "line_id").alias("total_tokens"))
    met = last.join(traces, "agent_id", "full")
    cover = F.when(F.col("total_tokens").isNull(), "trace only").when(F.col("trace_tokens").isNull(), "rollup only").otherwise("both")
    return met.select("agent_id", "total_tokens", "trace_tokens", F.try_divide("trace_tokens", "total_tokens").alias("ratio"), cover.alias("coverage"))
