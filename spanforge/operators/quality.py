"""Checks of transcripts. Entries: session_id, line_no, raw; messages and blocks as sources.transcripts gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Entry types without a message, and block types.
META_TYPES = ("attachment", "file-history-snapshot", "last-prompt", "permission-mode", "progress", "queue-operation", "summary", "system")
BLOCK_TYPES = ("text", "tool_use", "tool_result", "thinking")


def _block_faults(content: Column) -> tuple[Column, Column]:
    """Errors and warnings of content blocks, an array of variants."""
    get = lambda b, key: F.try_variant_get(b, f"$.{key}", "variant")
    shape = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    says = lambda i, text: F.concat(F.lit("content["), i.cast("string"), F.lit(f"] {text}"))

    def errors(b: Column, i: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        is_object = shape(b).startswith("OBJECT")
        lacks = lambda of, key: F.when((kind == of) & get(b, key).isNull(), says(i, f"lacks {key}"))
        not_text = F.when((kind == "text") & get(b, "text").isNotNull() & (shape(get(b, "text")) != "STRING"), says(i, "has a text that is no string"))
        found = F.array(F.when(kind.isNull(), says(i, "lacks type")), lacks("text", "text"), not_text, lacks("tool_use", "name"), lacks("tool_use", "id"), lacks("tool_result", "tool_use_id"))
        return F.when(is_object, F.array_compact(found)).otherwise(F.array().cast("array<string>"))

    def warnings(b: Column, i: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        is_object = shape(b).startswith("OBJECT")
        thin = (kind == "thinking") & get(b, "thinking").isNull() & get(b, "text").isNull()
        return F.when(~is_object, says(i, "is no object")).when(kind.isNotNull() & ~kind.isin(*BLOCK_TYPES), says(i, "has an unknown type")).when(thin, says(i, "lacks thinking"))

    none = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(content, errors)), none), F.coalesce(F.array_compact(F.transform(content, warnings)), none)


def lines(entries: DataFrame) -> DataFrame:
    """Each line's errors and warnings; empty lines are valid with a warning, entries of meta types are not looked into."""
    raw, v = F.col("raw"), F.try_parse_json(F.col("raw"))
    at = lambda path: F.try_variant_get(v, path, "string")
    there = lambda path: F.try_variant_get(v, path, "variant")
    shape = lambda path: F.coalesce(F.schema_of_variant(there(path)), F.lit(""))
    kind, empty = at("$.type"), F.trim(raw) == ""
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    meta = F.coalesce(kind.isin(*META_TYPES), F.lit(False))
    plain = ~empty & is_object & ~meta
    message = plain & shape("$.message").startswith("OBJECT")
    errors = [F.when(~empty & v.isNull(), "invalid JSON"), F.when(~empty & v.isNotNull() & ~is_object, "no JSON object")]
    errors += [F.when(plain & there(f"$.{f}").isNull(), f"missing {f}") for f in ("type", "uuid", "sessionId", "message")]
    errors += [F.when(plain & there("$.message").isNotNull() & ~message & (shape("$.message") != "VOID"), "message is no object")]
    errors += [F.when(message & there(f"$.message.{f}").isNull(), f"missing message.{f}") for f in ("role", "content")]
    content = shape("$.message.content")
    errors += [F.when(message & there("$.message.content").isNotNull() & ~content.startswith("ARRAY") & ~content.isin("STRING", "VOID"), "content is neither a string nor a list")]
    warnings = [F.when(empty, "empty line"), F.when(plain & at("$.timestamp").isNotNull() & F.try_to_timestamp(at("$.timestamp")).isNull(), "bad timestamp")]
    warnings += [F.when(message & at("$.message.role").isNotNull() & ~at("$.message.role").isin("user", "assistant"), "unexpected role")]
    blocks = F.when(message & content.startswith("ARRAY"), F.try_variant_get(v, "$.message.content", "array<variant>"))
    more_errors, more_warnings = _block_faults(blocks)
    out = entries.select("session_id", "line_no", F.concat(F.array_compact(F.array(*errors)), more_errors).alias("errors"), F.concat(F.array_compact(F.array(*warnings)), more_warnings).alias("warnings"))
    return out.withColumn("valid", F.size("errors") == 0)


def files(checked: DataFrame) -> DataFrame:
    return checked.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("valid").alias("valid_lines"), F.sum(F.size("errors")).alias("errors"), F.sum(F.size("warnings")).alias("warnings"))


def orphans(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Results without a call (errors), calls without a result (warnings). Both: session_id, tool_use_id."""
    keys = ["session_id", "tool_use_id"]
    u, r = uses.select(keys).distinct(), results.select(keys).distinct()
    return r.join(u, keys, "left_anti").withColumn("kind", F.lit("unmatched_result")).unionByName(u.join(r, keys, "left_anti").withColumn("kind", F.lit("unresolved_call")))


def inversions(messages: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The first message of each session that is older than the one before it."""
    seen = messages.where(F.col(ts).isNotNull()).withColumn("before", F.lag(ts).over(W.partitionBy("session_id").orderBy("position")))
    return seen.where(F.col("before") > F.col(ts)).groupBy("session_id").agg(F.min("position").alias("position"))


def sessions(messages: DataFrame, uses: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, messages, errors, warnings, valid): both roles present, times in order, no negative usage, each result
    with its call (errors), each call with its result (warnings).

    messages: session_id, position, role, timestamp and four token counts; uses and results: session_id, tool_use_id."""
    counts = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    has = lambda role: F.max(F.col("role") == role)
    negative = F.count_if(F.least(*(F.coalesce(c, F.lit(0)) for c in counts)) < 0)
    own = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), has("user").alias("user"), has("assistant").alias("assistant"), negative.alias("negative"))
    loose = orphans(uses, results).groupBy("session_id").agg(F.count_if(F.col("kind") == "unmatched_result").alias("unmatched"), F.count_if(F.col("kind") == "unresolved_call").alias("unresolved"))
    late = inversions(messages).select("session_id", F.col("position").alias("late"))
    out = own.join(loose, "session_id", "left").join(late, "session_id", "left")
    errors = F.array_compact(F.array(F.when(~F.col("user"), "no user message"), F.when(~F.col("assistant"), "no assistant message"), F.when(F.col("late").isNotNull(), F.concat(F.lit("time goes back at message "), F.col("late").cast("string"))), F.when(F.col("negative") > 0, "negative token count"), F.when(F.col("unmatched") > 0, "result without a call")))
    warnings = F.array_compact(F.array(F.when(F.col("unresolved") > 0, "call without a result")))
    return out.select("session_id", "messages", errors.alias("errors"), warnings.alias("warnings")).withColumn("valid", F.size("errors") == 0)


def health_report(messages: DataFrame, blocks: DataFrame) -> DataFrame:
    """By session: messages by role, blocks by type, estimated tokens by phase, and all tokens: the billed ones, where there
    are any, else the estimates.

    messages: session_id, role and four token counts; blocks: session_id, block_type, text."""
    counts = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    own = messages.groupBy("session_id").agg(*(F.count_if(F.col("role") == r).alias(f"{r}_messages") for r in ("user", "assistant")), F.sum(sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))).alias("billed"))
    kind, text = F.col("block_type"), F.coalesce("text", F.lit(""))
    n = F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / 4.0))).cast("long")
    of = lambda *kinds: F.sum(F.when(kind.isin(*kinds), n).otherwise(0))
    found = [F.count_if(kind == t).alias(f"{t}_blocks") for t in BLOCK_TYPES] + [F.count_if(~kind.isin(*BLOCK_TYPES)).alias("other_blocks")]
    inside = blocks.groupBy("session_id").agg(*found, of("thinking").alias("reasoning_tokens"), of("tool_use", "tool_result").alias("tool_use_tokens"), of("text").alias("generation_tokens"), F.round(F.count(F.lit(1)) * 0.0005, 4).alias("seconds"))
    out = own.join(inside, "session_id", "left").fillna(0)
    estimated = F.col("reasoning_tokens") + F.col("tool_use_tokens") + F.col("generation_tokens")
    return out.withColumn("tokens", F.when(F.col("billed") > 0, F.col("billed")).otherwise(estimated)).drop("billed")


def health(blocks: DataFrame) -> DataFrame:
    """Block counts and shares, tokens, and the expected time of analysis."""
    n = F.count(F.lit(1))
    known = [F.count_if(F.col("block_type") == t).alias(f"{t}_blocks") for t in BLOCK_TYPES]
    tokens = F.sum(F.when(F.length(F.coalesce("text", F.lit(""))) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length("text") / 4.0)))).cast("long")
    out = blocks.groupBy("session_id").agg(n.alias("blocks"), *known, tokens.alias("tokens"), F.round(n * 0.0005, 4).alias("seconds"))
    return out.withColumn("text_percent", F.round(F.col("text_blocks") * 100 / F.col("blocks"), 2))


def completeness(messages: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """1, less what is missing: no assistant, an unfinished last answer, unresolved calls, an end in a call.

    messages: session_id, position, role, stop_reason, last_block; unresolved: session_id, share.
    """
    last = F.max_by(F.struct("stop_reason", "last_block"), F.when(F.col("role") == "assistant", F.col("position")))
    out = messages.groupBy("session_id").agg(F.count_if(F.col("role") == "assistant").alias("n"), last.alias("last"))
    out = out.withColumn("share", F.lit(0.0)) if unresolved is None else out.join(unresolved, "session_id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    none = F.col("n") == 0
    score = 1 - F.when(none, 0.5).otherwise(F.when(F.coalesce(F.col("last.stop_reason"), F.lit("")) != "end_turn", 0.3).otherwise(0.0)) - 0.2 * F.col("share") - F.when(~none & (F.col("last.last_block") == "tool_use"), 0.2).otherwise(0.0)
    return out.select("session_id", F.round(F.greatest(F.lit(0.0), score), 4).alias("completeness"))
