"""Waste patterns.

Calls: session_id, position, tool, and, as a detector needs them, signature, file, command, text, token_count. All
detectors return session_id, pattern_type, start_position, end_position, spans_involved, tokens_wasted, detail.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import similar
from spanforge.operators.spans import islands

COLUMNS = ("session_id", "pattern_type", "start_position", "end_position", "spans_involved", "tokens_wasted", "detail")


def _order(*more: str) -> W:
    return W.partitionBy("session_id", *more).orderBy("position")


def _as(df: DataFrame, kind: str, start: Column, end: Column, spans: Column, tokens: Column, detail: Column) -> DataFrame:
    return df.select("session_id", F.lit(kind).alias("pattern_type"), start.cast("long").alias("start_position"), end.cast("long").alias("end_position"), spans.cast("long").alias("spans_involved"), tokens.cast("long").alias("tokens_wasted"), detail.cast("string").alias("detail"))


def _runs(df: DataFrame, kind: str, least: int, tokens: Column, detail: Column, positioned: bool = True) -> DataFrame:
    """df: island, position, token_count; runs of at least so many rows."""
    at = (F.min("position"), F.max("position")) if positioned else (F.lit(0), F.lit(0))
    runs = df.groupBy("session_id", "island").agg(at[0].alias("s"), at[1].alias("e"), F.count(F.lit(1)).alias("n"), tokens.alias("t"), detail.alias("d")).where(F.col("n") >= least)
    return _as(runs, kind, F.col("s"), F.col("e"), F.col("n"), F.col("t"), F.col("d"))


def _rest() -> Column:
    """All tokens but the first row's."""
    return F.sum("token_count") - F.min_by("token_count", "position")


def reasoning_loops(labelled: DataFrame, least: int = 3) -> DataFrame:
    """At least three adjacent redundant reasoning spans; any other span breaks a run."""
    here = (F.col("phase") == "reasoning") & (F.col("label") == "redundant_reasoning")
    marked = islands(labelled.withColumn("here", here), ~F.col("here"))
    return _runs(marked.where("here"), "reasoning_loop", least, F.sum("token_count"), F.lit(None))


def duplicate_calls(calls: DataFrame, window: int = 5) -> DataFrame:
    """A call whose signature one of the previous calls had; the first time for each signature."""
    near = F.collect_list(F.struct("signature", "position")).over(_order().rowsBetween(-window, -1))
    first = F.array_min(F.transform(F.filter(near, lambda x: x["signature"] == F.col("signature")), lambda x: x["position"]))
    found = calls.withColumn("first", first).where("first IS NOT NULL")
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("session_id", "signature").orderBy("position"))).where("nth = 1")
    return _as(found, "duplicate_tool_call", F.col("first"), F.col("position"), F.lit(2), F.col("token_count"), F.col("signature"))


def restatements(spans: DataFrame, threshold: float = 0.85) -> DataFrame:
    """A generation span that is like an earlier one; the earliest counts."""
    own = spans.where("phase = 'generation'")
    found = similar.first_alike(own, threshold).join(own.select("session_id", "position", "token_count"), ["session_id", "position"])
    return _as(found, "context_restatement", F.col("position"), F.col("position"), F.lit(1), F.col("token_count"), F.col("prior"))


def repeated(calls: DataFrame, kind: str, key: str, least: int = 3) -> DataFrame:
    """Reads of one file, or runs of one command: all but the first are waste."""
    found = calls.where(F.col(key).isNotNull()).groupBy("session_id", key).agg(F.count(F.lit(1)).alias("n"), _rest().alias("t")).where(F.col("n") >= least)
    return _as(found, kind, F.lit(0), F.lit(0), F.col("n"), F.col("t"), F.col(key))


def edit_fragmentation(edits: DataFrame, least: int = 3) -> DataFrame:
    """Consecutive edits of one file in the sequence of edits."""
    runs = islands(edits.withColumn("before", F.lag("file").over(_order())), F.col("before").isNull() | (F.col("before") != F.col("file")))
    return _runs(runs, "edit_fragmentation", least, _rest(), F.first("file"), positioned=False)


def shell_antipatterns(calls: DataFrame) -> DataFrame:
    """Shell calls for which there is a dedicated tool; one row a session. A result counts one token at least."""
    found = calls.withColumn("better", T.shell_tool(F.col("command"))).where("better IS NOT NULL")
    by = found.groupBy("session_id", "better").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("token_count"), F.lit(1))).alias("t"))
    out = by.groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "better", "n")))).alias("d"))
    return _as(out, "bash_antipattern", F.lit(0), F.lit(0), F.col("n"), F.col("t"), F.col("d"))


def failed_results(results: DataFrame) -> DataFrame:
    """Error results, each call once (its last result); one row a session. results: tool_use_id, text, token_count."""
    bad = results.where(T.is_error(F.col("text"))).groupBy("session_id", "tool_use_id").agg(F.max_by("token_count", "position").alias("t"))
    out = bad.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    return _as(out, "failed_tool_retry", F.lit(0), F.lit(0), F.col("n"), F.col("t"), F.lit(None))


def _chains(spans: DataFrame, kind: str, trouble: Column, least: int, alike: Column | None) -> DataFrame:
    """Calls of one tool, each after trouble in between, and, where asked for, alike."""
    seen = spans.withColumn("trouble", F.sum(F.when((F.col("block_type") == "tool_result") & trouble, 1).otherwise(0)).over(_order().rowsBetween(W.unboundedPreceding, 0)))
    calls = seen.where("block_type = 'tool_use'")
    for c in ("tool", "trouble", "parameters"):
        calls = calls.withColumn(f"{c}_0", F.lag(c).over(_order()))
    link = (F.col("tool_0") == F.col("tool")) & (F.col("trouble") > F.col("trouble_0"))
    link = link if alike is None else link & alike
    runs = islands(calls, ~F.coalesce(link, F.lit(False)))
    chains = runs.groupBy("session_id", "island").agg(F.min("position").alias("s"), F.max("position").alias("e"), F.count(F.lit(1)).alias("n"), _rest().alias("t"), F.first("tool").alias("d")).where(F.col("n") >= least + 1)
    return _as(chains, kind, F.col("s"), F.col("e"), F.col("n"), F.col("t"), F.col("d"))


def permission_loops(spans: DataFrame, least: int = 2) -> DataFrame:
    return _chains(spans, "permission_loop", T.contains_any(F.col("text"), T.PERMISSION_WORDS), least, None)


def error_spirals(spans: DataFrame, least: int = 3, similarity: float = 0.9) -> DataFrame:
    return _chains(spans, "error_retry_spiral", T.contains_any(F.col("text"), T.ERROR_WORDS), least, T.trigram_cosine(F.col("parameters"), F.col("parameters_0")) >= similarity)


def over_reading(operations: DataFrame, least: int = 2) -> DataFrame:
    """Reads of a file since its last write, more than least. operations: file, is_write, is_read."""
    epoch = F.sum(F.when(F.col("is_write"), 1).otherwise(0)).over(_order("file").rowsBetween(W.unboundedPreceding, 0))
    numbered = operations.withColumn("epoch", epoch).withColumn("last", F.max("epoch").over(W.partitionBy("session_id", "file")))
    runs = numbered.where("is_read AND epoch = last").groupBy("session_id", "file").agg(F.min("position").alias("s"), F.max("position").alias("e"), F.count(F.lit(1)).alias("n"), _rest().alias("t")).where(F.col("n") >= least + 1)
    return _as(runs, "over_reading", F.col("s"), F.col("e"), F.col("n"), F.col("t"), F.col("file"))


def abandoned(operations: DataFrame) -> DataFrame:
    """Files whose last operation is a write while the session goes on with others."""
    last = F.max("position").over(W.partitionBy("session_id"))
    files = operations.withColumn("session_last", last).groupBy("session_id", "file").agg(F.min("position").alias("s"), F.max("position").alias("e"), F.max("session_last").alias("last"), F.max_by("is_write", "position").alias("ends_in_write"), F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"))
    found = files.where("ends_in_write AND last > e")
    return _as(found, "abandoned_approach", F.col("s"), F.col("e"), F.col("n"), F.col("t"), F.col("file"))


def verbose_thinking(spans: DataFrame, least: int = 500, ratio: float = 10.0) -> DataFrame:
    """Long reasoning before a short action, or before none."""
    # Read backwards, the next action is the last one seen: a running value, not a frame that is searched for every row.
    backwards = W.partitionBy("session_id").orderBy(F.desc("position")).rowsBetween(W.unboundedPreceding, -1)
    action = F.last(F.when(F.col("phase") != "reasoning", F.struct("position", "token_count")), ignorenulls=True).over(backwards)
    found = spans.withColumn("action", action).where(F.col("phase") == "reasoning").where(F.col("token_count") >= least)
    a = F.greatest(F.col("action.token_count"), F.lit(1))
    found = found.where(F.col("action").isNull() | (F.col("token_count") / a > ratio))
    waste = F.when(F.col("action").isNull(), F.col("token_count")).otherwise(F.col("token_count") - F.floor(ratio * a))
    return _as(found, "verbose_thinking", F.col("position"), F.coalesce("action.position", "position"), F.when(F.col("action").isNull(), 1).otherwise(2), waste, F.when(F.col("action").isNull(), "inf").otherwise(F.round(F.col("token_count") / a, 2).cast("string")))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def waste_by(labelled: DataFrame) -> DataFrame:
    """(session_id, dimension, name, tokens): wasted tokens by category (the label) and by phase."""
    each = F.explode(F.array(F.struct(F.lit("category").alias("dimension"), F.col("label").alias("name")), F.struct(F.lit("phase").alias("dimension"), F.col("phase").alias("name"))))
    return labelled.where("NOT aligned").select("session_id", "token_count", each.alias("x")).groupBy("session_id", "x.dimension", "x.name").agg(F.sum("token_count").alias("tokens"))


def explanations(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, total_tokens, waste_tokens, category, pattern, explanation): the largest category (of equal ones the
    first by name), the dearest pattern, and both in words."""
    totals = labelled.groupBy("session_id").agg(F.sum("token_count").alias("total_tokens"), F.sum(F.when(~F.col("aligned"), F.col("token_count")).otherwise(0)).alias("waste_tokens"))
    category = waste_by(labelled).where("dimension = 'category'").groupBy("session_id").agg(F.min(F.struct((-F.col("tokens")).alias("t"), "name")).alias("c")).select("session_id", F.col("c.name").alias("category"), (-F.col("c.t")).alias("category_tokens"))
    dearest = top(found, 1).select("session_id", F.col("pattern_type").alias("pattern"), F.col("tokens_wasted").alias("pattern_tokens"))
    out = totals.join(category, "session_id", "left").join(dearest, "session_id", "left")
    # format_number() rounds what a double is exactly, so 32.45 by its error in binary; as decimals halves go to even.
    share = F.format_number(F.bround(F.col("waste_tokens") * 100 / F.greatest(F.col("total_tokens"), F.lit(1)), 1), 1)
    n = lambda c: F.format_number(F.col(c), 0)
    text = F.concat_ws(" ", F.concat(n("waste_tokens"), F.lit(" of "), n("total_tokens"), F.lit(" tokens ("), share, F.lit(" %) are waste.")), F.concat(F.lit("Most of it is "), F.translate("category", "_", " "), F.lit(" ("), n("category_tokens"), F.lit(").")), F.concat(F.lit("The dearest pattern is "), F.translate("pattern", "_", " "), F.lit(" ("), n("pattern_tokens"), F.lit(").")))
    text = F.when(F.col("total_tokens") == 0, "There are no tokens.").when(F.col("waste_tokens") == 0, "No token is waste.").otherwise(text)
    return out.select("session_id", "total_tokens", "waste_tokens", "category", "pattern", text.alias("explanation"))


def top(found: DataFrame, k: int = 5) -> DataFrame:
    """Each session's patterns that waste most."""
    order = W.partitionBy("session_id").orderBy(F.desc("tokens_wasted"), "pattern_type", "start_position", "detail")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
