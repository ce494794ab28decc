"""Trends, tags, thresholds, hints, comparisons. Results: project, session_id, ts, aggregate_ter, tokens, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What is suggested for a pattern or a weak phase, and how much it may help.
PATTERN_HINTS = (
    ("reasoning_loop", "reasoning", "Ask for short reasoning that goes over no ground twice", "high"),
    ("duplicate_tool_call", "tool_use", "Say which results are expected, so that calls need no repeating", "medium"),
    ("context_restatement", "generation", "Ask that known context is not told again", "medium"),
)
PHASE_HINTS = (
    ("reasoning", "State requirements more precisely, to keep reasoning to the point", "medium"),
    ("tool_use", "Name the files and tools that are needed at the start", "high"),
    ("generation", "Ask for a brief form of answer, such as a list", "low"),
)


def trend(results: DataFrame, change: float = 0.02) -> DataFrame:
    """By project: average, least and most efficiency, tokens, and whether the later half is better than the earlier."""
    order = W.partitionBy("project").orderBy("ts", "session_id")
    half = results.withColumn("nth", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("project")))
    early, late = F.col("nth") < F.floor(F.col("n") / 2), F.col("nth") >= F.floor(F.col("n") / 2)
    t = F.col("aggregate_ter")
    out = half.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg(t), 4).alias("avg_ter"), F.round(F.min(t), 4).alias("min_ter"), F.round(F.max(t), 4).alias("max_ter"), F.sum("total_tokens").alias("total_tokens"), F.sum("waste_tokens").alias("waste_tokens"), F.avg(F.when(early, t)).alias("a"), F.avg(F.when(late, t)).alias("b"))
    d = F.round(F.col("b") - F.col("a"), 9)
    return out.withColumn("direction", F.when(F.col("a").isNull(), "stable").when(d > change, "improving").when(d < -change, "degrading").otherwise("stable")).drop("a", "b")


def latest(results: DataFrame, most: int = 20) -> DataFrame:
    """A project's last results, the newest first."""
    order = W.partitionBy("project").orderBy(F.desc("ts"), F.desc("session_id"))
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def tag_stats(results: DataFrame) -> DataFrame:
    each = results.select("aggregate_ter", "total_tokens", "waste_tokens", F.explode("tags").alias("tag"))
    n = F.sum("total_tokens")
    return each.groupBy("tag").agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("aggregate_ter"), 4).alias("avg_ter"), F.round(F.avg("total_tokens"), 2).alias("avg_tokens"), F.round(F.when(n == 0, 0.0).otherwise(F.sum("waste_tokens") / F.when(n == 0, 1).otherwise(n)), 4).alias("waste_ratio"))


def add_tags(results: DataFrame, session_id: str, tags: list[str]) -> DataFrame:
    """All rows of the session get the tags, sorted, once each. An unknown session is an error: one more look at the table."""
    if not results.where(F.col("session_id") == session_id).limit(1).count():
        raise ValueError(f"no session {session_id!r}")
    new = F.array_sort(F.array_union("tags", F.array(*map(F.lit, tags))))
    return results.withColumn("tags", F.when(F.col("session_id") == session_id, new).otherwise(F.col("tags")))


def check(results: DataFrame, least: float, phase_least: float | None = None) -> DataFrame:
    """Whether the total and every phase reach their thresholds, and which don't."""
    p = least if phase_least is None else phase_least
    names = (("aggregate", "aggregate_ter", least), *((n, f"{n}_score", p) for n in ("reasoning", "tool_use", "generation")))
    failed = F.array_compact(F.array(*(F.when(F.col(c) < t, n) for n, c, t in names)))
    return results.select("session_id", "aggregate_ter", (F.size(failed) == 0).alias("passed"), F.concat_ws(",", failed).alias("failed"))


def hints(results: DataFrame, found: DataFrame, low: float = 0.6) -> DataFrame:
    """A hint for each kind of pattern found and each weak phase; the ones of high impact first."""
    spark = results.sparkSession
    known = spark.createDataFrame(PATTERN_HINTS, "pattern_type string, category string, suggestion string, impact string")
    of_patterns = found.select("session_id", "pattern_type").distinct().join(F.broadcast(known), "pattern_type").select("session_id", "category", "suggestion", "impact", "pattern_type")
    weak = F.array_compact(F.array(*(F.when(F.col(f"{p}_score") < low, F.struct(F.lit(p).alias("category"), F.lit(s).alias("suggestion"), F.lit(i).alias("impact"))) for p, s, i in PHASE_HINTS)))
    of_phases = results.select("session_id", F.explode(weak).alias("h")).select("session_id", "h.category", "h.suggestion", "h.impact", F.lit(None).cast("string").alias("pattern_type"))
    out = of_patterns.unionByName(of_phases)
    rank = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    order = W.partitionBy("session_id").orderBy(rank, F.col("pattern_type").isNull(), "pattern_type", "category")
    return out.withColumn("rank", F.row_number().over(order))


def compare(results: DataFrame, by: str = "ter") -> DataFrame:
    """Sessions side by side: efficiency falling, tokens or waste rising; ties by id."""
    key = {"ter": F.desc("aggregate_ter"), "tokens": F.asc("total_tokens"), "waste": F.asc("waste_tokens")}[by]
    return results.orderBy(key, "session_id")


def comparison_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("aggregate_ter"), 4).alias("average_ter"), F.sum("total_tokens").alias("total_tokens"), F.sum("waste_tokens").alias("waste_tokens"))


def baseline_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Two runs of the same keys: after less before, measure by measure."""
    names = ("aggregate_ter", "raw_ratio", "total_tokens", "waste_tokens")
    b = before.select(key, *(F.col(n).alias(f"{n}_0") for n in names))
    joined = after.select(key, *names).join(b, key)
    return joined.select(key, *(F.round(F.col(n) - F.col(f"{n}_0"), 4).alias(f"{n}_delta") for n in names))
