"""Span labels, token efficiency, and merging. Spans: session_id, position, phase, text, token_count, and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions import vectors as V

PHASES = ("reasoning", "tool_use", "generation")
#: A phase's weight in the total, and the similarity and window of a repetition.
PHASE_WEIGHTS = {"reasoning": 0.3, "tool_use": 0.4, "generation": 0.3}
REPETITION, REPETITION_WINDOW = 0.88, 10
ALIGNED = ("aligned_reasoning", "aligned_tool_use", "aligned_generation")


def label(spans: DataFrame, measured: DataFrame, threshold: float = 0.4, confidence: float = 0.75) -> DataFrame:
    """spans with similarity, label and confidence. measured: session_id, position, similarity, repetition."""
    s, r, n = F.coalesce("similarity", F.lit(0.0)), F.coalesce("repetition", F.lit(0.0)), T.n_words(F.col("text"))
    again = (r >= REPETITION) & (r >= confidence)
    held = (r >= REPETITION) & (r < confidence)
    filler, verbose = T.filler_bound(threshold), T.verbose_bound(threshold)
    waste = F.when(F.col("phase") == "reasoning", "redundant_reasoning").when(F.col("phase") == "tool_use", "unnecessary_tool_call").otherwise("over_explanation")
    aligned = F.concat(F.lit("aligned_"), F.col("phase"))
    idle = (F.col("phase") == "reasoning") & (s < filler) & (n < 15)
    wordy = (F.col("phase") == "generation") & (s < verbose) & (n > 50)
    given = F.when(again, waste).when(held, aligned).when(idle | wordy, waste).otherwise(aligned)
    sure = F.when(again | held, r).when(idle, 0.5).when(wordy, 0.4).when(F.col("phase") == "tool_use", F.greatest(F.lit(0.6), s)).otherwise(F.greatest(F.lit(0.5), s))
    keys = ["session_id", "position"]
    return spans.join(measured, keys, "left").select(*spans.columns, s.alias("similarity"), given.alias("label"), sure.alias("confidence"), given.startswith("aligned_").alias("aligned"))


def ter(labelled: DataFrame, by: list[str] | None = None, weights: dict[str, float] = PHASE_WEIGHTS) -> DataFrame:
    """Token efficiency: each phase's aligned share (1 without tokens), their weighted sum, raw ratio and counts."""
    by = by or ["session_id"]
    sums = [F.sum(F.when(F.col("phase") == p, F.col("token_count")).otherwise(0)).alias(f"{p}_tokens") for p in PHASES]
    sums += [F.sum(F.when((F.col("phase") == p) & F.col("aligned"), F.col("token_count")).otherwise(0)).alias(f"{p}_aligned") for p in PHASES]
    out = labelled.groupBy(*by).agg(*sums, F.sum("token_count").alias("total_tokens"), F.sum(F.when(F.col("aligned"), F.col("token_count")).otherwise(0)).alias("aligned_tokens"))
    share = lambda a, n: F.round(F.when(n == 0, 1.0).otherwise(a / F.when(n == 0, 1).otherwise(n)), 4)
    for p in PHASES:
        out = out.withColumn(f"{p}_score", share(F.col(f"{p}_aligned"), F.col(f"{p}_tokens")))
    total = sum((F.col(f"{p}_score") * weights[p] for p in PHASES), F.lit(0.0))
    out = out.withColumn("aggregate_ter", F.round(F.round(total, 9), 4)).withColumn("raw_ratio", share(F.col("aligned_tokens"), F.col("total_tokens")))
    return out.select(*by, "aggregate_ter", "raw_ratio", *(f"{p}_score" for p in PHASES), "total_tokens", "aligned_tokens", (F.col("total_tokens") - F.col("aligned_tokens")).alias("waste_tokens"))


def thirds(labelled: DataFrame) -> DataFrame:
    """Aligned share of each session's first, middle and last third; a third holds max(1, n div 3) spans, the last the rest."""
    order = W.partitionBy("session_id").orderBy("position")
    n = F.count(F.lit(1)).over(W.partitionBy("session_id"))
    third = F.least(F.floor((F.row_number().over(order) - 1) / F.greatest(F.lit(1), F.floor(n / 3))), F.lit(2))
    part = labelled.withColumn("third", third)

    def share(k: int) -> Column:
        all_ = F.sum(F.when(F.col("third") == k, F.col("token_count")).otherwise(0))
        good = F.sum(F.when((F.col("third") == k) & F.col("aligned"), F.col("token_count")).otherwise(0))
        return F.round(F.when(all_ == 0, 1.0).otherwise(good / F.when(all_ == 0, 1).otherwise(all_)), 4)

    return part.groupBy("session_id").agg(share(0).alias("early_ter"), share(1).alias("mid_ter"), share(2).alias("late_ter"))


def islands(df: DataFrame, change: Column, name: str = "island") -> DataFrame:
    """df with a running number that grows where change holds."""
    order = W.partitionBy("session_id").orderBy("position")
    return df.withColumn(name, F.sum(F.when(change, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))


def merge_adjacent(spans: DataFrame) -> DataFrame:
    """Runs of one phase as one span each: its first position, count, tokens, joined text."""
    order = W.partitionBy("session_id").orderBy("position")
    runs = islands(spans.withColumn("before", F.lag("phase").over(order)), F.col("before").isNull() | (F.col("before") != F.col("phase")))
    texts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return runs.groupBy("session_id", "island", "phase").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n_spans"), F.sum("token_count").alias("token_count"), F.concat_ws(" ", F.transform(texts, lambda t: t["text"])).alias("text")).drop("island")


def short_spans(spans: DataFrame, least: int = 10) -> DataFrame:
    """Spans too short to embed, as they are reported."""
    return spans.where(F.col("token_count") < least).select("session_id", "position", F.lit("low_signal").alias("label"), F.lit(0.1).alias("confidence"))


def uncached(spans: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose content hash isn't in the cache: what is left to embed."""
    return spans.select(T.content_hash(F.col("text")).alias("content_hash"), "text").dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")


def dense_repetition(vectors: DataFrame, threshold: float, window: int = REPETITION_WINDOW) -> DataFrame:
    """Dense vectors (session_id, position, phase, embedding): the best match among the phase's previous ones."""
    before = W.partitionBy("session_id", "phase").orderBy("position").rowsBetween(-window, -1)
    near = F.collect_list("embedding").over(before)
    best = F.coalesce(F.array_max(F.transform(near, lambda v: V.cosine(v, F.col("embedding")))), F.lit(0.0))
    return vectors.withColumn("repetition", F.round(best, 6)).select("session_id", "position", "phase", "repetition", (F.col("repetition") >= threshold).alias("repeats"))


def group_ter(results: DataFrame, by: str) -> DataFrame:
    """A parent session and its agents as one: token-weighted efficiency."""
    n = F.sum("total_tokens")
    return results.groupBy(by).agg(F.round(F.when(n == 0, 1.0).otherwise(F.sum(F.col("aggregate_ter") * F.col("total_tokens")) / F.when(n == 0, 1).otherwise(n)), 4).alias("group_ter"), n.alias("total_tokens"), F.sum("waste_tokens").alias("waste_tokens"), F.round(F.when(n == 0, 0.0).otherwise(F.sum("waste_tokens") * 100 / F.when(n == 0, 1).otherwise(n)), 1).alias("waste_percent"), F.count(F.lit(1)).alias("sessions"))
