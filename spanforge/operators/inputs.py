"""Prompts and responses. Prompts: session_id, prompt_index, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators import similar


def token_breakdown(blocks: DataFrame) -> DataFrame:
    """Tokens by origin over raw block text (0 where there is none). blocks: role, block_type, text."""
    n = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    user, model, kind = F.col("role") == "user", F.col("role") == "assistant", F.col("block_type")
    sums = {
        "user_prompt": user & (kind == "text"),
        "user_tool_result": user & (kind == "tool_result"),
        "model_reasoning": model & (kind == "thinking"),
        "model_tool": model & (kind == "tool_use"),
        "model_generation": model & (kind == "text"),
    }
    out = blocks.groupBy("session_id").agg(*(F.sum(F.when(c, n).otherwise(0)).alias(k) for k, c in sums.items()))
    mine, all_ = F.col("user_prompt") + F.col("user_tool_result"), sum((F.col(k) for k in sums), F.lit(0))
    return out.withColumn("user_ratio", F.round(F.when(all_ == 0, 0.0).otherwise(mine / F.when(all_ == 0, 1).otherwise(all_)), 4))


def redundancy(prompts: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Share of a session's prompts that are like another one."""
    like = similar.alike(prompts, threshold).groupBy("session_id").agg(F.count(F.lit(1)).alias("like"))
    n = prompts.groupBy("session_id").agg(F.count(F.lit(1)).alias("prompts"))
    return n.join(like, "session_id", "left").select("session_id", "prompts", F.round(F.coalesce("like", F.lit(0)) / F.col("prompts"), 4).alias("redundancy"))


def drift_steps(prompts: DataFrame) -> DataFrame:
    """Similarity of each prompt to the one before it, and its direction."""
    return similar.steps(prompts).withColumn("direction", F.when(F.col("similarity") >= 0.6, "convergent").when(F.col("similarity") <= 0.4, "divergent").otherwise("evolving"))


def trajectory(steps: DataFrame) -> DataFrame:
    n, con, div = F.count(F.lit(1)), F.count_if(F.col("direction") == "convergent"), F.count_if(F.col("direction") == "divergent")
    kind = F.when((con == 0) & (div == 0), "stable").when(con > n / 2, "convergent").when(div > n / 2, "divergent").otherwise("mixed")
    return steps.groupBy("session_id").agg(n.alias("steps"), F.round(F.avg("similarity"), 4).alias("avg_similarity"), kind.alias("trajectory"))


def prompt_responses(messages: DataFrame) -> DataFrame:
    """(session_id, pair_index, prompt, response): assistant text up to the next real prompt; prompts without any are dropped.

    messages: session_id, position, role, text; rows of tool results don't end a response and have is_prompt false.
    """
    order = W.partitionBy("session_id").orderBy("position")
    turn = messages.withColumn("turn", F.sum(F.when(F.col("is_prompt"), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))).where("turn > 0")
    said = F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.struct("position", "text"))))
    pairs = turn.groupBy("session_id", "turn").agg(F.max(F.when(F.col("is_prompt"), F.col("text"))).alias("prompt"), F.concat_ws(" ", F.transform(said, lambda t: t["text"])).alias("response")).where("response <> ''")
    return pairs.select("session_id", (F.row_number().over(W.partitionBy("session_id").orderBy("turn")) - 1).cast("long").alias("pair_index"), "prompt", "response")


def alignment(similarity: DataFrame, low: float = 0.3) -> DataFrame:
    """similarity: session_id, pair_index, similarity."""
    return similarity.groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 4).alias("avg_alignment"), F.count_if(F.col("similarity") < low).alias("low_pairs"))
