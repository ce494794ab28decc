"""Intents of a session's prompts: the whole, sliding segments, or a hierarchy of one high intent and its parts.

A strategy takes prompts (session_id, prompt_index, text) and gives intents: session_id, part, text, confidence,
prompts. Part 0 of a hierarchy is the high intent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import similar


def sliding(prompts: DataFrame, similarity: DataFrame, threshold: float = 0.45, most: int = 5) -> DataFrame:
    """(session_id, prompt_index, segment): a new segment where a prompt is unlike the one before, or the segment is full.

    A segment's length depends on the splits before it, so the prompts of a session are folded in order.
    similarity: session_id, prompt_index, similarity to the prompt before.
    """
    rows = prompts.select("session_id", "prompt_index").join(similarity.select("session_id", "prompt_index", "similarity"), ["session_id", "prompt_index"], "left")
    one = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("prompt_index", "similarity"))).alias("all"))
    start = F.struct(F.lit(-1).alias("segment"), F.lit(0).alias("length"), F.expr("cast(array() AS array<struct<prompt_index: int, segment: int>>)").alias("out"))

    def step(a, x):  # noqa: ANN001, ANN202
        fresh = (a["segment"] < 0) | (F.coalesce(x["similarity"], F.lit(0.0)) < threshold) | (a["length"] >= most)
        segment = F.when(fresh, a["segment"] + 1).otherwise(a["segment"])
        return F.struct(segment.alias("segment"), F.when(fresh, 1).otherwise(a["length"] + 1).alias("length"), F.concat(a["out"], F.array(F.struct(x["prompt_index"].cast("int").alias("prompt_index"), segment.alias("segment")))).alias("out"))

    return one.select("session_id", F.explode(F.aggregate("all", start, step, lambda a: a["out"])).alias("x")).select("session_id", "x.prompt_index", "x.segment")


def segment_intents(prompts: DataFrame, segments: DataFrame) -> DataFrame:
    """One intent a segment: text, and the mean of its prompts' confidences with a bonus for several."""
    joined = prompts.join(segments, ["session_id", "prompt_index"]).withColumn("own", T.intent_confidence(F.col("text"), F.lit(1)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("prompt_index", "text"))), lambda t: t["text"])
    n = F.count(F.lit(1))
    sure = F.avg("own")
    return joined.groupBy("session_id", "segment").agg(F.concat_ws(" ", texts).alias("text"), n.alias("prompts"), F.round(F.when(n > 1, F.least(F.lit(0.95), sure + F.least(F.lit(0.1), n * 0.03))).otherwise(sure), 2).alias("confidence"))


def whole(prompts: DataFrame) -> DataFrame:
    """One intent a session: its weighted prompt text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("prompt_index", "text"))), lambda t: t["text"])
    out = prompts.groupBy("session_id").agg(listed.alias("listed"))
    n = F.size("listed")
    return out.select("session_id", F.lit(0).alias("part"), T.weighted_prompts(F.col("listed")).alias("text"), T.intent_confidence(F.concat_ws(" ", "listed"), n).alias("confidence"), n.alias("prompts"))


def segments(prompts: DataFrame) -> DataFrame:
    """One intent for each sliding segment."""
    found = segment_intents(prompts, sliding(prompts, similar.steps(prompts)))
    return found.select("session_id", F.col("segment").alias("part"), "text", "confidence", F.col("prompts").cast("int").alias("prompts"))


def hierarchy(prompts: DataFrame) -> DataFrame:
    """The first prompt as the high intent, each later one as a part of it."""
    return prompts.select("session_id", F.col("prompt_index").cast("int").alias("part"), "text", T.intent_confidence(F.col("text"), F.lit(1)).alias("confidence"), F.lit(1).alias("prompts"))


def goals(extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A strategy from a function that adds goal, steps (array) and constraints (array) to sessions' whole intents, as a
    model outside of this engine may; where it gives no goal, the prompts themselves stay."""

    def strategy(prompts: DataFrame) -> DataFrame:
        base = whole(prompts)
        found = extract(base).select("session_id", goal_text(F.col("goal"), F.col("steps"), F.col("constraints")).alias("goal"))
        told = F.coalesce("goal", F.lit("")) != ""
        return base.join(found, "session_id", "left").select("session_id", "part", F.when(told, F.col("goal")).otherwise(F.col("text")).alias("text"), F.when(told, 0.95).otherwise(F.col("confidence")).alias("confidence"), "prompts")

    return strategy


STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"whole": whole, "sliding": segments, "hierarchical": hierarchy}


def strategy(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"no intent strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[name]


def _by_part(spans: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, position, part, similarity) of every span to every intent of its session."""
    both = spans.select("session_id", "position", "text").join(parts.select("session_id", "part", F.col("text").alias("goal")), "session_id")
    return similar.between(both, F.col("text"), F.col("goal"), keys=("position", "part")).withColumn("part", F.col("part").cast("int"))


def scores(spans: DataFrame, prompts: DataFrame, weight: float = 0.7) -> DataFrame:
    """(session_id, position, score, part): spans by the hierarchy of the session's prompts. Sessions of one prompt have
    its similarity as score, and no part."""
    s = _by_part(spans, hierarchy(prompts))
    return blended(s.where("part = 0"), s.where("part > 0"), weight)


def similarity_by(name: str, spans: DataFrame, prompts: DataFrame) -> DataFrame:
    """(session_id, position, similarity) to a session's intents by a strategy: to the hierarchy of its prompts, or to the
    nearest of several."""
    if name == "hierarchical":
        return scores(spans, prompts).select("session_id", "position", F.col("score").alias("similarity"))
    return _by_part(spans, strategy(name)(prompts)).groupBy("session_id", "position").agg(F.max("similarity").alias("similarity"))


def blended(high: DataFrame, subs: DataFrame, weight: float = 0.7) -> DataFrame:
    """Span scores from the high intent's similarity and the best part's. Both: session_id, position, similarity; subs: part."""
    # Of equally similar parts the first; the high intent (no part) where it is more similar than any.
    best = subs.groupBy("session_id", "position").agg(F.min(F.struct((-F.col("similarity")).alias("x"), "part")).alias("top")).select("session_id", "position", (-F.col("top.x")).alias("best"), F.col("top.part").alias("best_part"))
    score = F.when(F.col("best").isNull(), F.col("similarity")).otherwise(weight * F.col("best") + (1 - weight) * F.col("similarity"))
    return high.join(best, ["session_id", "position"], "left").select("session_id", "position", F.round(score, 6).alias("score"), F.when(F.col("best") >= F.col("similarity"), F.col("best_part")).alias("part"))


def goal_text(goal: Column, steps: Column, constraints: Column) -> Column:
    """A structured goal as one text: the goal, its steps, its constraints."""
    return F.concat_ws(" ", goal, F.concat_ws(" ", steps), F.concat_ws(" ", constraints))
