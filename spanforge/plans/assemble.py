"""A session's whole report as one row: structs and lists that Spark puts together, so that any number of sessions is
reported, written by tasks, and compared without passing through the driver.

Lists are ordered as they are shown. A report with ``most`` keeps the first so many similar pairs, drift steps and
exchanges; their numbers are columns of their own, and ``details()`` has all of them as rows. Parts that a session lacks
are null; lists and counts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.operators import patterns, spans
from spanforge.plans.analyze import Analysis, groups, input_analysis, parents
from spanforge.plugins import Config

#: Patterns that a report lists, and how much of a prompt it shows.
MOST_PATTERNS, SHOWN = 6, 40
#: Parts of a report that a session may lack.
PARTS = ("economics", "waste_patterns", "waste_summary", "waste_breakdown", "input_analysis")


def fields(df: DataFrame, *but: str) -> Column:
    return F.struct(*(c for c in df.columns if c not in ("session_id", *but)))


def listed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """(session_id, name): each session's rows as one list, by order."""
    keyed = df.select("session_id", F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), fields(df).alias("item")).alias("x"))
    return keyed.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias(name))


def first(df: DataFrame, most: int | None, *order: Column) -> DataFrame:
    """The first rows of each session, by order; all where most is None."""
    if most is None:
        return df
    return df.withColumn("nth", F.row_number().over(W.partitionBy("session_id").orderBy(*order))).where(F.col("nth") <= most).drop("nth")


def waste_table(breakdown: DataFrame) -> DataFrame:
    """(session_id, waste_breakdown): sources, the dearest first, with their shares of the wasted tokens, and sums."""
    item = F.struct((-F.col("cost_usd")).alias("o"), "source", fields(breakdown).alias("item"))
    out = breakdown.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("rows"), F.sum("tokens").alias("total"), F.round(F.sum("cost_usd"), 6).alias("usd"))
    share = lambda x: F.bround(F.when(F.col("total") == 0, 0.0).otherwise(x["item"]["tokens"] * 100 / F.greatest("total", F.lit(1))), 1)
    sources = F.transform("rows", lambda x: x["item"].withField("percentage", share(x)))
    return out.select("session_id", F.struct(sources.alias("sources"), F.col("total").alias("total_tokens"), F.col("usd").alias("total_cost_usd")).alias("waste_breakdown"))


def waste_summary(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, waste_summary): the explanation, and wasted tokens by category and by phase as maps."""
    of = lambda d: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dimension") == d, F.struct("name", "tokens")))))
    by = patterns.waste_by(labelled).groupBy("session_id").agg(*(of(d).alias(f"by_{d}") for d in ("category", "phase")))
    told = patterns.explanations(labelled, found)
    empty = F.create_map().cast("map<string, bigint>")
    own = told.join(by, "session_id", "left").select(*told.columns, *(F.coalesce(f"by_{d}", empty).alias(f"by_{d}") for d in ("category", "phase")))
    return own.select("session_id", fields(own).alias("waste_summary"))


def details(a: Analysis, config: Config = Config(), found: dict[str, DataFrame] | None = None) -> dict[str, tuple[DataFrame, tuple[Column, ...]]]:
    """Rows of similar prompts, drift steps and exchanges, with the order in which a session's are told."""
    found = found or input_analysis(a, config)
    texts = a.prompts.select("session_id", "prompt_index", F.substring("text", 1, SHOWN).alias("text"))
    named = lambda k: texts.withColumnsRenamed({"prompt_index": k, "text": f"text_{k}"})
    near = found["similar"].join(named("i"), ["session_id", "i"]).join(named("j"), ["session_id", "j"])
    told = found["exchanges"].select("session_id", "pair_index", F.substring("prompt", 1, SHOWN).alias("prompt"), "similarity")
    return {
        "similar_pairs": (near, (-F.col("similarity"), F.col("i"), F.col("j"))),
        "drift_steps": (found["drift"], (F.col("prompt_index"),)),
        "exchanges": (told, (F.col("pair_index"),)),
    }


def _inputs(a: Analysis, config: Config, most: int | None) -> DataFrame:
    """(session_id, input_analysis)."""
    found = input_analysis(a, config)
    rows = details(a, config, found)
    near = found["similar"].groupBy("session_id").agg(F.count(F.lit(1)).alias("n_similar"))
    redundancy = found["redundancy"].join(near, "session_id", "left").fillna(0, ["n_similar"])
    wholes = {"token_breakdown": (found["breakdown"], None), "prompt_similarity": (redundancy, "similar_pairs"), "intent_drift": (found["trajectory"], "drift_steps"), "prompt_response_alignment": (found["alignment"], "exchanges")}
    out = None
    for name, (df, key) in wholes.items():
        own = df.select("session_id", fields(df).alias(name))
        if key:
            items, order = rows[key]
            lists = listed(first(items, most, *order), key, *order)
            kind = lists.schema[key].dataType
            own = own.join(lists, "session_id", "left").select("session_id", F.col(name).withField(key, F.coalesce(key, F.array().cast(kind))).alias(name))
        out = own if out is None else out.join(own, "session_id", "full")
    return out.select("session_id", fields(out).alias("input_analysis"))


def brief(a: Analysis) -> DataFrame:
    """One row a session of the results: its measures, economics and waste, which is what sums need."""
    return a.results.join(a.economics.select("session_id", fields(a.economics).alias("economics")), "session_id", "left").join(waste_table(a.breakdown), "session_id", "left")


def reports(a: Analysis, config: Config = Config(), with_inputs: bool = True, most: int | None = None) -> DataFrame:
    """brief(), and all that was found besides, as structs."""
    confidence = a.intents.select("session_id", F.col("confidence").alias("intent_confidence"))
    out = brief(a).join(confidence, "session_id", "left").withColumn("phase_scores", F.struct(*(F.col(f"{p}_score").alias(p) for p in spans.PHASES)))
    top = patterns.top(a.patterns, MOST_PATTERNS)
    parts = [waste_summary(a.labelled, a.patterns), listed(top.drop("rank"), "waste_patterns", -F.col("tokens_wasted"), F.col("pattern_type"), F.col("start_position"), F.col("detail"))]
    if with_inputs:
        parts.append(_inputs(a, config, most))
    for part in parts:
        out = out.join(part, "session_id", "left")
    return out


def _usd(part: str, field: str) -> Column:
    return F.coalesce(F.col(part)[field], F.lit(0.0))


def totals(told: DataFrame, *by: str) -> DataFrame:
    """Sums of brief(), of all or by group."""
    n, waste = F.sum("total_tokens"), F.sum("waste_tokens")
    return told.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.bround(F.avg("aggregate_ter"), 4), F.lit(0.0)).alias("average_ter"), F.coalesce(n, F.lit(0)).alias("total_tokens"), F.coalesce(waste, F.lit(0)).alias("waste_tokens"),
        F.coalesce(F.bround(F.when(n > 0, waste * 100 / n), 1), F.lit(0.0)).alias("waste_percent"), F.coalesce(F.round(F.sum(_usd("economics", "cost_usd")), 6), F.lit(0.0)).alias("total_cost_usd"), F.coalesce(F.round(F.sum(_usd("waste_breakdown", "total_cost_usd")), 6), F.lit(0.0)).alias("total_waste_cost_usd"),
    )


def grouped(a: Analysis, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members): each group's sums, and reports with group_id and is_parent."""
    of = parents(a).withColumn("is_parent", F.col("session_id") == F.col("group_id"))
    members, few = told.join(of, "session_id"), brief(a).join(of, "session_id")
    agents = few.groupBy("group_id").agg(F.count_if(~F.col("is_parent")).alias("subagent_count"))
    sums = totals(few, "group_id").drop("average_ter", "sessions")
    ter = groups(a).select("group_id", F.col("group_ter").alias("weighted_ter"))
    return agents.join(ter, "group_id").join(sums, "group_id"), members
