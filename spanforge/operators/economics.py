"""Usage, cost, growth and budgets. Messages: session_id, turn, role, and four token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# USD a million tokens, by model.
RATES = {
    "haiku": {"input": 0.80, "output": 4.00, "cached_read": 0.08, "cached_write": 1.00},
    "sonnet": {"input": 3.00, "output": 15.00, "cached_read": 0.30, "cached_write": 3.75},
    "opus": {"input": 15.00, "output": 75.00, "cached_read": 1.50, "cached_write": 18.75},
}
BUDGET_RATES = {"haiku": (0.25, 1.25), "sonnet": (3.00, 15.00), "opus": (15.00, 75.00)}
#: A tier's model, thinking tokens and tokens in all.
TIERS = {"simple": ("haiku", 2048, 5000), "standard": ("sonnet", 8192, 25000), "complex": ("opus", 32768, 100000)}


def safe(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, otherwise).otherwise(a / F.when(b == 0, 1).otherwise(b))


def rates_of(model: str | dict[str, float]) -> dict[str, float]:
    """A model's rates by its name, or rates as they are given."""
    return RATES[model] if isinstance(model, str) else model


def usage(messages: DataFrame, model: str | dict[str, float] = "sonnet") -> DataFrame:
    """Assistant messages' sums, cache rate, output ratio and cost."""
    r = rates_of(model)
    names = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    out = messages.where("role = 'assistant'").groupBy("session_id").agg(*(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names))
    i, o, w, c = (F.col(n) for n in names)
    cost = (i * r["input"] + o * r["output"] + c * r["cached_read"] + w * r["cached_write"]) / 1e6
    return out.select("session_id", *names, F.round(safe(c, c + i), 4).alias("cache_hit_rate"), F.round(F.round(safe(i, o), 9), 2).alias("io_ratio"), F.round(cost, 8).alias("cost_usd"))


def growth(messages: DataFrame, least: int = 100) -> DataFrame:
    """Growth of the context over assistant turns of more than 100 tokens: last over first, and whether it accelerates."""
    context = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0))
    turns = messages.where("role = 'assistant'").withColumn("context", context).where(F.col("context") > least)
    order = W.partitionBy("session_id").orderBy("turn")
    step = turns.withColumn("step", F.col("context") - F.lag("context").over(order))
    # The mean of second differences has the sign of the last step less the first.
    out = step.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.min_by("context", "turn").alias("first_context"), F.max_by("context", "turn").alias("last_context"), F.min_by("step", F.when(F.col("step").isNotNull(), F.col("turn"))).alias("first_step"), F.max_by("step", "turn").alias("last_step"))
    rate = F.round(F.round(F.when(F.col("turns") < 2, 1.0).otherwise(F.col("last_context") / F.col("first_context")), 9), 2)
    more = (F.col("turns") >= 3) & (F.col("last_step") > F.col("first_step"))
    return out.select("session_id", "turns", rate.alias("growth_rate"), F.coalesce(more, F.lit(False)).alias("super_linear"), (F.coalesce(more, F.lit(False)) & (rate > 2)).alias("bloat"))


def waste_cost(spans: DataFrame, billed: DataFrame, model: str | dict[str, float] = "sonnet") -> DataFrame:
    """Assistant waste at output rates, scaled from estimated to billed tokens. billed: session_id, output_tokens."""
    own = F.col("source_role") == "assistant"
    sums = spans.groupBy("session_id").agg(F.sum(F.when(own, F.col("token_count")).otherwise(0)).alias("estimated"), F.sum(F.when(own & ~F.col("aligned"), F.col("token_count")).otherwise(0)).alias("waste"))
    both = sums.join(billed.select("session_id", "output_tokens"), "session_id")
    ratio = F.when((F.col("estimated") == 0) | (F.col("output_tokens") == 0), 1.0).otherwise(F.col("output_tokens") / F.when(F.col("estimated") == 0, 1).otherwise(F.col("estimated")))
    return both.select("session_id", F.round(ratio, 4).alias("calibration"), F.round(F.col("waste") * ratio * rates_of(model)["output"] / 1e6, 6).alias("waste_cost_usd"))


def _rate(spans: DataFrame, rates: dict[str, float]) -> Column:
    """A span's rate: that of its category, where it names one, else the output rate; thinking is output."""
    if "category" not in spans.columns:
        return F.lit(rates["output"])
    known = F.create_map(*(F.lit(x) for k, v in (rates | {"thinking": rates["output"]}).items() for x in (k, v)))
    return F.coalesce(F.element_at(known, F.col("category")), F.lit(rates["output"]))


def cost_weighted(spans: DataFrame, model: str | dict[str, float] = "sonnet", cached: DataFrame | None = None) -> DataFrame:
    """Aligned dollars over all dollars. cached: session_id, cache_read_tokens, cache_creation_tokens; their dollars count
    on both sides."""
    rates = rates_of(model)
    cost = F.col("token_count").cast("decimal(18,0)") * _rate(spans, rates).cast("decimal(14,6)")
    sums = spans.withColumn("cost", cost).groupBy("session_id").agg(F.sum("cost").alias("total"), F.sum(F.when(F.col("aligned"), F.col("cost")).otherwise(F.lit(0))).alias("good"))
    if cached is not None:
        more = F.coalesce("cache_read_tokens", F.lit(0)) * rates["cached_read"] + F.coalesce("cache_creation_tokens", F.lit(0)) * rates["cached_write"]
        sums = sums.join(cached.select("session_id", "cache_read_tokens", "cache_creation_tokens"), "session_id", "left").withColumn("more", more)
        sums = sums.withColumn("total", F.col("total").cast("double") + F.col("more")).withColumn("good", F.col("good").cast("double") + F.col("more"))
    total, good = F.col("total").cast("double") / 1e6, F.col("good").cast("double") / 1e6
    return sums.select("session_id", F.round(safe(good, total, 1.0), 4).alias("cost_weighted_ter"), F.round(total, 6).alias("total_cost_usd"), F.round(total - good, 6).alias("waste_cost_usd"))


def phase_costs(spans: DataFrame, model: str | dict[str, float] = "sonnet") -> DataFrame:
    """(session_id, phase, cost_usd, waste_cost_usd): sums of spans' costs, each rounded to six digits."""
    cost = F.round(F.col("token_count") / 1e6 * _rate(spans, rates_of(model)), 6).cast("decimal(18,6)")
    sums = spans.withColumn("cost", cost).groupBy("session_id", "phase").agg(F.sum("cost").alias("c"), F.sum(F.when(~F.col("aligned"), F.col("cost")).otherwise(F.lit(0))).alias("w"))
    return sums.select("session_id", "phase", F.col("c").cast("double").alias("cost_usd"), F.round(F.col("w").cast("double"), 6).alias("waste_cost_usd"))


def cost_report(spans: DataFrame, density: DataFrame, model: str = "sonnet", cached: DataFrame | None = None) -> DataFrame:
    """By session: cost_weighted(), phases (name, cost, waste), savings by other models, and advice.

    density: session_id, density, redundancy. Advice names dear waste, the dearest phase, repetitive and thin text, and
    cheaper models where little is wasted."""
    own = cost_weighted(spans, model, cached)
    phases = phase_costs(spans, model)
    listed = phases.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("phase", "cost_usd", "waste_cost_usd"))).alias("phases"), F.min(F.struct((-F.col("waste_cost_usd")).alias("x"), "phase")).alias("worst"))
    others = alternatives(spans, model).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("model", "saving_usd"))).alias("savings"))
    out = own.join(listed, "session_id").join(others, "session_id").join(density.select("session_id", "density", "redundancy"), "session_id", "left")
    usd = lambda c: F.concat(F.lit("$"), F.format_number(c, 4))
    rules = F.array(
        F.when(F.col("waste_cost_usd") > 0.01, F.concat(F.lit("waste costs "), usd(F.col("waste_cost_usd")))),
        F.when(F.col("worst.x") < 0, F.concat(F.lit("most waste is in "), F.col("worst.phase"), F.lit(": "), usd(-F.col("worst.x")))),
        F.when(F.col("redundancy") > 0.3, F.lit("text is repetitive: shorten prompts")),
        F.when(F.col("density") < 0.3, F.lit("text is thin: much of it is filler")),
    )
    cheaper = F.transform(F.filter("savings", lambda s: (s["saving_usd"] > 0) & (F.col("cost_weighted_ter") > 0.7)), lambda s: F.concat(s["model"], F.lit(" would save "), usd(s["saving_usd"])))
    return out.select(*own.columns, "phases", "savings", F.concat(F.array_compact(rules), cheaper).alias("advice"))


def alternatives(spans: DataFrame, model: str = "sonnet") -> DataFrame:
    """What every other model would save on the spans: summed once, and told for each other model."""
    tokens = spans.groupBy("session_id").agg(F.sum("token_count").alias("tokens"))
    others = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(r["output"]).alias("rate")) for m, r in RATES.items() if m != model))
    each = tokens.select("session_id", "tokens", F.explode(others).alias("o"))
    return each.select("session_id", F.col("o.model").alias("model"), F.round(F.col("tokens") * (RATES[model]["output"] - F.col("o.rate")) / 1e6, 6).alias("saving_usd"))


def waste_breakdown(labelled: DataFrame, found: DataFrame, model: str | dict[str, float] = "sonnet", calibration: DataFrame | None = None) -> DataFrame:
    """Waste by source: assistant waste by category at output rates, the user's side at input rates, and patterns, of
    which those that a category already counts are left out. calibration: session_id, calibration; what is priced as
    output is scaled by it."""
    bad = labelled.where(~F.col("aligned"))
    category = F.when(F.col("source_role") != "assistant", "user_side").otherwise(F.col("label"))
    rows = bad.groupBy("session_id", category.alias("source")).agg(F.sum("token_count").alias("tokens"), F.count(F.lit(1)).alias("n"))
    covered = {"reasoning_loop": "redundant_reasoning", "duplicate_tool_call": "unnecessary_tool_call", "context_restatement": "over_explanation"}
    same = F.lit(None).cast("string")
    for pattern, label in covered.items():
        same = F.when(F.col("pattern_type") == pattern, label).otherwise(same)
    by = found.groupBy("session_id", "pattern_type").agg(F.sum("tokens_wasted").alias("tokens"), F.count(F.lit(1)).alias("n")).withColumn("same", same)
    left = by.join(rows.select("session_id", F.col("source").alias("same")), ["session_id", "same"], "left_anti").select("session_id", F.col("pattern_type").alias("source"), "tokens", "n")
    out = rows.unionByName(left)
    cheap = F.col("source").isin("user_side", "repetitive_read", "bash_antipattern", "failed_tool_retry", "repeated_command")
    rates = rates_of(model)
    scale = F.lit(1.0)
    if calibration is not None:
        out, scale = out.join(calibration.select("session_id", "calibration"), "session_id", "left"), F.coalesce("calibration", F.lit(1.0))
    cost = F.when(cheap, F.col("tokens") * rates["input"]).otherwise(F.col("tokens") * scale * rates["output"])
    return out.select("session_id", "source", "tokens", "n", F.when(cheap, "input").otherwise("output").alias("pricing"), F.round(cost / 1e6, 6).alias("cost_usd"))


def adjustments(history: DataFrame) -> DataFrame:
    """By tier: what past sessions say about its budget. history: complexity, ter, thinking_tokens, total_tokens."""
    thinking = F.create_map(*(F.lit(x) for t, (_, a, _) in TIERS.items() for x in (t, a)))
    total = F.create_map(*(F.lit(x) for t, (_, _, b) in TIERS.items() for x in (t, b)))
    sums = history.groupBy("complexity").agg(F.count(F.lit(1)).alias("n"), F.avg("ter").alias("ter"), F.avg("thinking_tokens").alias("thinking"), F.avg("total_tokens").alias("total"))
    factor = lambda a, base: F.round(F.greatest(F.lit(0.3), F.least(F.lit(2.0), a / F.element_at(base, F.col("complexity")) * 1.2)), 3)
    few = F.col("n") < 5
    up = F.when(F.col("complexity") == "simple", "sonnet").when(F.col("complexity") == "standard", "opus")
    down = F.when(F.col("complexity") == "standard", "haiku").when(F.col("complexity") == "complex", "sonnet")
    other = F.when(few, F.lit(None)).when((F.col("ter") > 0.85) & down.isNotNull(), down).when((F.col("ter") < 0.45) & up.isNotNull(), up)
    return sums.select("complexity", "n", F.when(few, 1.0).otherwise(factor(F.col("thinking"), thinking)).alias("thinking_multiplier"), F.when(few, 1.0).otherwise(factor(F.col("total"), total)).alias("total_multiplier"), other.alias("model_override"), F.round(F.when(few, F.col("n") / 5).otherwise(F.least(F.lit(1.0), F.col("n") / 20)), 3).alias("data_confidence"))


def budget_summary(history: DataFrame) -> DataFrame:
    """By tier: how many past sessions, their average efficiency, thinking tokens and tokens, whole numbers cut."""
    return history.groupBy("complexity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ter"), 4).alias("avg_ter"), F.floor(F.avg("thinking_tokens")).cast("long").alias("avg_thinking_tokens"), F.floor(F.avg("total_tokens")).cast("long").alias("avg_total_tokens"))


def recommend(tasks: DataFrame, adjusted: DataFrame | None = None) -> DataFrame:
    """tasks: tier, confidence and keys; adds model, thinking and total tokens, cost."""
    of = lambda i: F.create_map(*(F.lit(x) for t, v in TIERS.items() for x in (t, v[i])))
    out = tasks if adjusted is None else tasks.join(F.broadcast(adjusted.select(F.col("complexity").alias("tier"), "thinking_multiplier", "total_multiplier", "model_override", "data_confidence")), "tier", "left")
    at = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if adjusted is not None else F.lit(d)
    model = F.element_at(of(0), F.col("tier")) if adjusted is None else F.coalesce("model_override", F.element_at(of(0), F.col("tier")))
    out = out.withColumn("model", model).withColumn("thinking_tokens", F.floor(F.element_at(of(1), F.col("tier")) * at("thinking_multiplier", 1.0)).cast("long")).withColumn("total_tokens", F.floor(F.element_at(of(2), F.col("tier")) * at("total_multiplier", 1.0)).cast("long"))
    rate = lambda i: F.element_at(F.create_map(*(F.lit(x) for m, v in BUDGET_RATES.items() for x in (m, v[i]))), F.col("model"))
    cost = (F.col("total_tokens") - F.col("thinking_tokens")) / 1e6 * rate(0) + (F.col("thinking_tokens") + F.col("total_tokens") * 0.3) / 1e6 * rate(1)
    sure = F.col("confidence") if adjusted is None else F.least(F.lit(1.0), F.col("confidence") * (0.5 + 0.5 * at("data_confidence", 0.0)))
    return out.select(*(c for c in tasks.columns if c != "confidence"), "model", "thinking_tokens", "total_tokens", F.round(cost, 4).alias("cost_usd"), F.round(sure, 4).alias("confidence"))


def calibrate(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares characters a token through the origin. pairs: chars, tokens."""
    use = pairs.where("tokens > 0")
    return use.groupBy(*by).agg(F.round(F.sum(F.col("chars").cast("double") * F.col("tokens")) / F.sum(F.col("tokens").cast("double") * F.col("tokens")), 6).alias("multiplier"), F.count(F.lit(1)).alias("n"))
