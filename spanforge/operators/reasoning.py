"""Novelty, overthinking and density. Texts: session_id, position, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T

WINDOW, NOVELTY, LEAST_SPANS = 5, 0.15, 3


def novelty(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Share of a span's distinct trigrams that its previous non-empty spans don't have; texts under three characters have none."""
    coded = texts.withColumn("codes", T.code_points(F.lower(F.col("text"))))
    grams = coded.withColumn("grams", F.array_distinct(T.trigram_codes(F.col("codes")))).drop("codes")
    # Spans without trigrams are no one's previous spans.
    before = W.partitionBy("session_id", F.size("grams") > 0).orderBy("position").rowsBetween(-window, -1)
    seen = grams.withColumn("seen", F.flatten(F.collect_list("grams").over(before)))
    share = F.size(F.array_except("grams", "seen")) / F.size("grams")
    return seen.withColumn("novelty", F.when(F.size("grams") > 0, share).otherwise(0.0)).drop("grams", "seen")


def segments(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every span's novelty, phase, valuable words, filler ratio, marginal value and running novelty."""
    scored = novelty(texts, window)
    order = W.partitionBy("session_id").orderBy("position")
    scored = scored.withColumn("idx", F.row_number().over(order) - 1).withColumn("token_count", T.span_tokens(F.col("text"))).withColumn("phase", T.reasoning_phase(F.col("text"))).withColumn("high_value", T.hits(F.col("text"), T.HIGH_VALUE)).withColumn("filler", T.filler_ratio(F.col("text")))
    value = F.col("novelty") * (1 + 0.2 * F.col("high_value")) * (1 - 0.5 * F.col("filler"))
    return scored.withColumn("marginal_value", value).withColumn("cumulative_novelty", F.sum("novelty").over(order.rowsBetween(W.unboundedPreceding, 0)))


def overthinking(parts: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """Where reasoning stops being new: before the second of two stale spans in a row."""
    order = W.partitionBy("session_id").orderBy("position")
    stale = parts.withColumn("stale", F.col("novelty") < threshold)
    stale = stale.withColumn("cut", F.when(F.col("stale") & F.coalesce(F.lag("stale").over(order), F.lit(False)), F.col("idx") - 1))
    whole = W.partitionBy("session_id")
    stale = stale.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("cutoff", F.when(F.col("n") >= LEAST_SPANS, F.min("cut").over(whole)))
    sums = stale.groupBy("session_id").agg(F.sum("token_count").alias("total_tokens"), F.sum(F.when(F.col("cutoff").isNull() | (F.col("idx") <= F.col("cutoff")), F.col("token_count")).otherwise(0)).alias("useful_tokens"), F.first("cutoff").alias("cutoff"))
    wasted = F.col("total_tokens") - F.col("useful_tokens")
    return sums.select("session_id", "cutoff", "total_tokens", "useful_tokens", wasted.alias("wasted_tokens"), (wasted > F.col("total_tokens") * 0.2).alias("is_overthinking"), F.round(F.col("useful_tokens") / F.col("total_tokens"), 4).alias("efficiency"), F.when(F.col("cutoff").isNull(), F.col("total_tokens")).otherwise(F.floor(F.col("useful_tokens") * 1.2)).cast("long").alias("recommended_budget"))


def density(docs: DataFrame, key: str) -> DataFrame:
    """Vocabulary, entropy, redundancy and their mix; texts without words have none, and are wholly redundant."""
    words = docs.select(key, F.explode(T.words(F.lower(F.col("text")))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    total = words.groupBy(key).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("unique"), F.sum(F.col("n") * F.log2("n")).alias("plogp"))
    sentences = F.filter(F.transform(F.split("text", "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    triples = F.flatten(F.transform(F.transform(sentences, lambda s: T.words(F.lower(s))), lambda w: T.runs_of_three(w, " ")))
    repeats = docs.select(key, F.size(sentences).alias("sentences"), triples.alias("triples")).select(key, F.when((F.col("sentences") > 1) & (F.size("triples") > 0), 1 - F.size(F.array_distinct("triples")) / F.size("triples")).otherwise(0.0).alias("redundancy"))
    n, entropy = F.col("words"), F.log2("words") - F.col("plogp") / F.col("words")
    norm = F.when(n > 1, entropy / F.when(n > 1, F.log2("words")).otherwise(1.0)).otherwise(0.0)
    out = docs.select(key).join(total, key, "left").join(repeats, key)
    rich = F.col("unique") / n
    mix = 0.4 * rich + 0.4 * norm + 0.2 * (1 - F.col("redundancy"))
    zero = lambda c, d=0.0: F.round(F.round(F.coalesce(F.when(n > 0, c), F.lit(d)), 9), 4)
    return out.select(key, zero(mix).alias("density"), zero(rich).alias("vocabulary_richness"), zero(entropy).alias("entropy"), zero(entropy / F.greatest(F.lit(1), F.floor(n / 4))).alias("avg_information"), zero(F.col("redundancy"), 1.0).alias("redundancy"))


def keywords(prompts: DataFrame, key: str, most: int = 30) -> DataFrame:
    """Each key's most frequent words of three letters or more, without stop words; ties by the word."""
    plain = F.regexp_replace(F.lower(F.col("text")), "[-_]", " ")
    words = prompts.select(key, F.explode(T.words(plain)).alias("word")).where((F.length("word") >= 3) & ~F.col("word").isin(*T.STOP_WORDS))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= most)


def quick_labels(spans: DataFrame, chosen: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Aligned by the share of keywords that occur in a span; without keywords, everything is."""
    lists = chosen.groupBy("session_id").agg(F.collect_list("word").alias("keywords"))
    score = T.keyword_overlap(F.col("text"), F.col("keywords"))
    return spans.join(lists, "session_id", "left").withColumn("aligned", F.when(F.col("keywords").isNull(), True).otherwise(score >= threshold)).drop("keywords")
