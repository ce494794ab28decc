"""The whole analysis as one plan: transcripts (or conversation rows) to labelled spans, results, patterns and cost.

All sessions are analysed at once; a session is a grouping key, and a parent with its agents is another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import embeddings
from spanforge.functions import text as T
from spanforge.operators import economics, inputs, intents, patterns, quality, reasoning, similar, spans
from spanforge.plugins import REGISTRY, Config, Registry
from spanforge.sources import transcripts


@dataclass
class Analysis:
    messages: DataFrame
    blocks: DataFrame
    spans: DataFrame
    prompts: DataFrame
    calls: DataFrame
    intents: DataFrame
    labelled: DataFrame
    results: DataFrame
    patterns: DataFrame
    economics: DataFrame
    breakdown: DataFrame

    def persist(self) -> Analysis:
        """Keep what several reports read, so that transcripts are parsed and compared once."""
        for f in fields(self):
            if f.name in ("messages", "blocks", "labelled", "patterns"):
                getattr(self, f.name).persist()
        return self


def intents_of(prompts: DataFrame) -> DataFrame:
    """(session_id, text, confidence, prompts): a session's weighted prompt text."""
    return intents.whole(prompts).drop("part")


@dataclass(frozen=True)
class Dense:
    """How texts are embedded: a function that makes an encoder, a cache's folder, and, to embed less, whether runs of one
    phase are merged and from how many tokens on a span is embedded."""

    make: Callable[[], embeddings.Encoder]
    cache: str | None = None
    merge: bool = False
    least: int = 0
    batch: int = embeddings.BATCH


def measured(found: DataFrame, goals: DataFrame, dense: Dense | None = None) -> DataFrame:
    """(session_id, position, similarity, repetition) by hashed trigrams, or by a model's embeddings."""
    if dense is None:
        return similar.neighbours(found, goals, spans.REPETITION_WINDOW)
    vectors = embeddings.embed_spans(found, dense.make, dense.cache, dense.least, dense.merge, dense.batch)
    told = goals.where("text <> ''")
    intent = embeddings.get_or_compute(told, dense.make, dense.cache, batch=dense.batch) if dense.cache else embeddings.embed_once(told, dense.make, dense.batch)
    return similar.dense_neighbours(vectors, intent, spans.REPETITION_WINDOW)


def label(found: DataFrame, goals: DataFrame, config: Config = Config(), dense: Dense | None = None) -> DataFrame:
    """Labelled spans."""
    return spans.label(found, measured(found, goals, dense), config.similarity, config.confidence)


def operations(found: DataFrame) -> DataFrame:
    """Calls that read or write a file, with their spans' places and tokens."""
    calls = found.where("block_type = 'tool_use'").withColumn("file", T.file_path(F.col("parameters"))).where("file IS NOT NULL")
    return calls.select("session_id", "position", "file", F.col("tool").isin("Edit", "Write").alias("is_write"), F.col("tool").isin("Read", "cat").alias("is_read"), "token_count")


def detect(found: DataFrame, labelled: DataFrame, blks: DataFrame, calls: DataFrame, config: Config, registry: Registry) -> DataFrame:
    """All patterns, those of registered detectors too."""
    signatures = found.where("block_type = 'tool_use'").withColumn("signature", F.trim("text"))
    tool_results = blks.where("block_type = 'tool_result'").select("session_id", "position", "tool_use_id", "text", F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long").alias("token_count"))
    ops = operations(found)
    return patterns.together(
        patterns.reasoning_loops(labelled),
        patterns.duplicate_calls(signatures),
        patterns.restatements(found, config.restatement),
        patterns.repeated(calls.where("tool = 'Read'"), "repetitive_read", "file"),
        patterns.edit_fragmentation(calls.where("tool IN ('Edit', 'Write') AND file IS NOT NULL").withColumn("token_count", F.lit(0).cast("long"))),
        patterns.shell_antipatterns(calls.where("tool = 'Bash'")),
        patterns.failed_results(tool_results),
        patterns.repeated(calls.where("tool = 'Bash'").withColumn("plain", T.plain_command(F.col("command"))), "repeated_command", "plain"),
        patterns.permission_loops(found),
        patterns.error_spirals(found),
        patterns.over_reading(ops),
        patterns.abandoned(ops),
        patterns.verbose_thinking(found),
        *registry.detected(labelled),
    )


def label_by(name: str, found: DataFrame, prompts: DataFrame, config: Config = Config()) -> DataFrame:
    """Labelled spans, by similarities to the intents of a strategy."""
    own = measured(found, intents_of(prompts)).drop("similarity")
    return spans.label(found, own.join(intents.similarity_by(name, found, prompts), ["session_id", "position"], "left"), config.similarity, config.confidence)


def quick_at(spark: SparkSession, path: str | list[str], config: Config = Config()) -> DataFrame:
    """Results by the quick reading and the prompts' most frequent words, without vectors."""
    prompts, found = transcripts.quick(transcripts.parse_entries(transcripts.read_lines(spark, path), "skip"))
    labelled = reasoning.quick_labels(found, reasoning.keywords(prompts, "session_id"), config.similarity)
    return spans.ter(labelled, weights=dict(zip(spans.PHASES, config.weights, strict=True))).withColumn("method", F.lit("quick"))


def faults_at(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(files, lines): every file's numbers of lines, errors and warnings, and the lines that have any."""
    raw = transcripts.read_lines(spark, path).select(F.col("file").alias("session_id"), "line_no", "raw")
    checked = quality.lines(raw)
    return quality.files(checked), checked.where((F.size("errors") > 0) | (F.size("warnings") > 0))


def transcripts_at(spark: SparkSession, path: str | list[str], config: Config = Config(), mode: str = "strict", registry: Registry = REGISTRY, dense: Dense | None = None, strategy: str = "whole") -> Analysis:
    if dense and strategy != "whole":
        raise ValueError("embeddings go with the whole intent")
    msgs = transcripts.messages(transcripts.parse_entries(transcripts.read_lines(spark, path), mode))
    blks = transcripts.blocks(msgs)
    found = registry.before(transcripts.spans(blks))
    prompts = transcripts.prompts(blks)
    calls = transcripts.calls(blks)
    goals = intents_of(prompts)
    labelled = label(found, goals, config, dense) if strategy == "whole" else label_by(strategy, found, prompts, config)
    results = registry.after(spans.ter(labelled, weights=dict(zip(spans.PHASES, config.weights, strict=True))))
    wasted = detect(found, labelled, blks, calls, config, registry)
    used = economics.usage(msgs, config.model)
    turns = msgs.withColumn("turn", F.col("position"))
    dear = economics.waste_cost(labelled, used, config.model)
    costs = used.join(economics.growth(turns), "session_id", "left").join(dear, "session_id", "left").join(spans.thirds(labelled), "session_id", "left")
    return Analysis(msgs, blks, found, prompts, calls, goals, labelled, results, wasted, costs, economics.waste_breakdown(labelled, wasted, config.model, dear))


def exchanges(a: Analysis) -> DataFrame:
    """(session_id, pair_index, prompt, response, similarity) of prompts and the texts that answer them."""
    texts = F.array_sort(F.collect_list(F.when((F.col("block_type") == "text") & (F.col("text") != ""), F.struct("block_seq", "text"))))
    said = a.blocks.groupBy("session_id", "position", "role").agg(F.concat_ws(" ", F.transform(texts, lambda t: t["text"])).alias("text"))
    told = inputs.prompt_responses(said.withColumn("is_prompt", (F.col("role") == "user") & (F.col("text") != "")))
    return told.join(similar.between(told, F.col("prompt"), F.col("response")), ["session_id", "pair_index"])


def input_analysis(a: Analysis, config: Config = Config()) -> dict[str, DataFrame]:
    pairs, steps, told = similar.pairs(a.prompts), inputs.drift_steps(a.prompts), exchanges(a)
    return {
        "breakdown": inputs.token_breakdown(a.blocks), "pairs": pairs, "similar": similar.alike_pairs(a.prompts, config.prompt_similarity), "redundancy": inputs.redundancy(a.prompts, config.prompt_similarity),
        "drift": steps, "trajectory": inputs.trajectory(steps), "exchanges": told, "alignment": inputs.alignment(told),
    }


def parents(a: Analysis) -> DataFrame:
    """(session_id, group_id): the session whose file an agent's folder is named for, or the session itself."""
    ids = a.messages.select("session_id", "stem", "parent").distinct()
    heads = ids.where("parent = ''").select(F.col("stem").alias("parent"), F.col("session_id").alias("head")).dropDuplicates(["parent"])
    return ids.join(heads, "parent", "left").select("session_id", F.coalesce("head", F.nullif("parent", F.lit("")), "session_id").alias("group_id"))


def groups(a: Analysis) -> DataFrame:
    """Parents with their agents, as one each."""
    return spans.group_ter(a.results.join(parents(a), "session_id"), "group_id")
