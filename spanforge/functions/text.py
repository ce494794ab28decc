"""Scalar text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"

# Word lists, cues and patterns that define the measures.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "shall", "may", "might", "can", "must", "need", "and", "but", "or", "nor", "not", "no", "if",
    "then", "else", "for", "of", "in", "on", "at", "to", "from", "by", "with", "this", "that", "these", "those", "it", "its",
    "my", "your", "his", "her", "our", "their", "what", "which", "who", "whom", "how", "when", "where", "why", "all", "each",
    "every", "any", "some", "such", "than", "too", "very", "just", "also", "only", "so", "up", "out", "about", "into", "over",
    "after", "before",
)
PERMISSION_WORDS = ("permission denied", "not allowed", "access denied", "eacces", "unauthorized")
ERROR_WORDS = ("error", "failed", "exception", "traceback")
ERROR_MARKERS = ("File does not exist", "command not found", "No such file or directory", "Permission denied", "File has not been read yet")
HIGH_VALUE = ("wait", "hmm", "actually", "but", "however", "therefore", "so", "instead", "alternatively", "correction", "no,", "let me reconsider", "on second thought")
FILLERS = ("let me think", "i need to", "let me re-read", "let me re-examine", "let me check", "let me look", "ok so", "so basically", "i should", "i'll need to")
EXPLORING = ("let me", "could", "might", "perhaps", "what if", "one approach", "another way", "option", "possible")
CONFIRMING = ("yes", "correct", "right", "confirmed", "verified", "this works", "that's right", "exactly")
NEAR_ANSWER = ("therefore", "so the answer", "in conclusion", "final", "the solution is", "here's the plan", "to summarize", "putting it all together")
MULTI_FILE = ("refactor", "rename across", "update all", "find and replace", "migration", "across the codebase", "every file")
ARCHITECTURE = ("architect", "design", "system", "infrastructure", "microservice", "database schema", "api design", "scalab", "distributed")
SIMPLE = ("fix typo", "rename", "add comment", "update readme", "change color", "update version", "bump", "lint", "format", "simple", "quick", "trivial")
BUG = ("bug", "fix", "broken", "error", "crash", "fail", "doesn't work", "not working", "regression")
FEATURE = ("implement", "add feature", "build", "create", "new endpoint", "new component", "integrate")
#: Shell commands for which a dedicated tool exists: pattern, tool; the first that matches counts.
SHELL_TOOLS = ((r"(^|\|\s*)cat\s+", "Read"), (r"(^|\|\s*)head\s+", "Read"), (r"(^|\|\s*)tail\s+", "Read"), (r"(^|\|\s*)grep\s+", "Grep"), (r"(^|\|\s*)rg\s+", "Grep"), (r"^find\s+", "Glob"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def span_tokens(text: Column) -> Column:
    """Four code points a token, one token at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def hits(text: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues occur in the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.when(F.contains(low, F.lit(c)), 1).otherwise(0) for c in cues), F.lit(0))


def contains_any(text: Column, cues: tuple[str, ...]) -> Column:
    return hits(text, cues) > 0


def filler_hits(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (F.when(low.rlike(rf"\b{c}\b"), 1).otherwise(0) for c in FILLERS), F.lit(0))


def filler_ratio(text: Column) -> Column:
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    return F.least(F.lit(1.0), filler_hits(text) / sentences)


def reasoning_phase(text: Column) -> Column:
    n = n_words(text)
    near, sure, open_ = hits(text, NEAR_ANSWER) * 2.0, hits(text, CONFIRMING) * 1.5, hits(text, EXPLORING) * 1.0
    most = F.greatest(near, sure, open_)
    return (
        F.when((n > 0) & (filler_hits(text) / F.greatest(F.lit(1.0), n / 20) > 0.5), "filler")
        .when(most == 0, "ambiguous")
        .when(near == most, "near_answer")
        .when(sure == most, "confirming")
        .otherwise("exploring")
    )


def weighted_prompts(prompts: Column) -> Column:
    """The first prompt once, later ones twice, in order."""
    return F.concat_ws(" ", F.flatten(F.transform(prompts, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(p, p)))))


def intent_confidence(text: Column, n_prompts: Column) -> Column:
    n = n_words(text)
    base = F.when(n <= 1, 0.2).when(n <= 2, 0.3).when(n <= 5, 0.5).when(n <= 10, 0.7).otherwise(0.85)
    return F.round(F.when(n_prompts > 1, F.least(F.lit(0.95), base + F.least(F.lit(0.1), n_prompts * 0.03))).otherwise(base), 2)


def filler_bound(threshold: float) -> float:
    return max(0.06, min(0.14, 0.28 * threshold))


def verbose_bound(threshold: float) -> float:
    return max(0.05, min(0.12, 0.22 * threshold))


def shell_tool(command: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, tool in reversed(SHELL_TOOLS):
        out = F.when(F.trim(command).rlike(pattern), tool).otherwise(out)
    return out


def plain_command(command: Column) -> Column:
    """Without a final pipe to tail or head, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.trim(command), r"\s*\|\s*(tail|head)\s+-\d+\s*$", ""), r"\s+", " ")


def is_error(text: Column) -> Column:
    marks = reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in ("<tool_use_error>", *ERROR_MARKERS)))
    return F.coalesce(marks | text.startswith("Error:") | text.startswith("Exit code 1"), F.lit(False))


def short_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def short(path: str) -> str:
    """short_name() of a collected path."""
    return path.replace("\\", "/").rsplit("/", 1)[-1]


def tool_name(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"^\S+", 0)


def tool_parameters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^\S+", ""))


def file_path(parameters: Column) -> Column:
    at = lambda k: F.nullif(F.get_json_object(parameters, f"$.{k}"), F.lit(""))
    return F.coalesce(at("file_path"), at("path"))


def runs_of_three(parts: Column, between: str = "") -> Column:
    """Neighbouring triples of an array, joined; shifted copies are zipped, so nothing is evaluated once more for each place."""
    n = F.greatest(F.size(parts) - 2, F.lit(0))
    join = lambda a, b: F.concat(a, F.lit(between), b)
    return F.zip_with(F.zip_with(F.slice(parts, 1, n), F.slice(parts, 2, n), join), F.slice(parts, 3, n), join)


def code_points(text: Column) -> Column:
    """A text's code points, in time that grows with its length."""
    return F.when(text != "", F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))).otherwise(F.expr("cast(array() AS array<bigint>)"))


def trigram_codes(codes: Column) -> Column:
    """The trigrams of code points, a number each, of 21 bits a code point, so that equal numbers are equal trigrams."""
    n = F.size(codes) - 2
    join = lambda a, b: a * (1 << 21) + b
    three = F.zip_with(F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), join), F.slice(codes, 3, n), join)
    return F.when(n > 0, three).otherwise(F.expr("cast(array() AS array<bigint>)"))


def trigrams(text: Column) -> Column:
    return F.when(F.length(text) >= 3, runs_of_three(F.split(text, ""))).otherwise(F.array().cast("array<string>"))


def trigram_cosine(a: Column, b: Column) -> Column:
    """Of the two texts' trigram counts; case counts. Trigrams are sorted once and counted by their runs' ends, so time grows
    little faster than length."""

    def counts(text: Column) -> Column:
        """A map of trigrams to counts, from a sorted array: a run ends where the next one differs. Nothing that is in a
        lambda function refers to a whole array, which would be made anew for each element."""
        t = F.array_sort(trigrams(text))
        last = F.zip_with(t, F.slice(t, 2, F.size(t)), lambda x, y: F.when(~x.eqNullSafe(y), x))
        ends = F.filter(F.transform(last, lambda x, i: F.struct(x.alias("g"), i.alias("i"))), lambda x: x["g"].isNotNull())
        before = F.concat(F.array(F.lit(-1)), F.transform(ends, lambda x: x["i"]))
        sized = F.zip_with(ends, before, lambda x, p: F.struct(x["g"].alias("key"), (x["i"] - p).cast("double").alias("value")))
        return F.map_from_entries(F.filter(sized, lambda x: x["key"].isNotNull()))

    def square(m: Column) -> Column:
        return F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)

    ca, cb = counts(a), counts(b)
    both = F.map_zip_with(ca, cb, lambda _, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    dot = F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)
    few = (F.length(a) < 3) | (F.length(b) < 3)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(few, 1.0).otherwise(dot / F.sqrt(F.greatest(square(ca) * square(cb), F.lit(1.0))))


def code_density(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"[{}\[\]();=<>]")) / F.length(text)))


def phase_tokens(text: Column, phase: Column) -> Column:
    """Rounded half to even, as the measure is defined."""
    return F.bround(F.length(text) / F.when(phase == "tool_use", 3.2).otherwise(4.0)).cast("long")


def count_confidence(text: Column, method: Column) -> Column:
    base = F.when(method == "api", 1.0).when(method == "calibrated", 0.9).otherwise(0.8)
    return F.when(method == "api", base).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - code_density(text) * 0.15)))


def count_tokens(text: Column, phase: Column, multiplier: Column | None = None, counted: Column | None = None) -> Column:
    """struct: tokens, confidence and method: counted elsewhere where that is known, else by characters a token (where that
    is positive), else by the phase's; an empty text has none, surely."""
    size, none = F.length(text), F.coalesce(F.length(text) == 0, F.lit(True))
    known = F.lit(False) if counted is None else counted.isNotNull()
    fitted = F.lit(False) if multiplier is None else F.coalesce(multiplier > 0, F.lit(False))
    method = F.when(none, "heuristic").when(known, "api").when(fitted, "calibrated").otherwise("heuristic")
    by_fit = F.lit(0) if multiplier is None else F.bround(size / F.when(multiplier > 0, multiplier).otherwise(1.0))
    tokens = F.when(none, 0).when(known, F.lit(0) if counted is None else counted).when(fitted, by_fit).otherwise(phase_tokens(text, phase)).cast("long")
    return F.struct(tokens.alias("tokens"), F.when(none, 1.0).otherwise(count_confidence(text, method)).alias("confidence"), method.alias("method"))


def keyword_overlap(text: Column, keywords: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(keywords) == 0, 0.0).otherwise(F.size(F.filter(keywords, lambda k: F.contains(low, k))) / F.size(keywords))


def complexity(text: Column) -> Column:
    """struct: tier, confidence and the features."""
    n = n_words(text)
    sentences = F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]")))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    code, path = one(F.contains(text, F.lit("`"))), one(text.rlike(r"[/\\]\w+\.\w+"))
    simple = hits(text, SIMPLE) * 3.0 + one(n < 15) * 2.0 + one(sentences <= 2)
    complex_ = hits(text, MULTI_FILE) * 3.0 + hits(text, ARCHITECTURE) * 3.0 + one(n > 80) * 2.0 + one(sentences > 5) + code * 1.5
    standard = hits(text, BUG) * 2.0 + hits(text, FEATURE) * 2.0 + one((n >= 15) & (n <= 80)) * 1.5 + path
    most, total = F.greatest(simple, standard, complex_), simple + standard + complex_
    tier = F.when(total == 0, "standard").when(simple == most, "simple").when(standard == most, "standard").otherwise("complex")
    return F.struct(tier.alias("tier"), F.when(total == 0, 0.33).otherwise(most / F.when(total == 0, 1.0).otherwise(total)).alias("confidence"), n.alias("word_count"), sentences.alias("sentence_count"), simple.alias("simple_score"), standard.alias("standard_score"), complex_.alias("complex_score"))


def band(ter: Column) -> Column:
    return F.when(ter >= 0.7, "green").when(ter >= 0.4, "yellow").otherwise("red")


def band_of(ter: float) -> str:
    """band() of a collected value."""
    return "green" if ter >= 0.7 else "yellow" if ter >= 0.4 else "red"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
