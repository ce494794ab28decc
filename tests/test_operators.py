from __future__ import annotations

import math
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions import vectors as V
from spanforge.operators import economics, history, inputs, intents, patterns, quality, reasoning, similar, spans
from spanforge.plugins import REGISTRY, Config, parse_cost_model, parse_weights
from spanforge.streaming import live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def labelled(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "session_id string, position long, phase string, aligned boolean, token_count long")


def test_weighted_efficiency(spark):
    rows = [("reasoning", True, 80), ("reasoning", False, 20), ("tool_use", True, 50), ("tool_use", False, 50), ("generation", True, 60), ("generation", False, 40)]
    r = spans.ter(labelled(spark, rows)).first()
    assert (r.reasoning_score, r.tool_use_score, r.generation_score, r.aggregate_ter) == (0.8, 0.5, 0.6, 0.62)
    r = spans.ter(labelled(spark, [("tool_use", False, 9)]), weights={"reasoning": 0.5, "tool_use": 0.1, "generation": 0.4}).first()
    assert r.aggregate_ter == 0.9


@pytest.mark.parametrize("n, want", [(1, (0, 1, 1)), (2, (0, 0, 1)), (5, (0, 0, 0)), (9, (0, 0, 0))])
def test_thirds(spark, n, want):
    r = spans.thirds(labelled(spark, [("generation", False, 1)] * n)).first()
    assert (r.early_ter, r.mid_ter, r.late_ter) == want


@pytest.mark.parametrize("contexts, want", [([1000, 2000, 3000], (3.0, False, False)), ([1000, 2000, 4000, 9000], (9.0, True, True)), ([1000, 1010, 1030, 1060], (1.06, True, False)), ([3, 5], None)])
def test_growth(spark, contexts, want):
    m = spark.createDataFrame([("s", i, "assistant", c, 0) for i, c in enumerate(contexts)], "session_id string, turn long, role string, input_tokens long, cache_read_tokens long")
    r = economics.growth(m).first()
    assert (r and (r.growth_rate, r.super_linear, r.bloat)) == want


def test_calibrated_waste(spark):
    s = spark.createDataFrame([("s", "assistant", False, 100), ("s", "user", False, 50)], "session_id string, source_role string, aligned boolean, token_count long")
    r = economics.waste_cost(s, spark.createDataFrame([("s", 400)], "session_id string, output_tokens long")).first()
    assert r.calibration == 4.0 and r.waste_cost_usd == pytest.approx(400 * 15 / 1e6)


def test_runs_and_windows_equal_folds(spark):
    r = random.Random(1)
    rows = [("s", i, r.choice("ab"), r.choice("xyz"), 10 * i) for i in range(60)]
    calls = spark.createDataFrame(rows, "session_id string, position long, file string, signature string, token_count long")
    want, run = [], []
    for row in [*rows, (None, None, None, None, None)]:
        if run and row[2] != run[-1][2]:
            if len(run) >= 3:
                want.append((run[0][2], len(run), sum(x[4] for x in run[1:])))
            run = []
        run.append(row)
    got = [(x.detail, x.spans_involved, x.tokens_wasted) for x in patterns.edit_fragmentation(calls).collect()]
    assert sorted(got) == sorted(want)
    seen, want = set(), []
    for i, row in enumerate(rows):
        near = [x for x in rows[max(0, i - 5) : i] if x[3] == row[3]]
        if near and row[3] not in seen:
            seen.add(row[3])
            want.append((row[3], near[0][1], row[1]))
    got = [(x.detail, x.start_position, x.end_position) for x in patterns.duplicate_calls(calls).collect()]
    assert sorted(got) == sorted(want)


def test_duplicate_outside_window(spark):
    calls = spark.createDataFrame([("s", i, s, 1) for i, s in enumerate("abcdefga")], "session_id string, position long, signature string, token_count long")
    assert patterns.duplicate_calls(calls).count() == 0


def test_repeated_reads_free_the_first(spark):
    reads = spark.createDataFrame([("s", i, "f", 100) for i in range(3)] + [("t", i, "f", 100) for i in range(2)], "session_id string, position long, file string, token_count long")
    assert [(r.session_id, r.tokens_wasted) for r in patterns.repeated(reads, "repetitive_read", "file").collect()] == [("s", 200)]


def test_commands(spark):
    for c in ("make | tail -30", " make |  tail -50", "make | head -20 "):
        assert value(spark, T.plain_command(F.lit(c))) == "make"
    tools = {"cat x": "Read", "ls | grep y": "Grep", "find . -name z": "Glob", "echo cat": None, "a | tail -3": "Read"}
    for c, tool in tools.items():
        assert value(spark, T.shell_tool(F.lit(c))) == tool


def test_chains(spark):
    def rows(kinds):
        return spark.createDataFrame([("s", i, k, "Bash", p, t, 10) for i, (k, p, t) in enumerate(kinds)], "session_id string, position long, block_type string, tool string, parameters string, text string, token_count long")

    use, denied, fine = ("tool_use", '{"command":"rm -rf build"}', ""), ("tool_result", None, "Permission denied"), ("tool_result", None, "ok")
    got = patterns.permission_loops(rows([use, denied, use, denied, use, fine, use])).collect()
    assert [(g.start_position, g.end_position, g.spans_involved, g.tokens_wasted) for g in got] == [(0, 4, 3, 20)]
    failed = ("tool_result", None, "Error: failed")
    assert patterns.error_spirals(rows([use, failed, use, failed, use, failed, use])).first().spans_involved == 4
    assert patterns.error_spirals(rows([use, failed, use, failed, ("tool_use", "zzzzzzzz", ""), failed, use])).count() == 0


def test_verbose_thinking_without_action(spark):
    s = spark.createDataFrame([("s", 0, "reasoning", 600), ("s", 1, "tool_use", 10), ("s", 2, "reasoning", 700)], "session_id string, position long, phase string, token_count long")
    got = {g.start_position: (g.tokens_wasted, g.spans_involved) for g in patterns.verbose_thinking(s).collect()}
    assert got == {0: (500, 2), 2: (700, 1)}


def test_errors(spark):
    for t, want in {"Error: x": True, "Exit code 127": True, "fine": False, "<tool_use_error>": True, "bash: command not found": True}.items():
        assert value(spark, T.is_error(F.lit(t))) is want


def test_intent_confidence_and_weighting(spark):
    bands = {"fix": 0.2, "fix it": 0.3, "a b c d e": 0.5, "a b c d e f": 0.7, " ".join("w" * 11): 0.85}
    for t, want in bands.items():
        assert value(spark, T.intent_confidence(F.lit(t), F.lit(1))) == want
    assert value(spark, T.weighted_prompts(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a b b c c"


def test_bounds():
    assert T.filler_bound(0.4) == pytest.approx(0.112) and T.verbose_bound(0.4) == pytest.approx(0.088)


def test_trigram_vectors(spark):
    import hashlib

    df = spark.createDataFrame([(1, "Hello héllo"), (2, "ab")], "k int, text string")
    got = {(r.k, r.bucket): r.weight for r in V.trigram_rows(df, ["k"]).collect()}
    counts: dict[int, int] = {}
    low = "hello héllo"
    for i in range(len(low) - 2):
        b = int(hashlib.md5(low[i : i + 3].encode()).hexdigest(), 16) % 384
        counts[b] = counts.get(b, 0) + 1
    norm = math.sqrt(sum(v * v for v in counts.values()))
    assert {b: w for (k, b), w in got.items() if k == 1} == pytest.approx({b: n / norm for b, n in counts.items()})
    assert got[2, 0] == 1.0
    assert value(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_redundancy_of_four_prompts(spark):
    p = spark.createDataFrame([("s", i, t) for i, t in enumerate(("please fix the login bug", "please fix the login bug", "please fix the login bug", "zqx vww kjy"))], "session_id string, prompt_index long, text string")
    assert inputs.redundancy(p).first().redundancy == 0.75


def test_pairing_skips_tool_results(spark):
    m = spark.createDataFrame([("s", 0, "user", "q1", True), ("s", 1, "assistant", "a", False), ("s", 2, "user", "result", False), ("s", 3, "assistant", "b", False), ("s", 4, "user", "q2", True)], "session_id string, position long, role string, text string, is_prompt boolean")
    assert [(r.prompt, r.response) for r in inputs.prompt_responses(m).collect()] == [("q1", "a b")]


def test_sliding_segments_restart(spark):
    n = 13
    p = spark.createDataFrame([("s", i, "t") for i in range(n)], "session_id string, prompt_index long, text string")
    sims = [0.9] * n
    sims[3] = 0.1
    s = spark.createDataFrame([("s", i, sims[i]) for i in range(1, n)], "session_id string, prompt_index long, similarity double")
    want, segment, length = [], -1, 0
    for i in range(n):
        if segment < 0 or (sims[i] if i else 0) < 0.45 or length >= 5:
            segment, length = segment + 1, 0
        length += 1
        want.append(segment)
    got = [r.segment for r in intents.sliding(p, s).orderBy("prompt_index").collect()]
    assert got == want


def test_novelty_equals_brute_force(spark):
    """Emoji, accents, short, empty and null texts; empty spans are skipped as previous ones."""
    texts = ["the quick brown fox", "the quick red fox 😀😀😀", "", "ab", None, "ÜNÏCÖDÉ über alles", "the quick brown fox", "über 😀😀😀 fox", "zz", "something else", "THE QUICK BROWN FOX", "more of it"]
    rows = [(s, i, t) for s in (1, 2) for i, t in enumerate(texts[::s])]
    got = {(r.session_id, r.position): r.novelty for r in reasoning.novelty(spark.createDataFrame(rows, "session_id long, position long, text string")).collect()}
    for s in (1, 2):
        before = []
        for _, i, t in (r for r in rows if r[0] == s):
            low = (t or "").lower()
            own = {low[k : k + 3] for k in range(len(low) - 2)}
            want = len(own - set().union(*before[-5:])) / len(own) if own else 0.0
            assert abs(got[s, i] - want) < 1e-12, (s, i)
            before += [own] if own else []


def test_overthinking(spark):
    texts = ["a completely new thought about parsing", "another idea on tokens and trees", "another idea on tokens and trees", "another idea on tokens and trees", "another idea on tokens and trees"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, position long, text string")
    r = reasoning.overthinking(reasoning.segments(df)).first()
    assert r.cutoff == 2 and r.is_overthinking and r.useful_tokens == 9 + 8 + 8


def test_density(spark):
    df = spark.createDataFrame([(1, "one two three. one two three."), (2, ""), (3, "solo")], "k int, text string")
    got = {r.k: r for r in reasoning.density(df, "k").collect()}
    assert got[1].redundancy == 0.0 or got[1].redundancy == 0.5
    assert got[2].density == 0.0 and got[2].redundancy == 1.0
    assert got[3].vocabulary_richness == 1.0 and got[3].entropy == 0.0


def test_quality_lines(spark):
    raw = ['{"type":"user","uuid":"u","sessionId":"s","message":{"role":"user","content":"x"}}', "", "{bad", '{"type":"summary"}', '{"type":"user","message":{"role":"user"}}']
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate(raw)], "session_id string, line_no int, raw string")
    got = {r.line_no: (r.valid, list(r.errors), list(r.warnings)) for r in quality.lines(df).collect()}
    assert got[0] == (True, [], []) and got[1] == (True, [], ["empty line"]) and got[2] == (False, ["invalid JSON"], []) and got[3][0]
    assert set(got[4][1]) == {"missing uuid", "missing sessionId", "missing message.content"}
    assert quality.files(quality.lines(df)).first().valid_lines == 3


def test_tags_checks_and_hints(spark):
    r = spark.createDataFrame([("a", ["x"]), ("b", [])], "session_id string, tags array<string>")
    assert {x.session_id: x.tags for x in history.add_tags(r, "a", ["b", "x"]).collect()} == {"a": ["b", "x"], "b": []}
    res = spark.createDataFrame([("a", 0.5, 0.9, 0.2, 0.9)], "session_id string, aggregate_ter double, reasoning_score double, tool_use_score double, generation_score double")
    c = history.check(res, 0.5).first()
    assert not c.passed and c.failed == "tool_use"
    found = spark.createDataFrame([("a", "reasoning_loop"), ("a", "reasoning_loop")], "session_id string, pattern_type string")
    assert [h.impact for h in history.hints(res, found).orderBy("rank").collect()] == ["high", "high"]


def test_configuration(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[thresholds]\nsimilarity = 0.5\n[weights]\nreasoning = 0.2\ntool_use = 0.5\ngeneration = 0.3\n")
    c = Config.load(str(f))
    assert c.similarity == 0.5 and c.weights == (0.2, 0.5, 0.3) and c.merge(similarity=0.6, confidence=None).confidence == 0.75
    f.write_text("not toml [")
    assert Config.load(str(f)) == Config()
    with pytest.raises(ValueError):
        parse_weights("1,1,1")
    assert parse_cost_model("1,2,3,4")["cached_write"] == 4.0


def brute_vector(text):
    import hashlib

    import numpy as np

    low, out = text.lower(), np.zeros(384)
    for i in range(len(low) - 2):
        out[int(hashlib.md5(low[i : i + 3].encode()).hexdigest(), 16) % 384] += 1
    if len(low) < 3:
        out[0] = 1
    return out / np.sqrt(out @ out)


def test_similarities_equal_brute_force(spark):
    r = random.Random(4)
    words = ["parser", "token", "test", "Ünï", "a", "fix", "the", "span"]
    rows = [(s, i, r.choice(["reasoning", "generation"]), " ".join(r.choices(words, k=r.randint(0, 9)))) for s in ("x", "y", "z") for i in range(40)]
    found = spark.createDataFrame(rows, "session_id string, position long, phase string, text string").repartition(5)
    goals = {"x": "fix the parser test", "y": ""}
    got = {(g.session_id, g.position): (g.similarity, g.repetition) for g in similar.neighbours(found, spark.createDataFrame(list(goals.items()), "session_id string, text string"), 10).collect()}
    firsts = {(g.session_id, g.position): g.prior for g in similar.first_alike(found, 0.7).collect()}
    assert len(got) == len(rows)
    for s, i, phase, text in rows:
        v = brute_vector(text)
        near = [x[3] for x in rows if x[0] == s and x[2] == phase and x[1] < i][-10:]
        assert got[s, i] == pytest.approx((float(v @ brute_vector(goals[s])) if s in goals else 0.0, max((float(v @ brute_vector(t)) for t in near), default=0.0)), abs=1e-8)
        alike = [x[1] for x in rows if x[0] == s and x[1] < i and v @ brute_vector(x[3]) >= 0.7 - 1e-12]
        assert firsts.get((s, i)) == (alike[0] if alike else None)
    prompts = found.select("session_id", F.col("position").alias("prompt_index"), "text")
    pairs = {(p.session_id, p.i, p.j): p.similarity for p in similar.pairs(prompts).collect()}
    texts = {(s, i): t for s, i, _, t in rows}
    assert len(pairs) == 3 * 40 * 39 // 2
    assert all(v == pytest.approx(float(brute_vector(texts[s, i]) @ brute_vector(texts[s, j])), abs=6e-5) for (s, i, j), v in pairs.items())
    assert similar.matrix(prompts).count() == 3 * 1600
    steps = {(p.session_id, p.prompt_index): p.similarity for p in similar.steps(prompts).collect()}
    assert steps == {(s, j): v for (s, i, j), v in pairs.items() if j == i + 1}


@pytest.mark.parametrize("block", [3, 17, 2048])
def test_thresholded_pairs_equal_all_pairs(spark, block):
    r = random.Random(block)
    words = ["parser", "token", "test", "Ünï", "a", "fix", "the", "span"]
    rows = [(s, i, None if r.random() < 0.03 else " ".join(r.choices(words, k=r.choice([0, 1, 3, 9, 30])))) for s in ("x", "y", None) for i in range(60)]
    rows += [("x", 60 + i, "hot copy of one text") for i in range(30)] + [("z", 0, "alone")]
    prompts = spark.createDataFrame(rows, "session_id string, prompt_index long, text string").repartition(5)
    named = prompts.where("session_id IS NOT NULL")
    all_ = [(p.session_id, p.i, p.j, p.similarity) for p in similar.pairs(named).collect()]
    for threshold in (0.75, 0.3, 1.0):
        near = sorted(p for p in all_ if p[3] >= threshold)
        assert sorted((p.session_id, p.i, p.j, p.similarity) for p in similar.alike_pairs(named, threshold, block).collect()) == near
        assert sorted((p.session_id, p.prompt_index) for p in similar.alike(named, threshold, block).collect()) == sorted({(s, k) for s, i, j, _ in near for k in (i, j)})
    first = {}
    for s, i, j, v in sorted(all_):
        if v >= 0.8 and (s, j) not in first:
            first[s, j] = i
    assert {(p.session_id, p.position): p.prior for p in similar.first_alike(named.withColumnRenamed("prompt_index", "position"), 0.8, block).collect()} == first


def test_blocks_of_unlike_lengths_do_not_meet(spark):
    short = [("s", i, f"{i:03d} {'abcdefghij'[i % 10] * 2}") for i in range(100)]
    long = [("s", 100 + i, "".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(8))) for i in range(100)]
    rows = spark.createDataFrame(short + long, "session_id string, first long, text string")
    units = similar._units(rows, 0.85, 20)
    met = units.select("a", "b").distinct().count()
    assert 10 <= met < 45  # of 55


def test_large_sessions_stream(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("position"), F.lit("generation").alias("phase"), F.concat(F.lit("step "), F.md5(F.col("id").cast("string"))).alias("text"), F.lit(1).cast("long").alias("token_count"))
    out = similar.neighbours(rows, spark.createDataFrame([("s", "step")], "session_id string, text string"), 10)
    assert out.agg(F.count("*"), F.max("repetition")).first()[0] == n
    assert patterns.restatements(rows).count() == 0
    thoughts = rows.select("session_id", "position", F.when(F.col("position") % 1000 == 999, "generation").otherwise("reasoning").alias("phase"), F.lit(600).cast("long").alias("token_count"))
    found = patterns.verbose_thinking(thoughts.withColumn("token_count", F.when(F.col("phase") == "generation", 1).otherwise(600).cast("long")))
    assert found.count() == n - n // 1000


def test_trigram_cosine(spark):
    from collections import Counter

    r = random.Random(2)
    texts = ["", "ab", "abc", "aaaa", "Ab cab", *("".join(r.choice("abcd") for _ in range(r.randint(3, 40))) for _ in range(20))]
    rows = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.trigram_cosine(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        ca, cb = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (x.a, x.b))
        if x.a == x.b:
            want = 1.0
        elif not x.a or not x.b:
            want = 0.0
        elif not ca or not cb:
            want = 1.0
        else:
            want = sum(ca[g] * cb[g] for g in ca) / math.sqrt(sum(v * v for v in ca.values()) * sum(v * v for v in cb.values()))
        assert x.s == pytest.approx(want), (x.a, x.b)
    long = "abcdefghij" * 2000
    assert value(spark, T.trigram_cosine(F.lit(long), F.lit(long + "x"))) > 0.99


def test_custom_cost_model(spark):
    m = spark.createDataFrame([("s", "assistant", 1_000_000, 2_000_000, 3_000_000, 4_000_000)], "session_id string, role string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long")
    rates = parse_cost_model("1,2,3,4")
    assert economics.usage(m, rates).first().cost_usd == pytest.approx(1 * 1 + 2 * 2 + 4 * 3 + 3 * 4)
    s = spark.createDataFrame([("s", 0, "generation", "assistant", "over_explanation", False, 100), ("s", 1, "tool_use", "user", "unnecessary_tool_call", False, 50)], "session_id string, position long, phase string, source_role string, label string, aligned boolean, token_count long")
    none = spark.createDataFrame([], "session_id string, pattern_type string, tokens_wasted long")
    scale = spark.createDataFrame([("s", 2.5)], "session_id string, calibration double")
    got = {r.source: (r.pricing, r.cost_usd) for r in economics.waste_breakdown(s, none, rates, scale).collect()}
    assert got == {"over_explanation": ("output", pytest.approx(100 * 2.5 * 2 / 1e6)), "user_side": ("input", pytest.approx(50 * 1 / 1e6))}
    w = economics.cost_weighted(s.withColumn("aligned", F.lit(True)).withColumn("category", F.lit("input")), rates, spark.createDataFrame([("s", 1000, 2000)], "session_id string, cache_read_tokens long, cache_creation_tokens long")).first()
    assert w.total_cost_usd == pytest.approx((150 + 3000 + 8000) / 1e6) and w.cost_weighted_ter == 1.0


def test_hierarchy_and_strategies(spark):
    p = spark.createDataFrame([("s", 0, "fix the parser"), ("s", 1, "write the docs"), ("t", 0, "only one")], "session_id string, prompt_index long, text string")
    spans_ = spark.createDataFrame([("s", 0, "docs written"), ("s", 1, "parser fix"), ("t", 0, "one only")], "session_id string, position long, text string")
    got = {(r.session_id, r.position): (r.score, r.part) for r in intents.scores(spans_, p).collect()}
    for s, i, text, high, sub in (("s", 0, "docs written", "fix the parser", "write the docs"), ("s", 1, "parser fix", "fix the parser", "write the docs")):
        h, b = float(brute_vector(text) @ brute_vector(high)), float(brute_vector(text) @ brute_vector(sub))
        assert got[s, i] == (pytest.approx(0.7 * b + 0.3 * h, abs=1e-4), 1 if b >= h else None)
    assert got["t", 0][1] is None
    assert intents.strategy("hierarchical")(p).count() == 3 and intents.strategy("whole")(p).count() == 2 and intents.strategy("sliding")(p).count() >= 2
    with pytest.raises(ValueError):
        intents.strategy("other")
    told = intents.goals(lambda base: base.select("session_id", F.when(F.col("session_id") == "s", "ship it").alias("goal"), F.array(F.lit("one")).alias("steps"), F.array().cast("array<string>").alias("constraints")).where("goal IS NOT NULL"))
    assert {r.session_id: (r.text.strip(), r.confidence) for r in told(p).collect()} == {"s": ("ship it one", 0.95), "t": ("only one", 0.3)}


def test_embeddings_are_computed_once(spark, tmp_path):
    from spanforge.functions import embeddings

    path, marks = str(tmp_path / "cache"), tmp_path / "marks"
    marks.mkdir()
    folder = str(marks)

    def make():
        import os
        import uuid

        import numpy as np

        def encode(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)

        return encode

    seen = lambda: sorted(t for p in marks.iterdir() for t in p.read_text().split("\n"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["banana", "kiwi", "banana", "fig"])], "id long, text string")
    assert embeddings.cache_stats(spark, path).first().entries == 0
    got = {r.id: list(r.embedding) for r in embeddings.get_or_compute(rows, make, path, source="one", batch=1).collect()}
    assert got == {0: [6, 3], 1: [4, 0], 2: [6, 3], 3: [3, 0]} and seen() == ["banana", "fig", "kiwi"]
    more = rows.unionByName(spark.createDataFrame([(9, "papaya")], "id long, text string"))
    assert embeddings.get_or_compute(more, make, path).count() == 5 and seen() == ["banana", "fig", "kiwi", "papaya"]
    stats = embeddings.cache_stats(spark, path).first()
    assert stats.entries == 4 and stats.bytes > 0 and 0 <= stats.oldest_hours < 1
    embeddings.invalidate(spark, path, source="one")
    assert embeddings.cached(spark, path).count() == 1 and embeddings.cached(spark, path, 0.0).count() == 0
    assert embeddings.get_or_compute(rows, make, path).count() == 4 and seen().count("fig") == 2


def test_block_rules(spark):
    def raw(content):
        import json

        return json.dumps({"type": "user", "uuid": "u", "sessionId": "s", "message": {"role": "user", "content": content}})

    rows = [raw([{"type": "text"}, {"type": "tool_use", "name": "x"}, {"type": "odd"}, 5, {"text": "t"}, {"type": "tool_result"}, {"type": "text", "text": 7}, {"type": "thinking"}]), raw(7), "[1]", '{"type":"user","uuid":"u","sessionId":"s","message":3}', raw([{"type": "text", "text": "fine"}]).replace('"role": "user"', '"role": "robot"')]
    got = {r.line_no: (list(r.errors), list(r.warnings)) for r in quality.lines(spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "session_id string, line_no int, raw string")).collect()}
    assert got[0] == (["content[0] lacks text", "content[1] lacks id", "content[4] lacks type", "content[5] lacks tool_use_id", "content[6] has a text that is no string"], ["content[2] has an unknown type", "content[3] is no object", "content[7] lacks thinking"])
    assert got[1][0] == ["content is neither a string nor a list"] and got[2][0] == ["no JSON object"] and got[3][0] == ["message is no object"]
    assert got[4] == ([], ["unexpected role"])


def test_registry():
    class Mine:
        name = "mine"

        def detect(self, spans):
            return spans

    REGISTRY.reset()
    first = REGISTRY.register("detector", Mine())
    REGISTRY.register("detector", Mine())
    assert REGISTRY.of["detector"]["mine"] is first
    with pytest.raises(TypeError):
        REGISTRY.register("formatter", Mine())
    REGISTRY.reset()


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    lines = [("s", 0, None, "user", "text", "fix the parser test"), ("s", 1, "r1", "assistant", "text", "the parser test is fixed now"), ("s", 2, "r1", "assistant", "text", "repeated"), ("s", 3, "r2", "assistant", "text", "zzz qqq www"), ("s", 4, None, "user", "tool_result", "ignored"), ("s", 5, "r3", "assistant", "tool_use", "parser test fix")]
    folder = tmp_path / "landing"
    want, intent, total, good = [], {}, 0, 0
    for _, seq, _, role, kind, text in lines:
        if role == "user":
            if kind == "text":
                intent = live.counts_of(text)
        elif seq != 2:
            n = max(1, len(text) // 4)
            total, good = total + n, good + (n if live.similarity(live.counts_of(text), intent) >= live.THRESHOLD else 0)
            want.append((seq, total, good))
    for part in (lines[:3], lines[3:]):
        spark.createDataFrame(part, live.LINE).coalesce(1).write.mode("append").parquet(str(folder))
        stream = live.live(spark.readStream.schema(live.LINE).parquet(str(folder)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = [(r.msg_seq, r.total_tokens, r.aligned_tokens) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("msg_seq").collect()]
    assert got == want
    told = []
    assert live.watch(spark, str(folder), str(tmp_path / "cp2"), told.append, None, "parquet").awaitTermination(120)
    assert [(t["msg_seq"], t["total_tokens"], t["aligned_tokens"]) for t in told] == want and all("warning" in t and "healthy" in t for t in told)
    values = [t["ter"] for t in told]
    assert (told[-1]["drift"], told[-1]["direction"]) == live.drift_of(values)


def test_drift_of_values_equals_the_window(spark):
    r = random.Random(3)
    values = [round(r.random(), 4) for _ in range(14)]
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, msg_seq long, ter double")
    got = [(x.drift, x.direction) for x in live.drift(rows).orderBy("msg_seq").collect()]
    assert got == [(pytest.approx(live.drift_of(values[: i + 1])[0], abs=2e-6), live.drift_of(values[: i + 1])[1]) for i in range(14)]


def test_keywords_without_stop_words(spark):
    prompts = spark.createDataFrame([("s", 0, "The parser and the re-parser"), ("s", 1, "fix the parser for it"), ("t", 0, "to the")], "session_id string, prompt_index long, text string")
    found = reasoning.keywords(prompts, "session_id")
    assert {(r.session_id, r.word, r.n, r["rank"]) for r in found.collect()} == {("s", "parser", 3, 1), ("s", "fix", 1, 2)}
    spoken = spark.createDataFrame([("s", 0, "the parser works"), ("s", 1, "something else"), ("t", 0, "anything")], "session_id string, position long, text string")
    told = reasoning.quick_labels(spoken, found, threshold=0.5).collect()
    assert {(r.session_id, r.position): r.aligned for r in told} == {("s", 0): True, ("s", 1): False, ("t", 0): True}


def test_explained_shares_round_half_to_even(spark):
    wasted = {"a": (1298, 4000, "32.4"), "b": (1302, 4000, "32.6"), "c": (161, 2000, "8.0"), "d": (163, 2000, "8.2"), "e": (1, 3, "33.3")}
    rows = [(s, i, n, i == 1, "over_explanation", "generation") for s, (w, of, _) in wasted.items() for i, n in enumerate((w, of - w))]
    spans_ = spark.createDataFrame(rows, "session_id string, position long, token_count long, aligned boolean, label string, phase string")
    none = spark.createDataFrame([], "session_id string, pattern_type string, start_position long, detail string, tokens_wasted long")
    told = {r.session_id: r.explanation for r in patterns.explanations(spans_, none).collect()}
    assert {s: told[s].split("(")[1].split(" %")[0] for s in wasted} == {s: share for s, (_, _, share) in wasted.items()}
