"""Labels by a caller's model, against labels worked out by hand."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import embeddings
from spanforge.operators import similar
from spanforge.plans import analyze

#: What the model of these tests makes of a text.
VECTORS = {"fix parser": [1, 0, 0], "about it": [0.6, 0.8, 0], "again": [0.59, 0.81, 0], "nearly": [0.5, 0.85, 0.1], "off": [0, 0, 1], "Read": [0, 1, 0], "parser": [1, 0.1, 0], "zero": [0, 0, 0]}


def model(folder):
    def make():
        import uuid

        def encode(texts):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(texts))
            return np.array([VECTORS.get(t, VECTORS.get((t.split() or [t])[0], [0, 0, 1])) for t in texts], np.float32)

        return encode

    return make


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


@pytest.fixture
def project(tmp_path):
    said = [("user", "fix parser"), ("thinking", "about it"), ("text", "parser"), ("thinking", "again"), ("thinking", "off"), ("tool_use", "Read"), ("thinking", "nearly"), ("text", "off " * 60), ("text", "zero"), ("thinking", "about it")]
    (tmp_path / "p").mkdir()
    with open(tmp_path / "p" / "s.jsonl", "w") as f:
        for k, (kind, text) in enumerate(said):
            block = {"type": kind, "name": "Read", "input": {"file_path": "x"}} if kind == "tool_use" else {"type": kind, "text": text, "thinking": text}
            f.write(json.dumps({"type": "user" if kind == "user" else "assistant", "sessionId": "s", "message": {"role": "user" if kind == "user" else "assistant", "content": text if kind == "user" else [block], **({} if kind == "user" else {"requestId": f"r{k}"})}}) + "\n")
    (tmp_path / "seen").mkdir()
    return str(tmp_path / "p"), str(tmp_path / "seen")


def labels(a):
    return [(r.phase, r.label, round(r.confidence, 4), round(r.similarity, 4)) for r in a.labelled.orderBy("position").collect()]


def test_labels_by_a_model(spark, project, tmp_path):
    folder, seen = project
    a = analyze.transcripts_at(spark, folder, dense=analyze.Dense(model(seen), str(tmp_path / "cache")))
    intent = VECTORS["fix parser"]
    s = {k: cos(v, intent) for k, v in VECTORS.items()}
    again = cos(VECTORS["about it"], VECTORS["again"])
    nearly = max(cos(VECTORS["nearly"], VECTORS[k]) for k in ("about it", "again"))
    want = [
        ("generation", "aligned_generation", 1.0, 1.0),  # the prompt's own text
        ("reasoning", "aligned_reasoning", max(0.5, s["about it"]), s["about it"]),
        ("generation", "over_explanation", cos(VECTORS["parser"], intent), s["parser"]),  # like the prompt's
        ("reasoning", "redundant_reasoning", again, s["again"]),
        ("reasoning", "redundant_reasoning", 0.5, 0.0),  # short and off the intent
        ("tool_use", "aligned_tool_use", 0.6, 0.0),
        ("reasoning", "redundant_reasoning", nearly, s["nearly"]),
        ("generation", "over_explanation", 0.4, 0.0),  # long and off the intent
        ("generation", "aligned_generation", 0.5, 0.0),  # a zero vector is like none
        ("reasoning", "redundant_reasoning", 1.0, s["about it"]),
    ]
    assert labels(a) == [(p, x, pytest.approx(c, abs=2e-4), pytest.approx(v, abs=2e-4)) for p, x, c, v in want]
    texts = lambda: sorted(t for p in os.listdir(seen) for t in open(os.path.join(seen, p)).read().split("\n"))
    before = texts()
    assert len(before) == len(set(before)) and "about it" in before
    labels(analyze.transcripts_at(spark, folder, dense=analyze.Dense(model(seen), str(tmp_path / "cache"))))
    assert texts() == before  # all from the cache


def test_merged_and_short_spans(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    rows = [("s", 0, "reasoning", "one", 20), ("s", 1, "reasoning", "tiny", 2), ("s", 2, "reasoning", "two", 20), ("s", 3, "generation", "three", 20), ("s", 4, "reasoning", "four", 20), ("t", 0, "reasoning", "five", 20), ("t", 1, "generation", None, 20)]
    spans = spark.createDataFrame(rows, "session_id string, position long, phase string, text string, token_count long")
    make = model(str(tmp_path / "seen"))
    got = embeddings.embed_spans(spans, make, least=10, merge=True)
    own = {(r.session_id, r.position): r.embedding for r in got.collect()}
    assert [k for k, v in sorted(own.items()) if v is None] == [("s", 1)]
    texts = sorted(t for p in os.listdir(tmp_path / "seen") for t in open(tmp_path / "seen" / p).read().split("\n"))
    assert texts == ["", "five", "four", "one two", "three"]
    plain = {(r.session_id, r.position): r.embedding for r in embeddings.embed_spans(spans, make).collect()}
    assert plain["t", 1] is None and len(plain) == 7


def test_window_of_dense_vectors(spark):
    r = np.random.default_rng(3)
    rows = [("s", i, ["a", "b"][i % 2], None if i % 7 == 3 else [float(x) for x in r.normal(size=5)]) for i in range(60)]
    spans = spark.createDataFrame(rows, "session_id string, position long, phase string, embedding array<float>")
    goals = spark.createDataFrame([("s", [1.0, 0.0, 0.0, 0.0, 0.0])], "session_id string, embedding array<float>")
    got = {x.position: (x.similarity, x.repetition) for x in similar.dense_neighbours(spans, goals, 4).collect()}
    for _, i, phase, v in rows:
        before = [x[3] for x in rows if x[2] == phase and x[1] < i][-4:]
        best = max([0.0, *(cos(np.float32(v), np.float32(b)) for b in before if b)]) if v else 0.0
        assert got[i] == (pytest.approx(cos(np.float32(v), [1, 0, 0, 0, 0]) if v else 0.0, abs=1e-6), pytest.approx(best, abs=1e-6))


def test_null_texts_keep_their_rows(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    rows = spark.createDataFrame([(1, "off"), (2, None), (3, "off")], "id long, text string")
    make = model(str(tmp_path / "seen"))
    for got in (embeddings.get_or_compute(rows, make, str(tmp_path / "c")), embeddings.embed_once(rows, make), embeddings.embed(rows, make)):
        assert {x.id: x.embedding and list(x.embedding) for x in got.select("id", F.col("embedding")).collect()} == {1: [0, 0, 1], 2: None, 3: [0, 0, 1]}
