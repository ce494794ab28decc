"""Quality by positive-unlabelled learning.

A small network is trained to minimise the non-negative unbiased risk: trusted positives stand for good text,
unlabelled web text for the mixture, and the class prior says how much of the mixture is good. The prior is estimated
from the same data: where a first network is surest, the unlabelled texts are the good ones, and the share of
unlabelled texts beyond a score, over the share of positives beyond it, nowhere falls below the prior.

Features are shares of bytes and words, so long texts count like short ones; they are taken of whole texts. The
network is fitted on at most ``positive_rows`` positives and ``unlabelled_rows`` unlabelled documents, none of them
held out. Defined results: null and empty texts have the features of no words; without any positive, every score is 0;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import documents, held_out, table, through_python
from spanforge.llm.labelled import draw, sample, with_texts

POSITIVE_ROWS, UNLABELLED_ROWS, THRESHOLD = 8000, 12000, 0.3
HIDDEN, ROUNDS, STEP = 12, 1500, 0.02

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_WORD_MARKS = b".,;:'\"()-"
N_FEATURES = 14


def features(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    upper, lower, digit = (int(count[s].sum()) for s in (_UPPER, _LOWER, _DIGIT))
    marks = int(count[list(_WORD_MARKS)].sum())
    symbols = int(count[33:127].sum()) - upper - lower - digit - marks
    breaks = int(count[10])
    lines = text.split("\n")
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    high = int(count[128:].sum())
    return [
        1.0,
        upper / max(1, upper + lower),
        digit / n,
        marks / n,
        symbols / n,
        int(count[33]) / m,
        int(count[124]) / m,
        int(count[[35, 36, 37, 38, 42]].sum()) / m,
        repeated / m,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        breaks / m,
        1 - len(set(lines)) / len(lines),
        min(n / m, 30.0) / 10,
        high / n,
    ]


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5, rounds: int = ROUNDS) -> Network:
    """The network of least non-negative risk: prior * loss of positives as good, and the loss of unlabelled as bad
    less prior * that of positives as bad, which can't be less than 0; where it is, a step raises it again."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-6, [rng.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(())])
    x = (both - net.mean) / net.scale
    n, k = len(positive), len(both)
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in net.w]
    for t in range(1, rounds + 1):
        a, b, c, d = net.w
        h = np.tanh(x @ a + b)
        z = h @ c + d
        bad = _softplus(z[n:]).mean() - prior * _softplus(z[:n]).mean()
        dz = np.zeros(k)
        if bad >= 0:
            dz[:n] = prior / n * (_sigmoid(z[:n]) - 1) - prior / n * _sigmoid(z[:n])
            dz[n:] = _sigmoid(z[n:]) / (k - n)
        else:
            dz[:n] = prior / n * _sigmoid(z[:n])
            dz[n:] = -_sigmoid(z[n:]) / (k - n)
        dh = np.outer(dz, c) * (1 - h * h)
        gradients = [x.T @ dh + 1e-4 * a, dh.sum(0), h.T @ dz + 1e-4 * c, dz.sum()]
        for w, g, m in zip(range(4), gradients, moment, strict=True):  # Adam
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            net.w[w] = net.w[w] - STEP * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least, over thresholds that at least a tenth of the positives reach, of the unlabelled share beyond it over
    the positives' share. Scores come from networks that haven't seen the rows."""
    scores: list[list[np.ndarray]] = [[], []]
    for fold in range(2):
        net = fit(positive[fold::2], unlabelled[fold::2], 0.5, rounds=ROUNDS // 3)
        for kept, rows in zip(scores, (positive, unlabelled), strict=True):
            kept.append(net(rows[1 - fold :: 2]))
    p, u = (np.sort(np.concatenate(s)) for s in scores)
    if not len(p) or not len(u):
        return 0.5
    least = 1.0
    for q in np.linspace(0.02, 0.9, 45):
        cut = p[int(q * (len(p) - 1))]
        sp, su = (p >= cut).mean(), (u >= cut).mean()
        if sp >= 0.1:
            least = min(least, su / sp)
    return float(min(max(least, 0.05), 0.98))


def _features(rows: DataFrame) -> DataFrame:
    """text is replaced by an array of its features."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    at, rest = rows.columns.index("text"), [i for i, c in enumerate(rows.columns) if c != "text"]
    names = [f.name for f in others] + ["features"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = pa.array([features(t.as_py() or "") for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), got], names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["features array<double>"])
    return through_python(rows, batches, schema)


def _matrix(rows: DataFrame) -> np.ndarray:
    got = _features(rows.select("text")).toPandas().features
    return np.array([*map(list, got)], float).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, seed: int = 7) -> tuple[Network | None, float]:
    """The network and the prior. docs: doc_id and text."""
    positive = _matrix(with_texts(docs, sample(labels, label, positive_rows, seed).where("label = 1")))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    loose = ids.join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("u", draw(F.col("doc_id"), seed))
    share = min(1.0, unlabelled_rows / max(1, loose.count()))
    unlabelled = _matrix(with_texts(docs, loose.where(F.col("u") < share).select("doc_id", F.lit(0).alias("label"), "u")))
    if len(positive) < 4 or len(unlabelled) < 4:
        return None, 0.0
    prior = estimate_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior), prior


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    held = rows.sparkSession.sparkContext.broadcast(net)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array([features(t.as_py() or "") for t in batch.column(1)], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(held.value(x)))], ["doc_id", "score"])

    return through_python(rows, batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    net, _ = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
