"""Toxicity by class-conditional Kneser-Ney models.

Two models of word n-grams up to ``ORDER``, one of toxic and one of ordinary documents. An n-gram counts as often as
different words stand before it (Kneser-Ney), the longest ones too, so that many copies of one text are no more evidence
than the text. Each order takes a discount off every count and hands what is left to the order below; below the single words stand the words of both classes together, shared. So an
expression that is too rare to tell anything is judged by shared counts, which favour neither class.

The discount is estimated: of ``DISCOUNTS``, the one whose models part those documents best that they have not seen. A
gram whose counts do not exceed the discount gives all of its mass away and scores as if it had never been seen; such
grams are left out, which changes nothing.

Most words of a toxic document are ordinary ones. So its two log-likelihoods are compared, divided by length, over each
of its passages of ``PASSAGES`` words and over the whole; the highest ratio of each length is its evidence. Within a
passage, evidence for either class counts in full. A logistic curve, fitted on labelled documents that the models have
not seen, makes a score of it.

The models are fitted on all labelled documents, whole texts, but on no held-out row: ``FITTED_SHARE`` of the texts are
counted, and discount and curve are chosen on the others (equal texts are on one side). N-grams are counted by Spark,
models are made by joins of what exceeds the least discount and written by tasks to the shared checkpoint folder, from
which workers map them; the driver sees none of it. The curve's Newton steps add up sums that tasks make. Scoring
reads every word of every text. Words and n-grams are named by 64-bit hashes. Defined results: null and empty texts and texts without letters get the curve's value at zero evidence; repeated
rows and ties get equal scores; with labels of one class only, every score is that class's share; without labels every
score is 0; columns of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from spanforge.llm.common import cut, documents, held_out, removed, shared_folder, table, through_python
from spanforge.llm.hashing import U, mix
from spanforge.llm.labelled import known_labels, labelled_texts
from spanforge.llm.stored_table import StoredTable, stored

FITTED_SHARE, ORDER, THRESHOLD = 0.75, 2, 0.5
#: Discounts to choose from; the first one bounds what the models hold.
DISCOUNTS = (2.0, 4.0, 8.0, 16.0)
#: Words of a passage; whole documents are compared too.
PASSAGES = (1, 4, 16)
#: Characters that are worked on at once, if no single text is longer.
BLOCK = 1 << 19
#: The same where grams are counted: equal ones of a block move once.
COUNTED = 1 << 22
#: Tables up to so many rows of two numbers are broadcast.
SMALL_ROWS = 1 << 20
_BEGIN = U(0x2545F4914F6CDD1D)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words (runs of letters, lower-cased), and where each text's words begin, with the end."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0))  # the text ends with no letter
    begins, sizes = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0)
    inside = at - np.repeat(ends - sizes, sizes)
    each = mix(points[np.repeat(begins, sizes) + inside].astype(U) | (inside + 1).astype(U) << U(32))
    hashes = mix(np.add.reduceat(each, ends - sizes)) if len(ends) else np.zeros(0, U)
    return hashes, np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in lowered)]))


def gram_of(found: list[np.ndarray]) -> np.ndarray:
    """As grams() has it; found: the last word, the one before it, and so on."""
    out = found[0]
    for n, before in enumerate(found[1:], 1):
        out = mix(out * U(3) ^ mix(before + U(n)))
    return out


def grams(word: np.ndarray, of: np.ndarray, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For n from 1 to order: the gram of n words that ends at each word, and its context, the gram without that word.
    Before a text's first word stands a mark."""
    nth = np.arange(len(word)) - np.repeat(of[:-1], np.diff(of))
    found, contexts, before = [word], [np.zeros(len(word), U)], word
    for n in range(1, order):
        contexts.append(np.where(nth == 0, gram_of([np.array([_BEGIN])] * n), np.roll(found[-1], 1)))
        before = np.where(nth < n, _BEGIN, np.roll(before, 1))
        found.append(mix(found[-1] * U(3) ^ mix(before + U(n))))
    return found, contexts


def _blocks(it: Iterator[pa.RecordBatch], text_at: int, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of batches with their texts, about most characters each."""
    for batch in it:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        begin = size = 0
        for i, t in enumerate(texts):
            if i > begin and size + len(t) > most:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


@dataclass
class Counts:
    """What the models are made of, in the shared folder. grams, by order from 1: words from the last one (w1, w2, ...), toxic
    and ordinary (counts). Every gram with a count above some least one is there, with all shorter ones that its probability
    needs. contexts, by order from 2: the words, totals toxic and ordinary, and toxic_rest and ordinary_rest, the part that
    grams which are not there have. single has the same of single words."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    single: dict[str, int]
    kinds: int  # different words of all texts
    folder: str


@dataclass
class Models:
    """Log-likelihood ratios, toxic to ordinary, in back-off form: a gram that is there has its own, another one its
    context's back-off plus that of the shorter gram, at last ``unseen``. The tables have a column for each discount."""

    ratios: list[StoredTable]
    backoffs: list[StoredTable]  # of contexts, for grams of two words and more
    unseen: float
    column: int = 0

    def of_words(self, word: np.ndarray, of: np.ndarray) -> np.ndarray:
        found, contexts = grams(word, of, len(self.ratios))
        out = self.ratios[0].get(found[0], self.unseen, self.column)
        for n in range(1, len(self.ratios)):
            out = out + self.backoffs[n - 1].get(contexts[n], 0.0, self.column)
            out = self.ratios[n].get(found[n], out, self.column)
        return out


def _left(totals: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """The mass that a context leaves to the order below."""
    return np.where(totals > 0, taken / np.maximum(totals, 1), 1.0)


def _backoff(left: np.ndarray) -> np.ndarray:
    # A class that leaves nothing to the order below gives a new gram no more than this.
    return np.log(np.maximum(left[0], 1e-9)) - np.log(np.maximum(left[1], 1e-9))


def fits(counts: Counts, discounts: Sequence[float]) -> list[Models]:
    """A model for each discount, one for all orders and both classes. Counts meet those of their contexts and of shorter
    grams by joins, and tasks write the ratios to the shared folder: nothing that grows with the texts reaches the driver."""
    k, kinds, single = len(discounts), counts.kinds, counts.single
    classes = ("toxic", "ordinary")
    taken_of = lambda n: [f"{c}_taken{n}_{i}" for i in range(k) for c in classes]
    taken_sums = [F.sum(F.least(F.col(c), F.lit(d))) for d in discounts for c in classes]
    first = np.array(counts.grams[0].agg(*(F.coalesce(x, F.lit(0.0)) for x in taken_sums)).first(), float).reshape(k, 2, 1)
    totals1 = np.array([[single[c]] for c in classes], float)
    left1 = [_left(totals1, np.array([[single[f"{c}_rest"]] for c in classes], float) + t) for t in first]
    both = max(totals1.sum(), 1)

    def ratios(n: int, seen: list[np.ndarray], totals: list[np.ndarray], taken: list[np.ndarray]) -> list[np.ndarray]:
        """By discount, of grams of n words; of shorter ones likewise, by order: counts, and from order 2 totals and taken."""
        out = []
        for i, d in enumerate(discounts):
            # Both classes' words; one count of each goes to all words evenly, an unknown one among them.
            p = np.maximum(seen[0].sum(0) - 1, 0) / both + kinds / both / (kinds + 1)
            p = np.where(totals1 > 0, np.maximum(seen[0] - d, 0) / np.maximum(totals1, 1), 0.0) + left1[i] * p
            for m in range(1, n):
                p = np.where(totals[m] > 0, np.maximum(seen[m] - d, 0) / np.maximum(totals[m], 1), 0.0) + _left(totals[m], taken[m][i]) * p
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(np.where((seen[-1] > d).any(0), np.log(p[0]) - np.log(p[1]), np.nan))
        return out

    def made(table: int, key: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
        some = ~np.isnan(values).all(0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), table)), pa.array(key[some].view(np.int64)), *(pa.array(v[some]) for v in values)], ["table", "key", *(f"v{i}" for i in range(k))])

    def of_grams(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                column = {c: batch.column(c).to_numpy() for c in batch.schema.names}
                seen = [np.stack([column[f"{c}{m}"] for c in classes]).astype(float) for m in range(1, n + 1)]
                totals = [totals1, *(np.stack([column[f"{c}_total{m}"] for c in classes]).astype(float) for m in range(2, n + 1))]
                taken = [first, *(np.stack([column[c] for c in taken_of(m)]).reshape(k, 2, -1) for m in range(2, n + 1))]
                yield made(n - 1, gram_of([column[f"w{i}"].view(U) for i in range(1, n + 1)]), ratios(n, seen, totals, taken))

        return batches

    def of_contexts(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                column = {c: batch.column(c).to_numpy() for c in batch.schema.names}
                totals = np.stack([column[f"{c}_total{n}"] for c in classes]).astype(float)
                taken = np.stack([column[c] for c in taken_of(n)]).reshape(k, 2, -1)
                yield made(order + n - 2, gram_of([column[f"w{i}"].view(U) for i in range(2, n + 1)]), [_backoff(_left(totals, t)) for t in taken])

        return batches

    schema = "table long, key long, " + ", ".join(f"v{i} double" for i in range(k))
    order, shorter, of_n, of_c = len(counts.grams), None, [], []
    for n, g in enumerate(counts.grams, 1):
        own = [f"w{i}" for i in range(1, n + 1)]
        rows = g.select(*own, *(F.col(c).alias(f"{c}{n}") for c in classes))
        if shorter is not None:
            taken = g.groupBy(*own[1:]).agg(*(x.alias(c) for x, c in zip(taken_sums, taken_of(n), strict=True)))
            held = counts.contexts[n - 2].join(taken, own[1:]).select(
                *own[1:],
                *(F.col(c).alias(f"{c}_total{n}") for c in classes),
                *((F.col(t) + F.col(f"{t.partition('_')[0]}_rest")).alias(t) for t in taken_of(n)),
            )
            of_c.append(through_python(held, of_contexts(n), schema))
            rows = rows.join(shorter, own[:-1]).join(held, own[1:])
        of_n.append(through_python(rows, of_grams(n), schema))
        shorter = rows
    every = [*of_n, *of_c]
    sizes = [x.count() for x in (*counts.grams, *counts.contexts)]
    folder = shared_folder(counts.grams[0].sparkSession, "toxicity-models")
    tables = stored(reduce(DataFrame.unionByName, every), sizes, k, folder)
    unseen = [float(_backoff(x)[0]) if totals1.any() else 0.0 for x in left1]
    return [Models(tables[:order], tables[order:], u, i) for i, u in enumerate(unseen)]


def fit(counts: Counts, d: float) -> Models:
    return fits(counts, (d,))[0]


def evidence(texts: list[str], *models: Models) -> np.ndarray:
    """For each text, the highest length-normalised log-likelihood ratio of its passages of each length, and the whole's; by
    each of the models, one after the other."""
    word, of = words(texts)
    return np.concatenate([_evidence_of(m.of_words(word, of), of) for m in models], 1)


def _evidence_of(ratios: np.ndarray, of: np.ndarray) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(ratios)]
    sizes, out = np.diff(of), np.zeros((len(of) - 1, len(PASSAGES) + 1))
    some = np.flatnonzero(sizes)
    whole = (sums[of[1:]] - sums[of[:-1]])[some] / sizes[some]
    out[some, -1] = whole
    for i, size in enumerate(PASSAGES):
        out[some, i] = whole  # of texts that are no longer than a passage
        longer = np.flatnonzero(sizes >= size)
        if len(longer):
            each = (sums[size:] - sums[:-size]) / size
            # Passages that begin in a text and end in it; bounds alternate between those and what lies between texts.
            bounds = np.stack([of[longer], of[longer] + sizes[longer] - size + 1], 1).ravel()
            out[longer, i] = np.maximum.reduceat(np.r_[each, -np.inf], np.minimum(bounds, len(each)))[::2]
    return out


def _summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """What sums gives for all rows' labels and evidence, as it is for none: an array for each partition reaches the driver."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in it:
            if batch.num_rows:
                y = batch.column(0).to_numpy().astype(float)
                total += sums(y, batch.column(1).flatten().to_numpy().reshape(len(y), -1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = [np.frombuffer(r.sums) for r in through_python(rows.select("label", "evidence"), batches, "sums binary").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(size)


def curves_of(rows: DataFrame, models: int, ridge: float = 1e-2, rounds: int = 60) -> tuple[list[tuple[np.ndarray, float]], tuple[float, float]]:
    """For each of the models a logistic curve: weights of its evidence, with the constant last, and the mean loss, classes
    weighing alike; and how many rows either label has. rows: label, evidence (of all models, one after the other). Without
    both labels there are no curves."""
    k = len(PASSAGES) + 1
    width = models * k
    first = _summed(rows, lambda y, x: np.r_[(y == 0).sum(), (y == 1).sum(), x.sum(0)], 2 + width)
    sizes = first[:2]
    if not sizes.all():
        return [], (sizes[0], sizes[1])
    mean = first[2:] / sizes.sum()
    scale = np.sqrt(_summed(rows, lambda y, x: ((x - mean) ** 2).sum(0), width) / sizes.sum()) + 1e-9
    each = 0.5 * sizes.sum() / sizes
    weights = np.zeros((models, k + 1))
    part = (k + 1) + (k + 1) ** 2 + 1

    def sums(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = ((x - mean) / scale).reshape(len(y), models, k)
        out = []
        for m, w in enumerate(weights):
            zm = np.c_[z[:, m], np.ones(len(y))]
            p = 1 / (1 + np.exp(-np.clip(zm @ w, -30, 30)))
            by = np.where(y == 1, each[1], each[0])
            loss = -np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12)) / np.where(y == 1, sizes[1], sizes[0])
            out += [zm.T @ (by * (p - y)), ((zm * (by * p * (1 - p))[:, None]).T @ zm).ravel(), [loss.sum()]]
        return np.concatenate(out)

    for _ in range(rounds):  # Newton steps, of all models at once
        found = _summed(rows, sums, models * part).reshape(models, part)
        losses = found[:, -1]
        steps = [np.linalg.solve(f[k + 1 : -1].reshape(k + 1, k + 1) + (ridge + 1e-9) * np.eye(k + 1), f[: k + 1] + ridge * w) for f, w in zip(found, weights, strict=True)]
        if np.abs(steps).max() < 1e-6:
            break
        weights = weights - steps
    slopes = weights[:, :-1] / scale.reshape(models, k)
    constants = weights[:, -1] - (slopes * mean.reshape(models, k)).sum(1)
    return [(np.r_[s_, c], float(loss)) for s_, c, loss in zip(slopes, constants, losses, strict=True)], (sizes[0], sizes[1])


def _distinct(back: list[np.ndarray], toxic: np.ndarray, ordinary: np.ndarray) -> list[np.ndarray]:
    """Different grams, by their last words, and whether each label has them."""
    by = np.lexsort(back[::-1])
    back = [x[by] for x in back]
    first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in back], axis=0)])
    return [*(x[first] for x in back), *(np.logical_or.reduceat(x[by], first) for x in (toxic, ordinary))]


def _pieces(found: list[np.ndarray], order: int, buckets: int) -> pa.RecordBatch:
    """(bucket, piece): of each column of words but the last one, where a value begins and the values; 32 bits of the last
    one; the labels as bits."""
    bucket = (mix(found[0] + (found[order - 1] & U(7))) % U(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    found, bucket = [x[by] for x in found], bucket[by]
    bounds = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
    pieces = []
    for a, b in zip(bounds, [*bounds[1:], len(bucket)], strict=True):
        out = [np.array([b - a], np.int32)]
        for x in found[:order]:
            new = np.r_[True, x[a + 1 : b] != x[a : b - 1]]
            out += [np.packbits(new), x[a:b][new]]
        out += [found[order][a:b].astype(np.uint32), *(np.packbits(x[a:b]) for x in found[order + 1 :])]
        pieces.append(b"".join(x.tobytes() for x in out))
    return pa.RecordBatch.from_arrays([pa.array(bucket[bounds]), pa.array(pieces, pa.binary())], ["bucket", "piece"])


def _unpacked(piece: bytes, order: int) -> list[np.ndarray]:
    """The columns of a piece."""
    n, at, out = int(np.frombuffer(piece, np.int32, 1)[0]), 4, []

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(piece, kind, count, at)
        at += x.nbytes
        return x

    bits = lambda: np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool)
    for _ in range(order):
        new = bits()
        out.append(take(U, int(new.sum()))[np.cumsum(new) - 1])
    return [*out, take(np.uint32, n).astype(U), bits(), bits()]


def _kinds(held: list[list[np.ndarray]], order: int) -> pa.RecordBatch:
    """A bucket's grams without the first word: words from the last one, and how many words each label has before them."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    found = _distinct(columns[: order + 1], *columns[order + 1 :])
    first = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in found[:order]], axis=0)])
    counts = [np.add.reduceat(x.astype(np.int64), first) for x in found[order + 1 :]]
    return pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64)) for x in found[:order]), *map(pa.array, counts)], [*(f"w{i}" for i in range(1, order + 1)), "toxic", "ordinary"])


def count(texts: DataFrame, order: int = ORDER, least: float = DISCOUNTS[0]) -> Counts:
    """texts: (text, label)."""
    names = [f"w{i}" for i in range(1, order + 2)]  # a gram's words, from the last one

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _blocks(it, 0, COUNTED):
            word, of = words(part)
            nth = np.arange(len(word)) - np.repeat(of[:-1], np.diff(of))
            back = [word]
            for n in range(1, order + 1):
                back.append(np.where(nth < n, _BEGIN, np.roll(back[-1], 1)))
            back[-1] = back[-1] & U(0xFFFFFFFF)  # these are only told apart, gram by gram
            toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False) == 1, np.diff(of))
            if len(word):
                yield _pieces(_distinct(back, toxic, ~toxic), order, buckets)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in it:
            for bucket, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and bucket != now:
                    yield _kinds(held, order)
                    held = []
                now = bucket
                held.append(_unpacked(piece.as_py(), order))
        if held:
            yield _kinds(held, order)

    buckets = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Grams move once, packed: a bucket has all that end in the same words, and no more of one word than it must.
    rows = through_python(texts.select("text", "label"), batches, "bucket int, piece binary").repartition("bucket").sortWithinPartitions("bucket")
    kinds = through_python(rows, counted, ", ".join(f"{n} long" for n in (*names[:order], "toxic", "ordinary")))
    # What finds no room in memory is counted again of the moved grams, which lie on disk already, not written once more.
    levels = [kinds.persist(StorageLevel.MEMORY_ONLY)]
    for n in range(order - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*names[:n]).agg(*(F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("toxic", "ordinary"))).persist(StorageLevel.MEMORY_ONLY))
    folder = shared_folder(texts.sparkSession, "toxicity-counts")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        grams_, contexts_, asked = [], [], None
        for n in range(order, 0, -1):
            level, own = levels[n - 1], names[:n]
            wanted = F.greatest("toxic", "ordinary") > least
            if asked is not None:
                level = level.join(asked, own, "left")
                wanted = wanted | F.col("asked").isNotNull()
            level = level.withColumn("there", wanted)
            there = kept(level.where("there").select(*own, "toxic", "ordinary"), f"grams-{n}")
            rest = [F.sum(F.when(F.col("there"), 0).otherwise(F.col(c))).alias(f"{c}_rest") for c in ("toxic", "ordinary")]
            totals = level.groupBy(*own[1:]).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), *rest, F.max("there").alias("there"))
            if n > 1:
                contexts_.insert(0, kept(totals.where("there").drop("there"), f"contexts-{n}"))
                asked = there.select(*own[:-1]).distinct().withColumn("asked", F.lit(True))
            else:
                single = {c: x or 0 for c, x in totals.drop("there").first().asDict().items()}
            grams_.insert(0, there)
        return Counts(grams_, contexts_, single, levels[0].count(), folder)
    finally:
        for x in levels:
            x.unpersist()


def _evidence(rows: DataFrame, models: list[Models]) -> DataFrame:
    """text is replaced by its evidence by each of the models, an array; other columns stay."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    at = rows.columns.index("text")
    rest = [i for i, c in enumerate(rows.columns) if c != "text"]
    names = [f.name for f in others] + ["evidence"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _blocks(it, at):
            found = evidence(texts, *models)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), flat], names)

    return through_python(rows, batches, T.StructType([*others, T.StructField("evidence", T.ArrayType(T.DoubleType()))]))


def _score(weights: np.ndarray) -> Column:
    z = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        z = z + F.lit(float(w)) * F.col("evidence")[i]
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 11) -> tuple[Models, np.ndarray]:
    """The models, and the curve's weights with its constant last. docs: doc_id, text."""
    spark, path = docs.sparkSession, None
    known = cut(known_labels(labels, label).where("label IN (0, 1)"))
    if known.count() <= SMALL_ROWS:
        texts = labelled_texts(docs, F.broadcast(known), seed)
    else:  # texts move to their labels, once for both passes
        path = shared_folder(spark, "labelled")
        labelled_texts(docs, known, seed).write.option("compression", "zstd").parquet(path)
        texts = spark.read.parquet(path)
    try:
        counts = count(texts.where(F.col("u") < FITTED_SHARE))
        several = fits(counts, DISCOUNTS)
        removed(spark, counts.folder)
        seen = cut(_evidence(texts.where(F.col("u") >= FITTED_SHARE).select("text", "label"), several))
        curves, (ordinary, toxic) = curves_of(seen, len(several))
        if not curves:
            share = (1.0 if toxic else 0.0) if ordinary or toxic else texts.agg(F.avg("label")).first()[0] or 0.0
            return several[0], np.r_[np.zeros(len(PASSAGES) + 1), 30.0 * (2 * share - 1)]
    finally:
        if path is not None:
            removed(spark, path)
    best = min(range(len(several)), key=lambda i: curves[i][1])
    return several[best], curves[best][0]


def score(docs: DataFrame, models: Models, curve: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1, of every row of docs."""
    seen = _evidence(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), [models])
    return seen.select("doc_id", _score(curve).alias("score"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    models, curve = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    return _evidence(rows, [models]).where(_score(curve) < threshold).select("row.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    models, curve = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, models, curve)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
