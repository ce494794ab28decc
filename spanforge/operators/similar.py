"""Similarity of texts within a session, from hashed character trigrams.

Windows of spans and whole matrices: rows are dealt by session and sorted, and workers read them as a stream. For a window
they hold that window's vectors only, for a matrix the session's vectors so far.

Only pairs from a threshold on: a session's distinct texts are cut into blocks of like length, and units of two blocks are
dealt over all tasks. Blocks don't meet where their vectors have too few dimensions for each other: the product of two unit
vectors is at most the root of the squared weights that the longer one has in as many of its largest dimensions as the
other has in all. Every pair that may reach the threshold is computed, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.runtime import ship_package
from spanforge.functions.vectors import DIMENSIONS, Buckets

#: Rows that are compared at once; texts of a session that two sides of a unit have, and the most blocks of a session.
BLOCK, UNIT, QUANTILES = 256, 2048, 1000


def vector(text: str, buckets: Buckets) -> np.ndarray:
    """The unit vector of a lower-cased text; a text of fewer than three characters has the first one."""
    n = len(text) - 2
    if n < 1:
        return np.eye(1, DIMENSIONS)[0]
    counts = np.bincount(np.fromiter((buckets[text[i : i + 3]] for i in range(n)), np.int64, n), minlength=DIMENSIONS).astype(float)
    return counts / np.sqrt(counts @ counts)


def _stream(df: DataFrame, work: Callable[[Iterator[tuple], Buckets], Iterator[list[tuple]]], schema: T.StructType) -> DataFrame:
    """Rows, as tuples, to lists of rows."""
    ship_package(df.sparkSession)
    names = schema.fieldNames()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in it:
                kinds[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        given = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BinaryType(): pa.binary()}
        for found in work(rows(), Buckets()):
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[0] if i == 0 else given[f.dataType]) for i, (c, f) in enumerate(zip(cols, schema.fields, strict=True))], names)

    return df.mapInArrow(batches, schema)


def _schema(df: DataFrame, *columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("session_id", df.schema["session_id"].dataType), *(T.StructField(n, t) for n, t in columns)])


def neighbours(spans: DataFrame, intents: DataFrame, window: int) -> DataFrame:
    """(session_id, position, similarity, repetition): to the session's intent, and the most to one of the same phase's
    previous spans; 0 where there is none. spans: session_id, position, phase, text; intents: session_id, text."""
    low = F.lower("text").alias("of")
    return _windowed(spans, intents, low, window, lambda text, buckets: vector(text or "", buckets))


def dense_neighbours(spans: DataFrame, intents: DataFrame, window: int) -> DataFrame:
    """neighbours() by vectors that spans and intents bring as embedding; one that is null or zero is like none."""

    def unit(values: list[float] | None, _: Buckets) -> np.ndarray | None:
        v = np.array(values or (), float)
        norm = float(np.sqrt(v @ v))
        return v / norm if norm else None

    return _windowed(spans, intents, F.col("embedding").alias("of"), window, unit)


def _windowed(spans: DataFrame, intents: DataFrame, of: Column, window: int, vector_of: Callable[[object, Buckets], np.ndarray | None]) -> DataFrame:
    phases = spans.select("session_id", "phase").distinct()
    goals = intents.select("session_id", of).join(phases, "session_id").select("session_id", "phase", F.lit(-1).cast("long").alias("position"), "of", F.lit(0).alias("own"))
    rows = goals.unionByName(spans.select("session_id", "phase", F.col("position").cast("long").alias("position"), of, F.lit(1).alias("own")))
    rows = rows.repartition("session_id", "phase").sortWithinPartitions("session_id", "phase", "own", "position")

    def work(it: Iterator[tuple], buckets: Buckets) -> Iterator[list[tuple]]:
        key, goal, held, n, out = None, None, None, 0, []
        for session, phase, position, what, own in it:
            if (session, phase) != key:
                key, goal, n = (session, phase), None, 0
            v = vector_of(what, buckets)
            if not own:
                goal = v
                continue
            similarity = repetition = 0.0
            if v is not None:
                held = np.zeros((window, len(v))) if held is None or held.shape[1] != len(v) else held
                similarity = float(goal @ v) if goal is not None else 0.0
                repetition = max(float((held[: min(n, window)] @ v).max()), 0.0) if n else 0.0
            if held is not None:
                held[n % window] = 0 if v is None else v
            n += held is not None
            out.append((session, position, round(similarity, 9), round(repetition, 9)))
            if len(out) >= 1000:
                yield out
                out = []
        yield out

    return _stream(rows, work, _schema(spans, ("position", T.LongType()), ("similarity", T.DoubleType()), ("repetition", T.DoubleType())))


def _with_earlier(rows: DataFrame, at: str, tell: Callable[[np.ndarray, int, list[int]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """What tell(similarities, n, places) gives of each row of a session, in the order of ``at``, behind the session and the
    row's place: the similarities are to the rows at places, of which the first n are earlier ones."""
    sorted_ = rows.select("session_id", F.col(at).cast("long").alias("at"), F.lower("text").alias("text")).repartition("session_id").sortWithinPartitions("session_id", "at")

    def work(it: Iterator[tuple], buckets: Buckets) -> Iterator[list[tuple]]:
        session, held, places, fresh = None, np.zeros((BLOCK, DIMENSIONS)), [], 0

        def told() -> list[tuple]:
            n = len(places)
            each = held[n - fresh : n] @ held[:n].T
            return [(session, places[n - fresh + i], *x) for i in range(fresh) for x in tell(each[i], n - fresh + i, places)]

        for s, place, text in it:
            if s != session or fresh == BLOCK:
                if fresh:
                    yield told()
                fresh = 0
                if s != session:
                    session, places = s, []
            if len(places) == len(held):
                held = np.concatenate([held, np.zeros_like(held)])
            held[len(places)] = vector(text or "", buckets)
            places.append(place)
            fresh += 1
        if fresh:
            yield told()

    return _stream(sorted_, work, schema)


def pairs(prompts: DataFrame) -> DataFrame:
    """(session_id, i, j, similarity) of all of a session's prompts, i < j."""

    def tell(each: np.ndarray, n: int, places: list[int]) -> Iterator[tuple]:
        return ((places[i], round(float(each[i]), 4)) for i in range(n))

    found = _with_earlier(prompts, "prompt_index", tell, _schema(prompts, ("j", T.LongType()), ("i", T.LongType()), ("similarity", T.DoubleType())))
    return found.select("session_id", "i", "j", "similarity")


def matrix(prompts: DataFrame) -> DataFrame:
    """(session_id, i, j, similarity): pairs() both ways, with 1 for each prompt and itself."""
    one, p = pairs(prompts), F.col("prompt_index").cast("long")
    own = prompts.select("session_id", p.alias("i"), p.alias("j"), F.lit(1.0).alias("similarity"))
    return one.unionByName(one.select("session_id", F.col("j").alias("i"), F.col("i").alias("j"), "similarity")).unionByName(own)


def steps(prompts: DataFrame) -> DataFrame:
    """(session_id, prompt_index, similarity) of each prompt but the first to the one before."""

    def tell(each: np.ndarray, n: int, places: list[int]) -> Iterator[tuple]:
        return iter(((round(float(each[n - 1]), 4),),) if n else ())

    return _with_earlier(prompts, "prompt_index", tell, _schema(prompts, ("prompt_index", T.LongType()), ("similarity", T.DoubleType())))


def _energy_bound(counts: np.ndarray, least: float) -> int:
    """How many dimensions another vector must have to be that similar: its product is at most the root of what as many of
    this one's largest weights have of its square."""
    squares = np.sort(counts.astype(float) ** 2)[::-1]
    return 0 if least <= 0 else int(np.searchsorted(np.cumsum(squares), least * least * squares.sum() * (1 - 1e-12))) + 1


def _vectors(texts: DataFrame, least: float) -> DataFrame:
    """(session_id, block, first, buckets, counts, own, needed): sparse vectors, and what bounds their products."""

    def work(it: Iterator[tuple], buckets: Buckets) -> Iterator[list[tuple]]:
        out = []
        for session, block, first, text in it:
            n = len(text) - 2
            found = np.bincount(np.fromiter((buckets[text[i : i + 3]] for i in range(n)), np.int64, n), minlength=DIMENSIONS) if n > 0 else np.eye(1, DIMENSIONS, dtype=np.int64)[0]
            where = np.flatnonzero(found)
            counts = found[where]
            out.append((session, block, first, where.astype("<u2").tobytes(), counts.astype("<u4").tobytes(), len(where), _energy_bound(counts, least)))
            if len(out) >= 1000:
                yield out
                out = []
        yield out

    return _stream(texts.select("session_id", "block", "first", "text"), work, _schema(texts, ("block", T.LongType()), ("first", T.LongType()), ("buckets", T.BinaryType()), ("counts", T.BinaryType()), ("own", T.LongType()), ("needed", T.LongType())))


def _units(texts: DataFrame, least: float, block: int) -> DataFrame:
    """Vectors as often as they are compared, by (session_id, a, b), two blocks of a session: at_b tells which of them a row is
    in. A session's texts are cut into blocks by their lengths, and two blocks meet only where a vector of each has enough
    dimensions for one of the other."""
    texts = texts.withColumn("order", F.length("text") * F.lit(1 << 20) + F.pmod(F.xxhash64("first"), F.lit(1 << 20)))
    large = texts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("order", [i / QUANTILES for i in range(1, QUANTILES)], QUANTILES * 10).alias("q")).where(F.col("n") > block)
    parts = F.least(F.ceil(F.col("n") / block), F.lit(QUANTILES))
    cuts = large.select("session_id", F.array_distinct(F.transform(F.sequence(F.lit(1), (parts - 1).cast("int")), lambda i: F.element_at("q", F.floor(i * QUANTILES / parts).cast("int")))).alias("cuts"))
    placed = texts.join(cuts, "session_id", "left").withColumn("block", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("order"))), F.lit(0)).cast("long"))
    blocks = _vectors(placed, least)
    bounds = blocks.groupBy("session_id", "block").agg(F.max("own").alias("own"), F.min("needed").alias("needed"))
    other = bounds.select("session_id", F.col("block").alias("b"), F.col("own").alias("own_b"), F.col("needed").alias("needed_b"))
    met = bounds.withColumnRenamed("block", "a").join(other, "session_id").where("a <= b AND own >= needed_b AND own_b >= needed").select("session_id", "a", "b")
    sides = met.select("session_id", F.col("a").alias("block"), "a", "b", F.lit(0).cast("long").alias("at_b")).unionByName(met.where("a < b").select("session_id", F.col("b").alias("block"), "a", "b", F.lit(1).cast("long").alias("at_b")))
    return blocks.join(sides, ["session_id", "block"]).select("session_id", "a", "b", "at_b", "first", "buckets", "counts")


def _compared(units: DataFrame, least: float, digits: int, tell: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """What tell(rows' firsts, columns' firsts, similarities) gives of each two blocks, of the earlier text's rows; behind the
    session. A similarity that isn't reached, or of a text and itself, is 0."""
    rows = units.repartition("session_id", "a", "b").sortWithinPartitions("session_id", "a", "b", "at_b")

    def matrix_of(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(held), DIMENSIONS))
        for row, (_, buckets, counts) in zip(out, held, strict=True):
            row[np.frombuffer(buckets, "<u2")] = np.frombuffer(counts, "<u4")
        out /= np.sqrt((out * out).sum(1, keepdims=True))
        return np.array([first for first, _, _ in held], np.int64), out

    def work(it: Iterator[tuple], _: Buckets) -> Iterator[list[tuple]]:
        unit, sides = None, ([], [])

        def told() -> Iterator[list[tuple]]:
            here, left = matrix_of(sides[0])
            there, right = matrix_of(sides[1]) if sides[1] else (here, left)
            for lo in range(0, len(here), BLOCK):
                near = np.round(left[lo : lo + BLOCK] @ right.T, digits)
                near[(near < least) | (here[lo : lo + BLOCK, None] == there)] = 0
                if found := [(unit[0], *x) for x in tell(here[lo : lo + BLOCK], there, near)]:
                    yield found

        for session, a, b, at_b, first, buckets, counts in it:
            if (session, a, b) != unit:
                if unit and sides[0]:
                    yield from told()
                unit, sides = (session, a, b), ([], [])
            sides[at_b].append((first, buckets, counts))
        if unit and sides[0]:
            yield from told()

    return _stream(rows, work, schema)


def _distinct(rows: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows as (session_id, at, key), and a session's distinct texts as (session_id, first, text, key, copies)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    own = rows.select("session_id", F.col(at).cast("long").alias("at"), low.alias("text"), F.md5(low.cast("binary")).alias("key"))
    return own.drop("text"), own.groupBy("session_id", "key").agg(F.min("at").alias("first"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _nearest(texts: DataFrame, threshold: float, digits: int, block: int) -> DataFrame:
    """(session_id, first, other): of each text with one that is alike, the first place of such another text."""

    def tell(here: np.ndarray, there: np.ndarray, near: np.ndarray) -> Iterator[tuple]:
        far = np.iinfo(np.int64).max
        for firsts, others, hit in ((here, there, near > 0), (there, here, near.T > 0)):
            best = np.where(hit, others, far).min(1, initial=far)
            yield from ((int(firsts[i]), int(best[i])) for i in np.flatnonzero(best < far))

    units = _units(texts.select("session_id", "first", "text"), threshold - 10.0**-digits, block)
    found = _compared(units, threshold, digits, tell, _schema(texts, ("first", T.LongType()), ("other", T.LongType())))
    return found.groupBy("session_id", "first").agg(F.min("other").alias("other"))


def first_alike(spans: DataFrame, threshold: float, block: int = UNIT) -> DataFrame:
    """(session_id, position, prior): spans that are like an earlier one, and the first such.

    Distinct texts are compared, in units of two blocks each that are dealt over all tasks, so that no session is in one task;
    each unit tells a text's first partner only."""
    rows, texts = _distinct(spans, "position")
    found = texts.join(_nearest(texts, threshold, 9, block), ["session_id", "first"], "left").select("session_id", "key", F.least("first", "other").alias("prior"))
    return rows.join(found, ["session_id", "key"]).where("prior < at").select("session_id", F.col("at").alias("position"), "prior")


def alike(prompts: DataFrame, threshold: float, block: int = UNIT) -> DataFrame:
    """(session_id, prompt_index) of prompts that are like another one of their session."""
    rows, texts = _distinct(prompts, "prompt_index")
    near = texts.join(_nearest(texts, threshold, 4, block), ["session_id", "first"], "left").where("copies > 1 OR other IS NOT NULL").select("session_id", "key")
    return rows.join(near, ["session_id", "key"]).select("session_id", F.col("at").alias("prompt_index"))


def alike_pairs(prompts: DataFrame, threshold: float, block: int = UNIT) -> DataFrame:
    """The rows of pairs() with at least that similarity, without making the others."""
    rows, texts = _distinct(prompts, "prompt_index")

    def tell(here: np.ndarray, there: np.ndarray, near: np.ndarray) -> Iterator[tuple]:
        own = here is there or len(np.intersect1d(here, there)) > 0
        for i, j in zip(*np.nonzero(near), strict=True):
            if not own or here[i] < there[j]:
                yield int(here[i]), int(there[j]), float(near[i, j])

    units = _units(texts.select("session_id", "first", "text"), threshold - 1e-4, block)
    found = _compared(units, threshold, 4, tell, _schema(texts, ("x", T.LongType()), ("y", T.LongType()), ("similarity", T.DoubleType())))
    named = rows.join(texts.select("session_id", "key", "first"), ["session_id", "key"]).select("session_id", "first", "at")
    x, y = (named.select("session_id", F.col("first").alias(n), F.col("at").alias(f"{n}_at")) for n in "xy")
    both = found.join(x, ["session_id", "x"]).join(y, ["session_id", "y"])
    same = texts.where("copies > 1").select("session_id", F.col("first").alias("x"), F.col("first").alias("y"), F.lit(1.0).alias("similarity")).where(F.lit(1.0 >= threshold))
    copies = same.join(x, ["session_id", "x"]).join(y, ["session_id", "y"]).where("x_at < y_at")
    out = both.unionByName(copies)
    return out.select("session_id", F.least("x_at", "y_at").alias("i"), F.greatest("x_at", "y_at").alias("j"), "similarity")


def between(df: DataFrame, a: Column, b: Column, name: str = "similarity", keys: tuple[str, ...] = ("pair_index",)) -> DataFrame:
    """(session_id, keys, name): of two texts of each row, 0 where one is missing. The keys are whole numbers."""
    texts = df.select("session_id", *(F.col(k).cast("long").alias(k) for k in keys), F.lower(a).alias("a"), F.lower(b).alias("b"))

    def work(it: Iterator[tuple], buckets: Buckets) -> Iterator[list[tuple]]:
        out = []
        for *key, x, y in it:
            out.append((*key, round(float(vector(x, buckets) @ vector(y, buckets)), 4) if x is not None and y is not None else 0.0))
            if len(out) >= 1000:
                yield out
                out = []
        yield out

    return _stream(texts, work, _schema(df, *((k, T.LongType()) for k in keys), (name, T.DoubleType())))
