"""Repeated passages, found by enhanced suffix arrays over anchored contexts.

A passage of ``LENGTH`` bytes that occurs twice has the same smallest ``GRAM``-byte hash at the same place in both
occurrences. So each window of LENGTH bytes belongs to the anchor with the smallest hash in it, and all windows of an
anchor form one context: from the first such window's start to the last one's end. Only anchors whose hash occurs
elsewhere matter. Where their contexts are equal as a whole, all their windows repeat. The different contexts of one
anchor hash meet in one place, each kind of context once: the suffixes from the anchor on are sorted, their common
prefixes span an interval tree (by a stack scan), and in every interval the texts before the anchor are compared, which
gives the repeats that can be extended neither way, with all their occurrences.

An anchor with more than ``MOST_CONTEXTS`` different contexts is not gathered in one place: its windows are counted by
their hashes instead, which shuffles and combines them like any other count, with the same result.

Hashes are 64-bit; contexts are told apart by theirs among those of one anchor only, whose bytes have an equal hash
already. Texts are written once, with their rows' numbers, and read anew by each pass. maximal_repeats() lists the repeats
themselves, with all occurrences. Defined results: a null text counts as empty; nothing
is removed from texts shorter than LENGTH; rows that repeat an id or a text are occurrences of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bloom
from spanforge.llm.common import cut, documents, numbered, through_python

LENGTH, GRAM, MOST_CONTEXTS = 200, 60, 4096
#: 64 MB: the most that a filter takes.
MAX_BITS, BITS_PER_KEY = 1 << 29, 16
#: Bytes of text that are hashed at once, if no single text is longer.
BLOCK = 1 << 20
_U = np.uint64
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(1)
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.int64).astype(_U) * _U(2) + _U(1)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n, 2 * BLOCK), b, _U)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(_SPREAD)
    h ^= h >> _U(29)
    h = h * _U(_BASE)
    return h ^ (h >> _U(32))


def _sums(data: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(data) + 1)
    return np.concatenate([np.zeros(1, _U), np.cumsum(_bytes_table()[data] * inverse[: len(data)])])


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the bytes from start to end, alike wherever they stand."""
    powers, _ = _powers(len(sums))
    return _mix((sums[end] - sums[start]) * powers[start])


def contexts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """All contexts of texts that stand one after the other in data, as arrays: text, start (in data), windows, anchor
    (from start), h (of the anchor), c (of the whole context)."""
    n, w = len(data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return {k: empty for k in ("text", "start", "windows", "anchor", "h", "c")}
    sums = _sums(data)
    at = np.arange(n - gram + 1)
    grams = _hash(sums, at, at + gram)
    # The smallest of w neighbours, by the smallest within blocks of w from either side; ties go to the first.
    rank = grams & _U(0xFFFFFFFF00000000) | at.astype(_U)
    padded = np.full(-(-len(rank) // w) * w, ~_U(0), _U)
    padded[: len(rank)] = rank
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    first = np.arange(n - length + 1)
    owner = (np.minimum(behind[first], ahead[first + w - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    text_of = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    inside = first + length <= ends[text_of[first]]
    change = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]) | (text_of[first[1:]] != text_of[first[:-1]])])
    stop = np.r_[change[1:], len(first)]
    kept = inside[change]
    start, windows = change[kept], (stop - change)[kept]
    own = owner[start]
    anchor = own - start
    whole = _hash(sums, start, start + windows - 1 + length)
    c = _mix(whole * _U(_SPREAD) + (anchor * 1000 + windows).astype(_U))
    return {"text": text_of[start], "start": start, "windows": windows, "anchor": anchor, "h": grams[own].view(np.int64), "c": c.view(np.int64)}


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Row keys and texts, about BLOCK bytes at a time."""
    for batch in it:
        keys, texts, size, begin = batch.column(0).to_numpy(), [], 0, 0
        for i, t in enumerate(batch.column(1)):
            raw = (t.as_py() or "").encode()
            if texts and size + len(raw) > BLOCK:
                yield keys[begin:i], texts
                texts, size, begin = [], 0, i
            texts.append(raw)
            size += len(raw)
        if texts:
            yield keys[begin:], texts


def _with_contexts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for keys, texts in _blocks(it):
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        found = contexts(data, ends)
        found["row"] = keys[found["text"]]
        found["at"] = found["start"] - np.r_[0, ends][found["text"]]
        yield data, found


def _place(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An evenly spread name of a context's place."""
    return _mix(row.astype(_U) * _U(_SPREAD) + at.astype(_U) * _U(_BASE)).view(np.int64)


def _scan(rows: DataFrame) -> DataFrame:
    """(h, c) of every context."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _with_contexts(it):
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for k in ("h", "c")], ["h", "c"])

    return through_python(rows, batches, "h long, c long")


def _repeated_contexts(rows: DataFrame, bits: bytes) -> DataFrame:
    """(h, c, row, at, windows) of the contexts whose anchor's hash may repeat."""
    held = rows.sparkSession.sparkContext.broadcast(bits)
    names = ["h", "c", "row", "at", "windows"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _with_contexts(it):
            keep = bloom.maybe_in(held.value, x["h"])
            yield pa.RecordBatch.from_arrays([pa.array(x[k][keep]) for k in names], names)

    return through_python(rows, batches, "h long, c long, row long, at long, windows long")


def _context_bytes(rows: DataFrame, bits: bytes) -> DataFrame:
    """(row, at, anchor, bytes) of the contexts whose place may be among the filter's."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, x in _with_contexts(it):
            keep = np.flatnonzero(bloom.maybe_in(held.value, _place(x["row"], x["at"])))
            start = x["start"][keep]
            raw = [data[a:b].tobytes() for a, b in zip(start, start + x["windows"][keep] - 1 + LENGTH, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x["row"][keep]), pa.array(x["at"][keep]), pa.array(x["anchor"][keep]), pa.array(raw, pa.binary())], ["row", "at", "anchor", "bytes"])

    return through_python(rows, batches, "row long, at long, anchor long, bytes binary")


# The enhanced suffix array of one anchor's contexts.


def common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:  # a[:lo] == b[:lo] holds
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of every common-prefix interval of a suffix array, inner ones first. lcp[i] is of i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            inner, first = stack.pop()
            yield inner, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def repeat_groups(texts: list[tuple[bytes, int]], length: int = LENGTH) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(size, [(text, start), ...]): the maximal repeats of at least so many bytes that span the anchor, with all their
    occurrences. texts: bytes and where their anchor is."""
    right = [b[a:] for b, a in texts]
    order = sorted(range(len(texts)), key=right.__getitem__)
    lcp = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    left = [b[:a][::-1] for b, a in texts]
    for ahead, first, last in intervals(lcp):
        need = length - ahead
        if need > max(len(left[order[i]]) for i in range(first, last + 1)):
            continue
        # Left-extension diversity: sorted by what stands before the anchor, the members fall into the intervals of a
        # second tree; each is a repeat that its members extend to the left differently.
        members = sorted(order[first : last + 1], key=left.__getitem__)
        before = [common_prefix(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        for back, lo, hi in intervals(before):
            if back >= need:
                yield back + ahead, [(m, texts[m][1] - back) for m in members[lo : hi + 1]]


def _covered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: (h, n, row, at, anchor, bytes). Of each context that occurs once: (row, at, lo, hi), the part
    that repeats, as positions in the text."""
    held: list[tuple] = []
    out: list[tuple[int, int, int, int]] = []

    def group() -> None:
        if len(held) < 2:
            return
        cover: dict[int, list[int]] = {}
        for size, occurrences in repeat_groups([(b, a) for *_, a, b in held]):
            for m, start in occurrences:
                x = cover.setdefault(m, [start, start + size])
                x[0], x[1] = min(x[0], start), max(x[1], start + size)
        for m, (lo, hi) in cover.items():
            _, n, row, at, _, _ = held[m]
            if n == 1:
                out.append((row, at, at + lo, at + hi))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "at", "lo", "hi"])
        out.clear()
        return batch

    for batch in it:
        for x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if held and held[-1][0] != x[0]:
                group()
                held = []
            held.append(x)
        yield flush()
    group()
    yield flush()


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts (n, row, at, bytes): (window, n, row, at, offset) for each window, by its hash."""
    for batch in it:
        for n, row, at, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            first = np.arange(len(raw) - LENGTH + 1)
            h = _hash(_sums(np.frombuffer(raw, np.uint8)), first, first + LENGTH).view(np.int64)
            k = len(first)
            yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(np.full(k, v)) for v in (n, row, at)), pa.array(first)], ["window", "n", "row", "at", "offset"])


def _found(rows: DataFrame) -> DataFrame:
    """(h, c, row, at, windows, differ) of all contexts whose anchor's hash occurs more than once."""
    # Joined by one more column than grouped by: both sides are dealt anew, so a hot anchor can be split.
    spread = lambda df: df.withColumn("part", F.pmod("h", F.lit(8191)))
    # Pass 1: anchors' hashes that occur more than once, and whether their contexts differ.
    repeated = cut(_scan(rows).groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("differ")).where("n > 1").select("h", "differ"))
    bits = bloom.build_even(repeated, "h", bloom.n_blocks(repeated.count(), BITS_PER_KEY, MAX_BITS))
    # Pass 2: all their contexts.
    return cut(spread(_repeated_contexts(rows, bits)).join(spread(repeated), ["h", "part"]).drop("part"))


def repeated_parts(rows: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(row, lo, hi): parts of texts that are covered by repeats; they may overlap. rows: row (a unique number), text."""
    spread = lambda df: df.withColumn("part", F.pmod("h", F.lit(8191)))  # noqa: E731  as in _found()
    found = _found(rows)
    kinds = _kinds(found)
    sizes = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"))
    kinds = cut(spread(kinds).join(spread(sizes), ["h", "part"]).drop("part"))
    # Pass 3: the bytes of one context of each kind; kept if they are read twice.
    whole = _bytes_of(rows, kinds)
    hot = kinds.where(F.col("contexts") > most_contexts).limit(1).count() > 0
    whole = cut(whole) if hot else whole
    few = whole.where(F.col("contexts") <= most_contexts).select("h", "n", "row", "at", "anchor", "bytes").repartition("h").sortWithinPartitions("h", "row", "at")
    partly = through_python(few, _covered, "row long, at long, lo long, hi long")
    single = kinds.where("n = 1").select("row", "at")
    # A context that occurs more than once repeats as a whole; one that occurs once, only as far as was found.
    full = found.join(single, ["row", "at"], "left_anti").select("row", F.col("at").alias("lo"), (F.col("at") + F.col("windows") - 1 + LENGTH).alias("hi"))
    if not hot:
        return full.unionByName(partly.select("row", "lo", "hi"))
    many = whole.where(F.col("contexts") > most_contexts).select("n", "row", "at", "bytes")
    windows = through_python(many, _windows, "window long, n long, row long, at long, offset long")
    again = windows.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").withColumn("part", F.pmod("window", F.lit(8191)))
    counted = windows.where("n = 1").withColumn("part", F.pmod("window", F.lit(8191))).join(again, ["window", "part"]).groupBy("row", "at").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    partly = partly.unionByName(counted.select("row", "at", (F.col("at") + F.col("first")).alias("lo"), (F.col("at") + F.col("last") + LENGTH).alias("hi")))
    return full.unionByName(partly.select("row", "lo", "hi"))


def _kinds(found: DataFrame) -> DataFrame:
    """(h, c, n, row, at): of each different context of an anchor, how often it occurs, and one place."""
    return found.where("differ").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("one")).select("h", "c", "n", "one.row", "one.at")


def _bytes_of(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    place = _place_column(rows.sparkSession, kinds)
    bits = bloom.build_even(place, "place", bloom.n_blocks(place.count(), BITS_PER_KEY, MAX_BITS))
    return _context_bytes(rows, bits).join(kinds, ["row", "at"])


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h: (h, c, anchor, bytes). (h, number, size, c, start): the maximal repeats of an anchor's different
    contexts, numbered, with each context and where in it the repeat begins."""
    held: list[tuple] = []

    def told() -> pa.RecordBatch:
        out = [(held[0][0], g, size, held[m][1], start) for g, (size, places) in enumerate(repeat_groups([(b, a) for _, _, a, b in held])) for m, start in places] if len(held) > 1 else []
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h", "number", "size", "c", "start"])

    for batch in it:
        for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[-1][0] != x[0]:
                yield told()
                held = []
            held.append(x)
    yield told()


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(group_id, size, doc_id, row, start): strings of LENGTH bytes and more that occur more than once, with all their
    occurrences in all texts (row tells rows of one id apart; start is a place among the text's bytes).

    A repeat is maximal as far as one anchor's contexts reach: between their first and last window's ends it can be
    extended neither way for all its occurrences. A longer passage has such a repeat for each of its anchors, which overlap;
    a part of it that occurs more often has one of its own. All contexts of an anchor meet in one task here."""
    keyed = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row")
    rows = keyed.select("row", "text")
    found = _found(rows)
    kinds = cut(_kinds(found))
    parts = _bytes_of(rows, kinds).select("h", "c", "anchor", "bytes").repartition("h").sortWithinPartitions("h", "c")
    several = through_python(parts, _groups, "h long, number long, size long, c long, start long")
    # Contexts that occur more than once are repeats as a whole, if they are not among those already.
    size = F.col("windows") - 1 + LENGTH
    alone = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size")).where("n > 1").select("h", F.lit(-1).cast("long").alias("number"), "size", "c", F.lit(0).cast("long").alias("start"))
    same = several.where("start = 0").groupBy("h", "c", "size").agg(F.count(F.lit(1)).alias("known"))
    alone = alone.join(same, ["h", "c", "size"], "left_anti")
    places = several.unionByName(alone).withColumn("group_id", F.when(F.col("number") < 0, F.xxhash64("h", "c", "size")).otherwise(F.xxhash64("h", "number", "size")))
    spread = lambda df: df.withColumn("part", F.pmod("c", F.lit(8191)))
    every = spread(found.select("h", "c", "row", "at")).join(spread(places), ["h", "c", "part"]).select("group_id", "size", "row", (F.col("at") + F.col("start")).alias("start"))
    return every.join(keyed.select("row", "doc_id"), "row").select("group_id", "size", "doc_id", "row", "start")


def _place_column(spark: SparkSession, kinds: DataFrame) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(_place(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["place"])

    return through_python(kinds.select("row", "at"), batches, "place long")


def merged(parts: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (spans of bytes)."""
    keyed = numbered(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "row")
    parts = cut(repeated_parts(keyed.select("row", "text"), most_contexts).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("parts")))
    blocks = bloom.n_blocks(parts.count(), BITS_PER_KEY, MAX_BITS)
    marked = bloom.mark(keyed, "row", bloom.build(parts, "row", blocks), blocks, "maybe")
    span = "array<struct<lo: bigint, hi: bigint>>"
    none = F.expr(f"cast(array() AS {span})")
    untouched = marked.where(~F.col("maybe")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), none.alias("removed"))
    joined = marked.where("maybe").select("row", "doc_id", "text").join(parts, "row", "left").select("doc_id", "text", F.coalesce("parts", none).alias("parts"))
    arrow_span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                spans = merged([(p["lo"], p["hi"]) for p in found.as_py()])
                kept, at = hashlib.sha256(), 0
                for lo, hi in [*spans, [len(raw), len(raw)]]:
                    kept.update(raw[at:lo])
                    at = hi
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"lo": a, "hi": b} for a, b in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), arrow_span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return untouched.unionByName(through_python(joined, batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {span}"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("removed")
