"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct word shingles. Texts with equal sets are one kind, which is named by a digest of the set, so
that every pass over the texts finds the same names, however a scan is split by then. Shingles have one global order, the
rarer (by a counting sketch of fixed size over all texts) the earlier. Two sets that are similar enough share at least m
shingles within prefixes that are m - 1 shingles longer than the least; each kind picks its m, up to ``MOST_MATCHES``, by
the candidates that it expects from its prefix's document frequencies, and a pair is verified, on the whole sets, only if
it shares as many as the smaller m of the two asks.

First each kind is compared with one leader, the most promising of the least members of its shingles' groups. That ties
families together with as many pairs as members, and it gives each kind's delta: the shingles that it adds to its
leader's or lacks. Where a leader has one itself, the two deltas make that of the higher one, so that a family has one
leader, whichever its members chose. Deltas are then counted from the family's centre, the shingles that most of its
members have; a kind that is far from it is a family of its own, not one that is only far from an odd leader. Members
with small deltas are similar whatever these are, so their links are counted by weights, without naming pairs; others must
share deltas, and among the rarer ones at that, so only those pairs are candidates, and their deltas decide. Between
families, all pairs that share enough prefix shingles are. No link is lost by this, and a family of near copies is never
expanded into all its pairs.

What moves: of prefix shingles, first only sorted, shortened hashes, to find those that several kinds have; they make a
bitmap of at most ``MAX_BITS``, by which the rest stay where they are. (Beyond some 10**9 shingles the bitmap fills up and
more of them move; results don't change.) Of whole sets, those that are compared, once for each comparison.

Defined results: a text with fewer words than a shingle has the whole sequence as its one shingle; null texts and texts
without words have no shingle and are linked with nothing; a null doc_id comes after any other and keeps a component of
its own null where no other id is in it; rows that repeat an id are rows of their own; columns of any name pass through
one_of_each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import bloom
from spanforge.llm.common import cut, documents, free_name, numbered, through_python
from spanforge.llm.components import components
from spanforge.llm.hashing import BASE, U, mix

SHINGLE, SIMILARITY = 5, (80, 100)
MOST_MATCHES, VERIFY_COST = 4, 20
#: A kind is gathered under a leader if it differs from it by at most this share of the leader's shingles, and then follows
#: the family if it differs from its centre by at most that share of the centre's.
GATHERED, FOLLOWS = 1.0, 0.6
#: The sketch's counters; it has this size whatever the input. Parts of it travel together.
SKETCH_BITS, CHUNK = 22, 1 << 16
MAX_BITS, BITS_PER_KEY = 1 << 29, 16
#: Prefix shingles of a part of the bitmap; members of a family that one task compares with its leader.
PART_TOKENS, PART_MEMBERS = 1 << 20, 500
#: Tables up to so many rows of a few numbers are broadcast.
SMALL_ROWS = 1 << 20
#: Bytes of text that are worked on at once, if no word is longer.
BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_GAPS = re.compile(b"[\\x09-\\x0d\\x20]")
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.int64).astype(U) * U(2) + U(1)


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, BASE, U)]))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and where they begin."""
    points = _LOWER[np.frombuffer(data + b" ", np.uint8)]
    edge = np.flatnonzero(np.diff((~_GAP[points]).view(np.int8), prepend=0))
    begins, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(begins):
        return np.zeros(0, U), begins
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    power = _powers(1 << max(6, int(sizes.max()).bit_length()))
    each = _RANDOM[points[np.repeat(begins, sizes) + inside]] * power[inside]
    return mix(np.add.reduceat(each, ends - sizes) ^ sizes.astype(U)), begins


def _sections(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    at = 0
    while len(text) - at > 2 * BLOCK and (gap := _GAPS.search(text, at + BLOCK)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(texts) == 1 and len(texts[0]) > 2 * BLOCK:
        words = np.concatenate([word_hashes(part)[0] for part in _sections(texts[0])])
        of = np.array([0, len(words)])
    else:
        words, begins = word_hashes(b" ".join(texts))
        of = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = len(words)
    shingles = words.copy()
    for j in range(1, k):
        shingles[: n - j] = mix(shingles[: n - j] * U(3) ^ words[j:])
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:  # the whole sequence
            h = words[a : a + 1].copy()
            for j in range(a + 1, b):
                h = mix(h * U(5) ^ words[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def _digest(s: np.ndarray, salt: int) -> tuple[int, int]:
    """Of a set: its name, 63 bits, and another number that tells sets of one name apart."""
    if not len(s):
        return 0, 0
    return int(np.add.reduce(mix(s + U(salt)))) >> 1, int(np.add.reduce(mix(s ^ U(0x5BD1E9955BD1E995))).astype(np.int64))


def _sets(it: Iterator[pa.RecordBatch], k: int, text_at: int = 0) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of batches, of about BLOCK bytes of text, with the texts' sets."""
    for batch in it:
        texts = [(t or "").encode() for t in batch.column(text_at).to_pylist()]
        begin = size = 0
        for i, t in enumerate([*texts, None]):
            if i > begin and (t is None or size + len(t) > BLOCK):
                yield batch.slice(begin, i - begin), shingle_sets(texts[begin:i], k)
                begin, size = i, 0
            size += len(t or b"")


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(64 - SKETCH_BITS)).astype(np.int64)


def least_overlap(n: int, similarity: tuple[int, int]) -> int:
    return -(-similarity[0] * n // similarity[1])


def digests(rows: DataFrame, k: int, salt: int) -> DataFrame:
    """rows with n, name and other in place of text, and rows of chunk and counts: the sketch's parts. Kept."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    at = rows.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, schema = np.zeros(1 << SKETCH_BITS, np.uint32), None
        names = [*(f.name for f in others), "n", "name", "other", "chunk", "counts"]
        for part, sets in _sets(it, k, at):
            if any(map(len, sets)):
                np.add.at(counts, _counter(np.concatenate(sets)), np.uint32(1))
            found = [_digest(s, salt) for s in sets]
            kept = [part.column(i) for i in range(part.num_columns) if i != at]
            out = pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[i] for d in found], pa.int64()) for i in range(2)), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names)
            schema = out.schema
            yield out
        if schema is not None:
            used = [(c, zlib.compress(x.astype(np.uint8 if x.max() < 256 else np.uint32).tobytes(), 1)) for c, x in enumerate(counts.reshape(-1, CHUNK)) if x.any()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), schema.field(i).type) for i in range(len(schema) - 2)), pa.array([c for c, _ in used], pa.int64()), pa.array([x for _, x in used], pa.binary())], names)

    more = [T.StructField(n, T.LongType()) for n in ("n", "name", "other", "chunk")]
    return cut(through_python(rows, batches, T.StructType([*others, *more, T.StructField("counts", T.BinaryType())])))


def sketch(digested: DataFrame) -> bytes:
    """For each of the sketch's counters, the size class of its count."""

    def add(it: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for c, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                part = np.frombuffer(raw, np.uint8 if len(raw) == CHUNK else np.uint32).astype(np.uint64)
                sums[c] = np.minimum(sums[c] + part, U(0xFFFFFFFF)) if c in sums else part
        made = [np.round(6 * np.log2(s + 1.0)).astype(np.uint8) if last else s.astype(np.uint32) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(s.tobytes(), 1) for s in made], pa.binary())], ["chunk", "counts"])

    parts = through_python(digested.where("chunk IS NOT NULL").select("chunk", "counts"), lambda it: add(it, False), "chunk long, counts binary")
    out = bytearray(1 << SKETCH_BITS)
    for r in through_python(parts.repartition("chunk"), lambda it: add(it, True), "chunk long, counts binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = zlib.decompress(r.counts)
    return bytes(out)


def prefixes(rows: DataFrame, k: int, salt: int, similarity: tuple[int, int], sizes: bytes, most: int, repeated: bytes) -> DataFrame:
    """(kind, n, prefix) of each kind: its first shingles in the global order. Only kinds that may occur more than once
    (repeated, a filter) move, to be made one."""
    held = rows.sparkSession.sparkContext.broadcast((sizes, repeated))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = np.frombuffer(held.value[0], np.uint8), set()
        for _, sets in _sets(it, k):
            sets = [s for s in sets if len(s)]
            names = np.array([_digest(s, salt)[0] for s in sets], np.int64)
            maybe = bloom.maybe_in(held.value[1], names)
            out = []
            for s, name, again in zip(sets, names.tolist(), maybe.tolist(), strict=True):
                if again and name in done:
                    continue
                if again:
                    done.add(name)
                order = np.lexsort((s, table[_counter(s)]))
                out.append((name, len(s), s[order[: len(s) - least_overlap(len(s), similarity) + most]].tobytes(), again))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], ["kind", "n", "prefix", "again"])

    every = cut(through_python(rows.select("text"), batches, "kind long, n long, prefix binary, again boolean"))
    one = every.where("again").groupBy("kind").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return every.where("NOT again").select("kind", "n", "prefix").unionByName(one)


def shared_bits(kinds: DataFrame, tokens: int) -> bytes:
    """A bitmap by shingles' first bits: set where several kinds have one in their prefixes. tokens: how many there are."""
    bits = min(max(16, (8 * max(tokens, 1) - 1).bit_length()), MAX_BITS.bit_length() - 1)
    low = 64 - min(64, bits + 8)  # shingles are told apart by a few bits more than they are found by
    split = min(max(0, (tokens // PART_TOKENS).bit_length()), bits - 6)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held) if held else np.zeros(0, U)) >> U(low)
            first = np.r_[True, every[1:] != every[:-1]][: len(every)]
            every = every[first | np.r_[False, first[:-1]][: len(every)]]  # one or two of each
            part = (every >> U(64 - low - split)).astype(np.int64) if split else np.zeros(len(every), np.int64)
            bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(every)]).tolist()
            raw = []
            for a, b in zip(bounds, [*bounds[1:], len(every)], strict=False):
                steps = np.diff(every[a:b], prepend=U(0)).view(np.uint8).reshape(-1, 8)
                raw.append(zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(part[bounds], pa.int64()), pa.array(raw, pa.binary())], ["part", "steps"])

        for batch in it:
            for p in batch.column(0).to_pylist():
                held.append(np.frombuffer(p, U))
                size += len(held[-1])
            if size > 1 << 22:
                yield out()
                held, size = [], 0
        yield out()

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[np.ndarray]] = {}
        for batch in it:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1)
                of.setdefault(p, []).append(np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel()))
        for p, found in of.items():
            every = np.sort(np.concatenate(found))
            twice = every[1:][every[1:] == every[:-1]]
            at = (twice >> U(64 - low - bits)).astype(np.int64) - (p << bits - split)
            flags = np.zeros(1 << bits - split, bool)
            flags[at] = True
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())], ["part", "bits"])

    parts = through_python(kinds.select("prefix"), pack, "part long, steps binary")
    if split:
        parts = parts.repartition(1 << split, "part")
    else:
        parts = parts.repartition("part")
    out = bytearray(1 << bits - 3)
    size = 1 << bits - split - 3
    for r in through_python(parts, mark, "part long, bits binary").collect():
        out[r.part * size : (r.part + 1) * size] = zlib.decompress(r.bits)
    return bytes(out)


def _maybe_shared(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = (tokens >> U(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _tokens(kinds: DataFrame, bits: bytes) -> DataFrame:
    """(token, kind, n, at): kinds' prefix shingles that other prefixes may have too."""
    held = kinds.sparkSession.sparkContext.broadcast(bits)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint8)
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                raw = [np.frombuffer(p, U) for p in part.column(2).to_pylist()]
                sizes = [len(r) for r in raw]
                token = np.concatenate(raw)
                keep = _maybe_shared(table, token)
                at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                kind, n = (np.repeat(part.column(i).to_numpy(), sizes) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token.view(np.int64), kind, n, at)], ["token", "kind", "n", "at"])

    return through_python(kinds.select("kind", "n", "prefix"), batches, "token long, kind long, n long, at long")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """With one column more to join by than to group by: both sides are dealt anew, so that a hot key can be split."""
    return df.withColumn("part", F.pmod(F.col(key), F.lit(8191)))


def _ceil_share(n: Column, num: int, den: int) -> Column:
    """num * n / den, rounded up, in whole numbers."""
    return F.call_function("div", n * num + (den - 1), F.lit(den))


def candidate_tokens(kinds: DataFrame, tokens: int, similarity: tuple[int, int], most: int) -> DataFrame:
    """(token, kind, n, at, matches): the prefix shingles, within each kind's chosen prefix, that several kinds have."""
    found = cut(_tokens(kinds, shared_bits(kinds, tokens)))
    shared = found.groupBy("token").count().where("count > 1")
    found = _dealt(found, "token").join(_dealt(shared, "token"), ["token", "part"]).drop("part")
    base = F.col("n") - F.col("overlap") + 1
    of_kind = W.partitionBy("kind")
    found = found.withColumn("overlap", _ceil_share(F.col("n"), similarity[0], similarity[1]))
    costs = []
    for m in range(1, most + 1):
        # Entries read, and pairs expected to share m of them, each at the cost of verifying one.
        entries = F.sum(F.when(F.col("at") < base + m - 1, F.col("count") - 1).otherwise(0)).over(of_kind)
        costs.append(F.struct((entries * (1 + VERIFY_COST / m**2)).alias("cost"), F.lit(m).alias("m")))
    found = found.withColumn("matches", F.least(F.array_min(F.array(*costs))["m"], F.greatest(F.col("overlap"), F.lit(1))))
    return found.where(F.col("at") < base + F.col("matches") - 1).select("token", "kind", "n", "at", F.col("matches").cast("int").alias("matches"))


def compared(rows: DataFrame, pairs: DataFrame, k: int, salt: int, compare: Callable[[np.ndarray, np.ndarray], tuple | None], schema: str) -> DataFrame:
    """(a, b, and what compare gives) of the pairs (a, b) of kinds for which it gives something. Sets are made of texts
    again, for the pairs' kinds only, and meet in groups of some that share b; pairs should be materialised."""
    spark = rows.sparkSession
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PART_MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    members = _dealt(pairs.select("a", "b"), "b").join(_dealt(sizes, "b"), ["b", "part"]).select(F.col("a").alias("kind"), "b", part.alias("part"), F.lit(1).alias("nth"))
    leads = sizes.select(F.col("b").alias("kind"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("nth"))
    roles = cut(members.unionByName(leads))
    n = roles.count()
    names = roles.select("kind").distinct()
    blocks = bloom.n_blocks(n, BITS_PER_KEY, MAX_BITS)
    held = spark.sparkContext.broadcast(bloom.build_even(names, "kind", blocks))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for _, sets in _sets(it, k):
            names_ = np.array([_digest(s, salt)[0] for s in sets], np.int64)
            out = []
            for i in np.flatnonzero(bloom.maybe_in(held.value, names_)).tolist():
                if (name := int(names_[i])) not in done and len(sets[i]):
                    done.add(name)
                    out.append((name, sets[i].tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["kind", "set"])

    sets = through_python(rows.select("text"), batches, "kind long, set binary")
    met = sets.join(F.broadcast(roles) if n <= SMALL_ROWS else roles, "kind")
    met = met.select("b", "part", "nth", "kind", "set").repartition("b", "part").sortWithinPartitions("b", "part", "nth", "kind")

    fields = schema.split(", ")
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds_ = [pa.int64(), pa.int64(), *(arrow[f.split()[1]] for f in fields if f)]
    out_names = ["a", "b", *(f.split()[0] for f in fields if f)]

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = lead = last = None
        for batch in it:
            out = []
            for b, part_, nth, kind, raw in zip(*(batch.column(i) for i in range(5)), strict=True):
                b, part_, nth, kind = b.as_py(), part_.as_py(), nth.as_py(), kind.as_py()
                if (b, part_, nth, kind) == last:  # a copy
                    continue
                last = (b, part_, nth, kind)
                if nth == 0:
                    group, lead = (b, part_), np.frombuffer(raw.as_py(), U)
                elif (b, part_) == group and (more := compare(np.frombuffer(raw.as_py(), U), lead)) is not None:
                    out.append((kind, b, *more))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(out_names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], out_names)

    return through_python(met, meet, "a long, b long" + (f", {schema}" if schema else ""))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verified(rows: DataFrame, pairs: DataFrame, k: int, salt: int, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) of kinds whose sets are similar enough."""

    def alike(x: np.ndarray, y: np.ndarray) -> tuple | None:
        common = _common(x, y)
        return () if similarity[1] * common >= similarity[0] * (len(x) + len(y) - common) else None

    return compared(rows, pairs, k, salt, alike, "")


def deltas(rows: DataFrame, star: DataFrame, k: int, salt: int, similarity: tuple[int, int]) -> DataFrame:
    """Of kinds (a) and their leaders (b): (a, b, linked, gathered, n, delta). n: the leader's shingles; delta: what the kind
    adds to them (even numbers) and lacks of them (odd ones)."""

    def compare(x: np.ndarray, y: np.ndarray) -> tuple | None:
        added, lacked = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
        near = len(added) + len(lacked) <= GATHERED * len(y)
        delta = np.concatenate([added & ~U(1), lacked | U(1)]) if near else added[:0]
        common = len(x) - len(added)
        return similarity[1] * common >= similarity[0] * (len(x) + len(y) - common), near, len(y), delta.tobytes()

    return compared(rows, star, k, salt, compare, "linked boolean, gathered boolean, n long, delta binary")


def _composed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The delta from the higher leader, of one from a leader and that leader's own: what both name is neither's."""
    both = np.concatenate([x, y])
    order = np.argsort(both | U(1))
    both = both[order]
    same = (both[1:] | U(1)) == (both[:-1] | U(1))
    return both[~(np.r_[same, False] | np.r_[False, same])[: len(both)]]


def gathered(near: DataFrame) -> DataFrame:
    """(kind, leader, n, delta) of deltas()' rows: kinds under the highest leader that they are near enough to. A leader
    that has none is there as well, with no delta."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "leader", "n", "delta", "moved"]
        for batch in it:
            out = []
            for kind, leader, n, delta, higher, above, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if higher is not None:
                    sum_ = _composed(np.frombuffer(delta, U), np.frombuffer(more, U))
                    if len(sum_) <= GATHERED * above:
                        out.append((kind, higher, above, sum_.tobytes(), True))
                        continue
                out.append((kind, leader, n, delta, False))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names)

    under = near.where("gathered").select(F.col("a").alias("kind"), F.col("b").alias("leader"), "n", "delta")
    while True:  # a chain is half as long each time
        above = under.join(under.select(F.col("leader").alias("kind")).distinct(), "kind", "left_semi")
        above = above.select(F.col("kind").alias("leader"), F.col("leader").alias("higher"), F.col("n").alias("above"), F.col("delta").alias("more"))
        met = _dealt(under, "leader").join(_dealt(above, "leader"), ["leader", "part"], "left").select("kind", "leader", "n", "delta", "higher", "above", "more")
        under = cut(through_python(met, batches, "kind long, leader long, n long, delta binary, moved boolean"))
        if not under.where("moved").limit(1).count():
            break
        under = under.drop("moved")
    under = under.drop("moved")
    first = under.groupBy(F.col("leader").alias("kind")).agg(F.first("n").alias("n")).join(under.select("kind"), "kind", "left_anti")
    return under.unionByName(first.select("kind", F.col("kind").alias("leader"), "n", F.unhex(F.lit("")).alias("delta")))


def _exploded(members: DataFrame, *columns: str) -> DataFrame:
    """members' columns, numbers, and token: each of their deltas."""

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                raw = [np.frombuffer(d, np.int64) for d in part.column(len(columns)).to_pylist()]
                sizes = [len(r) for r in raw]
                cols = [np.repeat(part.column(i).to_numpy(zero_copy_only=False), sizes) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(np.concatenate(raw))], [*columns, "token"])

    return through_python(members.select(*columns, "delta"), explode, ", ".join(f"{c} long" for c in (*columns, "token")))


def centred(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(kind, leader, weight, bound, delta): families' deltas from their centre, the shingles that most members have, but for
    those of members that are too far from it.

    members: kind, leader, n, delta (from the leader). Two members are similar if and only if the deltas that they share,
    times the similarity's sum, reach their weights' sum less the bound; in particular if that isn't above 0."""
    num, den = similarity
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    counts = _exploded(members, "leader").groupBy("leader", "token").agg(F.count(F.lit(1)).alias("df"))
    most = _dealt(counts, "leader").join(_dealt(sizes, "leader"), ["leader", "part"]).where(F.col("df") * 2 > F.col("size"))
    flips = most.groupBy("leader").agg(F.collect_list("token").alias("flips"))  # at most twice what deltas have on average
    joined = _dealt(members, "leader").join(_dealt(flips, "leader"), ["leader", "part"], "left").select("kind", "leader", "n", "delta", "flips")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, follows = [], []
            for n, raw, flipped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                own = np.frombuffer(raw, np.int64)
                flip = flipped.values.to_numpy() if flipped.is_valid else own[:0]
                kept, back = np.setdiff1d(own, flip, True), np.setdiff1d(flip, own, True)
                # What the centre has and the member doesn't have is lacked, and the other way round.
                lacked = int((kept & 1).sum()) + int((back & 1 ^ 1).sum())
                added = len(kept) + len(back) - lacked
                size = n + int((flip & 1 ^ 1).sum()) - int((flip & 1).sum())
                follows.append(len(kept) + len(back) <= FOLLOWS * size)
                if follows[-1]:
                    out.append((den * lacked + num * added, (den - num) * size, np.concatenate([kept, back]).tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            kinds = [batch.column(i).filter(pa.array(follows, pa.bool_())) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*kinds, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True))], ["kind", "leader", "weight", "bound", "delta"])

    return cut(through_python(joined, batches, "kind long, leader long, weight long, bound long, delta binary"))


def _family_links(followers: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): similar followers of one leader whose weights' sum exceeds the bound, found and verified by their deltas.

    followers: kind, leader, weight, bound, lightest (the family's least weight), delta. Such pairs share some deltas, by
    their weights; all but so many of either's rarest deltas, and one more, hold a shared one."""
    total = sum(similarity)
    least = lambda over: F.greatest(F.lit(1), _ceil_share(F.greatest(over - F.col("bound"), F.lit(0)), 1, total))
    sized = followers.withColumn("size", (F.octet_length("delta") / 8).cast("long"))
    sized = sized.withColumn("last", F.col("size") - least(F.col("weight") + F.col("lightest")) + 1).where("last > 0")
    tokens = cut(_exploded(sized, "kind", "leader", "weight", "bound", "size", "last"))
    counts = _dealt(tokens.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token")
    ranked = _dealt(tokens, "token").join(counts, ["leader", "token", "part"], "left")
    order = W.partitionBy("leader", "kind").orderBy(F.coalesce("df", F.lit(1)), "token")
    near = ranked.withColumn("nth", F.row_number().over(order)).where("nth <= last AND df > 1")
    near = cut(near.select("kind", "leader", "weight", "bound", "token", (F.col("size") - F.col("nth") + 1).alias("rest")))
    side = lambda s: near.select("leader", "token", "bound", *(F.col(c).alias(f"{c}_{s}") for c in ("kind", "weight", "rest")))
    over = F.col("weight_x") + F.col("weight_y")
    pairs = side("x").join(side("y").drop("bound"), ["leader", "token"]).where((F.col("kind_x") > F.col("kind_y")) & (over > F.col("bound")) & (F.least("rest_x", "rest_y") >= least(over)))
    pairs = cut(pairs.select("leader", F.col("kind_x").alias("a"), F.col("kind_y").alias("b")).distinct())
    of = lambda s: followers.select("leader", F.col("kind").alias(s), F.col("weight").alias(f"weight_{s}"), F.col("bound").alias(f"bound_{s}"), F.col("delta").alias(f"delta_{s}"))
    met = pairs.join(of("a"), ["leader", "a"]).join(of("b"), ["leader", "b"]).select("a", "b", (F.col("weight_a") + F.col("weight_b") - F.col("bound_a")).alias("over"), "delta_a", "delta_b")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = [total * _common(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)) >= o for o, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)]
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in range(2)], ["a", "b"])

    return through_python(met, verify, "a long, b long")


def _apart(tokens: DataFrame, families: DataFrame) -> DataFrame:
    """tokens of groups that lie in several families, with family, and main (whether most of the group is of the family).
    families: kind, family; a kind that isn't there is its own."""
    known = families.select("kind", F.col("family").alias("f"))
    labelled = _dealt(tokens, "kind").join(_dealt(known, "kind"), ["kind", "part"], "left").drop("part")
    labelled = labelled.withColumn("family", F.coalesce("f", "kind")).drop("f")
    sizes = labelled.groupBy("token", "family").agg(F.count(F.lit(1)).alias("members"))
    groups = sizes.groupBy("token").agg(F.max(F.struct("members", (-F.col("family")).alias("least"))).alias("top"), F.count(F.lit(1)).alias("several")).where("several > 1").select("token", (-F.col("top.least")).alias("main_family"))
    joined = _dealt(labelled, "token").join(_dealt(groups, "token"), ["token", "part"]).drop("part")
    return joined.withColumn("main", F.col("family") == F.col("main_family"))


def _alike_in_size(a: Column, b: Column, similarity: tuple[int, int]) -> Column:
    return F.least(a, b) * similarity[1] >= F.greatest(a, b) * similarity[0]


def links(rows: DataFrame, kinds: DataFrame, tokens: int, k: int, salt: int, similarity: tuple[int, int], most: int = MOST_MATCHES) -> tuple[DataFrame, DataFrame]:
    """(a, b): each link between two kinds once, but for those that weights alone tell; and the kinds that have such links:
    (kind, leader, weight, bound, top), linked with every other kind of the leader where weights add up to the bound at
    most. top: the lightest one."""
    tokens_of = cut(candidate_tokens(kinds, tokens, similarity, most))
    leaders = tokens_of.groupBy("token").agg(F.min(F.struct("kind", "n", "matches")).alias("top"))
    star = _dealt(tokens_of, "token").join(_dealt(leaders, "token"), ["token", "part"]).where((F.col("kind") != F.col("top.kind")) & _alike_in_size(F.col("n"), F.col("top.n"), similarity))
    star = star.groupBy("kind", F.col("top.kind").alias("leader")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("matches", "top.matches")).alias("least"))
    # Only what would be a candidate in any case is compared; kinds without such a leader are families of their own.
    star = star.where("shared >= least").groupBy("kind").agg(F.max(F.struct("shared", (-F.col("leader")).alias("x"))).alias("top"))
    star = cut(star.select(F.col("kind").alias("a"), (-F.col("top.x")).alias("b")))
    near = cut(deltas(rows, star, k, salt, similarity))
    followers = centred(gathered(near), similarity)
    lightest = _dealt(followers.groupBy("leader").agg(F.min(F.struct("weight", "kind")).alias("top")), "leader")
    followers = _dealt(followers, "leader").join(lightest, ["leader", "part"]).withColumn("lightest", F.col("top.weight")).withColumn("top", F.col("top.kind"))
    within = _family_links(followers, similarity)
    families = followers.select("kind", F.col("top").alias("family"))  # by a member's name, which a leader need not be
    groups = cut(_apart(tokens_of, families).select("token", "kind", "n", "at", "matches", "family", "main"))
    side = lambda df, s: df.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("kind", "n", "at", "matches", "family", "main")))
    # Of two members of different families at least one is apart from the group's main family; that side is the small one.
    pairs = side(groups.where("NOT main"), "x").join(side(groups, "y"), "token")
    pairs = pairs.where((F.col("family_x") != F.col("family_y")) & (F.col("main_y") | (F.col("kind_x") < F.col("kind_y"))) & _alike_in_size(F.col("n_x"), F.col("n_y"), similarity))
    # Shingles that both have but not in both prefixes come after one of the two prefixes' ends, and after all shared ones.
    n_x, n_y, total = F.col("n_x"), F.col("n_y"), sum(similarity)
    common = _ceil_share(n_x + n_y, similarity[0], total)
    behind = lambda s: _ceil_share(F.col(f"n_{s}"), *similarity) - F.col(f"matches_{s}")
    asked = F.greatest(F.least("matches_x", "matches_y").cast("long"), common - F.greatest(behind("x"), behind("y")))
    after = F.least(n_x - F.col("at_x"), n_y - F.col("at_y")) - 1
    pairs = pairs.select(F.greatest("kind_x", "kind_y").alias("a"), F.least("kind_x", "kind_y").alias("b"), asked.alias("asked"), (common - after).alias("asked_here"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("asked", "asked_here")).alias("asked")).where("shared >= asked")
    between = verified(rows, cut(pairs.select("a", "b").join(star, ["a", "b"], "left_anti")), k, salt, similarity)
    direct = near.where("linked").select("a", "b")
    for s in "ab":
        direct = direct.join(families.select(F.col("kind").alias(s), F.col("family").alias(f"family_{s}")), s, "left")
    direct = direct.where("NOT family_a <=> family_b OR family_a IS NULL").select("a", "b")  # _family_links() and weights tell the others
    found = cut(direct.unionByName(within).unionByName(between))
    return found, followers.select("kind", "leader", "weight", "bound", "top", "lightest")


def degrees(found: DataFrame, followers: DataFrame, copies: DataFrame) -> DataFrame:
    """(kind, n): how many rows of other kinds each kind is linked with, of links() and copies (name, count; else 1)."""
    copies = _dealt(copies.select(F.col("name").alias("kind"), "count"), "kind")
    of = lambda df: _dealt(df, "kind").join(copies, ["kind", "part"], "left").withColumn("c", F.coalesce("count", F.lit(1))).drop("count", "part")
    ends = of(found.select(F.col("a").alias("kind"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("kind"), F.col("a").alias("other"))))
    told = ends.groupBy(F.col("other").alias("kind")).agg(F.sum("c").alias("n"))
    # For each weight in a family, the rows with any weight that adds up to the bound at most: a running sum over weights.
    own = of(followers.select("kind", "leader", "weight", "bound"))
    at = own.groupBy("leader", "weight", "bound").agg(F.sum("c").alias("c"))
    points = at.select("leader", F.col("weight").alias("x"), "c", F.lit(None).cast("long").alias("weight")).unionByName(at.select("leader", (F.col("bound") - F.col("weight")).alias("x"), F.lit(0).cast("long").alias("c"), "weight"))
    upto = points.withColumn("n", F.sum("c").over(W.partitionBy("leader").orderBy("x").rangeBetween(W.unboundedPreceding, 0))).where("weight IS NOT NULL")
    met = _dealt(own, "leader").join(_dealt(upto.select("leader", "weight", "n"), "leader"), ["leader", "weight", "part"])
    light = met.select("kind", (F.col("n") - F.when(2 * F.col("weight") <= F.col("bound"), F.col("c")).otherwise(0)).alias("n"))
    return told.unionByName(light).groupBy("kind").agg(F.sum("n").alias("n"))


def _named(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """digests() under a salt by which no two kinds of sets have one name, and the salt."""
    salt = 0
    while True:
        seen = digests(rows, k, salt)
        kinds = seen.where("n > 0").groupBy("name").agg((F.min("other") != F.max("other")).alias("x"), (F.min("n") != F.max("n")).alias("y"))
        if not kinds.where("x OR y").limit(1).count():
            return seen, salt
        salt += 1


def _components(rows: DataFrame, k: int, similarity: tuple[int, int], most: int, counted: bool) -> DataFrame:
    """rows with n and comp, a number for the component, in place of text; comp is null without shingles. With n_links, if
    counted."""
    seen, salt = _named(rows, k)
    texts = rows.select("text")
    again = cut(seen.where("n > 0").groupBy("name").count().where("count > 1"))
    repeated = bloom.build_even(again, "name", bloom.n_blocks(again.count(), BITS_PER_KEY, MAX_BITS))
    kinds = prefixes(texts, k, salt, similarity, sketch(seen), most, repeated)
    tokens = kinds.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    found, followers = links(texts, kinds, tokens, k, salt, similarity, most)
    alike = followers.where((F.col("kind") != F.col("top")) & (F.col("weight") + F.col("lightest") <= F.col("bound"))).select(F.col("kind").alias("a"), F.col("top").alias("b"))
    told = components(found.unionByName(alike)).select(F.col("node").alias("name"), "least")
    if counted:
        more = degrees(found, followers, again).select(F.col("kind").alias("name"), F.col("n").alias("others"))
        told = told.join(more, "name", "full").join(again, "name", "full")
    member = seen.where("chunk IS NULL").drop("chunk", "counts", "other")
    out = _dealt(member, "name").join(_dealt(told, "name"), ["name", "part"], "left").drop("part")
    out = out.withColumn("comp", F.when(F.col("n") > 0, F.coalesce("least", "name")))
    if counted:
        links_ = F.coalesce("others", F.lit(0)) + F.coalesce("count", F.lit(1)) - 1
        out = out.withColumn("n_links", F.when(F.col("n") > 0, links_).otherwise(0).cast("long")).drop("others", "count")
    return out.drop("name", "least")


def _smallest(member: DataFrame, *order: str) -> DataFrame:
    """member with top: of each component, the least of the columns, a null id last."""
    least = _dealt(member.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *order)).alias("top")), "comp")
    return _dealt(member, "comp").join(least, ["comp", "part"], "left")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, most: int = MOST_MATCHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row; n_links: how many other rows it is linked with."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = _smallest(cut(_components(rows, k, similarity, most, True)), "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"), "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, most: int = MOST_MATCHES) -> DataFrame:
    """docs without near duplicates: of each component, the row with the smallest id stays. Rows are numbered and written
    once, so that what is dropped are the same rows whenever they are read."""
    (row,) = free_name(docs, "row")
    kept = numbered(docs, row)
    keyed = kept.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    member = cut(_components(keyed, k, similarity, most, False))
    dropped = cut(_smallest(member, "doc_id", "row").where(F.col("row") != F.col("top.row")).select(F.col("row").alias(row)))
    n = dropped.count()
    if n <= SMALL_ROWS:
        return kept.join(F.broadcast(dropped), row, "left_anti").select(*docs.columns)
    blocks = bloom.n_blocks(n, BITS_PER_KEY, MAX_BITS)
    (maybe,) = free_name(kept, "maybe")
    marked = bloom.mark(kept, row, bloom.build(dropped, row, blocks), blocks, maybe)  # only what may be dropped moves
    return marked.where(~F.col(maybe)).unionByName(marked.where(maybe).join(dropped, row, "left_anti")).select(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text"), k=3, similarity=(90, 100))
