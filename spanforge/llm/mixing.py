"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources to which a document may be counted. Tokens flow
from patterns to source quotas; each further copy of a pattern's documents costs more than the one before (convex
repetition costs), so the flow of least cost repeats as little as the quotas allow. The flow of a pattern and copy is
then filled with documents in a seeded order that depends on nothing but the seed and the document's id.

Only patterns (distinct sets of sources, not documents) reach the driver; the flow's time grows little faster than their
number. Defined results: a null text has size 0; a null source is a source of its own, last in order; a document of no
source is never taken and has a target of 0; rows that repeat an id share its place in the order; columns of docs may
have any names, but the four that are added replace columns of their names; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.common import WORD_SEPARATORS, cut, documents, free_name, small_table

WEIGHTS = (5, 2, 1)
SHARE, MAX_COPIES, SEED = 1.5, 2, 17
#: Documents of a pattern are first summed by so many slices of the seeded order; only one slice is ever sorted.
SLICES = 1024


def words_in(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_SEPARATORS}]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> dict[str | None, float]:
    """Each source's quota: share times all sizes by weight, at most max_copies times its size; the excess is dealt again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_weight, out = share * sum(sizes.values()), float(sum(weight.values())), {}
    for s in sorted(order, key=lambda s: (max_copies * sizes[s] / weight[s], order.index(s))):
        most = float(max_copies * sizes[s])
        out[s] = min(most, weight[s] * (left / open_weight))
        if out[s] == most:
            left, open_weight = left - most, open_weight - weight[s]
    return out


class Network:
    """Maximum flow by blocking flows in layered graphs. An arc and its reverse have the numbers 2 i and 2 i + 1."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, start: int, end: int) -> list[int]:
        level, queue = [-1] * len(self.out), deque([start])
        level[start] = 0
        while queue and level[end] < 0:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def fill(self, start: int, end: int) -> None:
        """Add to the flow until it is the largest."""
        while (level := self._levels(start, end))[end] >= 0:
            next_, path, at = [0] * len(self.out), [], start
            while True:
                if at == end:
                    sent = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= sent
                        self.room[e ^ 1] += sent
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    at = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                arcs = self.out[at]
                while next_[at] < len(arcs) and not (self.room[arcs[next_[at]]] and level[self.to[arcs[next_[at]]]] == level[at] + 1):
                    next_[at] += 1
                if next_[at] < len(arcs):
                    path.append(arcs[next_[at]])
                    at = self.to[path[-1]]
                elif at == start:
                    break
                else:
                    at = self.to[path.pop() ^ 1]
                    next_[at] += 1


def min_cost_flow(supply: list[int], demand: list[int], member: list[tuple[int, ...]], copies: int) -> list[list[dict[int, int]]]:
    """flow[pattern][copy][quota]: fills the quotas as far as the patterns can, at the least repetition cost.

    Nodes: start, patterns, quotas, end. Each copy of a pattern has its whole supply as capacity and costs more a token
    than the copies before, whatever the pattern. A cheapest augmenting path leaves the start by the cheapest copies that
    still have room and costs nothing more on its way, so the flow of least cost is a largest flow with one copy, added to
    until it is a largest one with two, and so on.
    """
    n, m = len(supply), len(demand)
    net, end = Network(2 + n + m), 1 + n + m
    first = [net.arc(0, 1 + p, 0) for p in range(n)]
    serves = [[(q, net.arc(1 + p, 1 + n + q, supply[p] * copies)) for q in member[p]] for p in range(n)]
    for q in range(m):
        net.arc(1 + n + q, end, demand[q])
    for _ in range(copies):
        for p in range(n):
            net.room[first[p]] += supply[p]
        net.fill(0, end)
    flow = []
    for p in range(n):
        out, parts = {q: net.room[e ^ 1] for q, e in serves[p]}, []
        for _ in range(copies):  # cheapest copies fill first, whatever quota they serve
            room, part = supply[p], {}
            for q in out:
                if take := min(room, out[q]):
                    part[q], out[q], room = take, out[q] - take, room - take
            parts.append(part)
        flow.append(parts)
    return flow


def place(doc_id: Column, seed: int) -> Column:
    """A document's place in the seeded order, 0 to 2**52 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")


ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def mix(docs: DataFrame, members: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = SEED, names: tuple[str, ...] = ADDED) -> DataFrame:
    """docs with the document's size, its sources' size and target, and how often the mix takes the document, under names.

    members: an array of the sources to which a document may be counted; by default only its own.
    """
    spark = docs.sparkSession
    own = F.array(F.col(source_col).cast("string")) if members is None else members
    size, pattern, at, key, bounds, target, source_size = free_name(docs, "size", "pattern", "at", "key", "bounds", "target", "source_size")
    # Null sources have a mark of their own.
    named = F.array_sort(F.array_distinct(F.transform(own, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~")))))
    measures = {size: words_in(F.col(text_col)), pattern: F.coalesce(named, F.array().cast("array<string>")), at: place(F.col(id_col), seed)}
    slice_of = F.floor(F.col("at") / (2**52 // SLICES)).cast("int")
    sized = cut(docs.select(*(c.alias(n) for c, n in zip(measures.values(), ("words", "pattern", "at"), strict=True))).withColumn("slice", slice_of))
    slices = cut(sized.groupBy("pattern", "slice").agg(F.sum("words").alias("words")))
    sums = [r for r in slices.groupBy("pattern").agg(F.sum("words").alias("words")).collect() if r.pattern]
    sources = sorted({s for r in sums for s in r.pattern})
    number = {s: i for i, s in enumerate(sources)}
    # A source's size counts each document once, shared evenly where it may be counted to several.
    sizes = dict.fromkeys(sources, 0)
    for r in sums:
        for s in r.pattern:
            sizes[s] += r.words // len(r.pattern)
    targets = source_targets({None if s == "~" else s[1:]: n for s, n in sizes.items()}, weights, share, max_copies)
    by_name = {("~" if s is None else f"s{s}"): t for s, t in targets.items()}
    flow = min_cost_flow([r.words for r in sums], [round(by_name[s]) for s in sources], [tuple(number[s] for s in r.pattern) for r in sums], max_copies)
    wanted = [(r.pattern, c, sum(part.values())) for r, parts in zip(sums, flow, strict=True) for c, part in enumerate(parts)]
    quota = small_table(spark, wanted, "pattern array<string>, copy int, wanted long")
    # The slice in which a flow ends: at most SLICES rows a pattern are ordered here, whatever the number of documents.
    upto = slices.join(quota, "pattern").withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("pattern", "copy").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cuts = upto.groupBy("pattern", "copy", "wanted").agg(F.min(F.when(F.col("before") + F.col("words") > F.col("wanted"), F.struct("slice", "before"))).alias("part"))
    last = cut(cuts.select("pattern", "copy", "wanted", F.col("part.slice").alias("slice"), F.col("part.before").alias("before")).where("slice IS NOT NULL"))
    # Of all documents, only those of such slices move: one in SLICES, or so.
    inside = sized.where("words > 0").join(F.broadcast(last), ["pattern", "slice"]).groupBy("pattern", "copy", "wanted", "before", "at").agg(F.sum("words").alias("words"))
    run = W.partitionBy("pattern", "copy").orderBy("at")
    ends = inside.withColumn("sum", F.col("before") + F.sum("words").over(run.rowsBetween(W.unboundedPreceding, 0)))
    # A document stays in if at least half of it lies within the flow.
    ends = ends.where("sum - words / 2.0 <= wanted").groupBy("pattern", "copy").agg(F.max("at").alias("last_at"))
    limits = quota.join(last.select("pattern", "copy", "slice"), ["pattern", "copy"], "left").join(ends, ["pattern", "copy"], "left")
    # One row a pattern: up to which place its documents are taken, copy by copy.
    bound = F.when(F.col("wanted") == 0, F.lit(-1)).when(F.col("slice").isNull(), F.lit(2**52)).otherwise(F.coalesce("last_at", F.col("slice").cast("long") * (2**52 // SLICES) - 1)).cast("long")
    limits = limits.groupBy("pattern").agg(F.array_agg(bound).alias("bounds"))
    facts = [(r.pattern, float(sum(by_name[s] for s in r.pattern)), sum(sizes[s] for s in r.pattern)) for r in sums]
    facts_ = small_table(spark, facts, "pattern array<string>, target double, source_size long").join(limits, "pattern")
    facts_ = facts_.select(F.col("pattern").alias(key), F.col("bounds").alias(bounds), F.col("target").alias(target), F.col("source_size").alias(source_size))
    joined = docs.withColumns(measures).join(F.broadcast(facts_), F.col(pattern) == F.col(key), "left")
    copies = F.when((F.col(size) == 0) | F.col(bounds).isNull(), F.lit(0)).otherwise(F.size(F.filter(F.col(bounds), lambda b: b >= F.col(at)))).cast("int")
    added = (F.col(size), F.coalesce(source_size, F.lit(0).cast("long")), F.coalesce(target, F.lit(0.0)), copies)
    taken = {n.lower() for n in names}
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken), *(c.alias(n) for c, n in zip(added, names, strict=True)))


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """docs' rows, each as often as the mix takes it."""
    names = free_name(docs, *ADDED)
    every = mix(docs, names=tuple(names), **how)
    return every.withColumn(names[3], F.explode(F.array_repeat(F.lit(1), F.col(names[3])))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def oracle(documents_view: str = "documents") -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)), 1, 13))::BIGINT AS place
  FROM {documents_view}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY {MAX_COPIES} * source_size / weight::DOUBLE, source NULLS LAST) AS k FROM w),
c AS (SELECT *, {SHARE} * sum(source_size) OVER () - coalesce(sum({MAX_COPIES} * source_size) OVER b, 0) AS rest,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight
      FROM r WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS k FROM c WHERE weight * (rest / open_weight) < {MAX_COPIES} * source_size),
level AS (SELECT rest::DOUBLE / open_weight AS level FROM c WHERE k = (SELECT k FROM f)),
t AS (SELECT source, source_size, CASE WHEN k < coalesce((SELECT k FROM f), 1000000) THEN {MAX_COPIES} * source_size::DOUBLE ELSE weight * (SELECT level FROM level) END AS target FROM r),
q AS (SELECT *, round_even(target, 0)::BIGINT AS whole FROM t),
copies AS (SELECT source, source_size, target, copy, least(source_size, greatest(0, whole - copy * source_size)) AS wanted FROM q, range({MAX_COPIES}) g(copy)),
e AS (SELECT d.source, d.place, sum(size) AS words FROM d WHERE size > 0 GROUP BY d.source, d.place),
run AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM e),
b AS (SELECT c.source, copy, CASE WHEN wanted = 0 THEN -1 ELSE max(place) FILTER (WHERE upto - words / 2.0 <= wanted) END AS bound
      FROM copies c JOIN run ON run.source IS NOT DISTINCT FROM c.source GROUP BY c.source, copy, wanted)
SELECT d.doc_id, d.size, q.source_size, q.target,
       (d.size * (SELECT count(*) FROM b WHERE b.source IS NOT DISTINCT FROM d.source AND b.bound >= d.place))::BIGINT AS taken
FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source
"""


ORACLE = oracle()
