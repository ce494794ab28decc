"""Prefix trie of conversations: which beginnings conversations share, and what sharing them saves.

A turn is known by a digest of its role and text, made where the text is read; from there on only digests and lengths move. A
conversation's path is the row of its turns' digests. Conversations with one path are one sequence with a number of members,
aggregated before they meet; the members' ids are joined in blocks of neighbouring ids, and blocks are hashed as a stream, so
that no list of a hot conversation's members is ever held.

Sequences are dealt by the digest of their first turn: those that share it make up a subtrie. A subtrie of more than
``group_turns`` turns is dealt again by the first turn in which its sequences differ, and so on. ``applyInPandas`` gets buckets
of whole subtries, of about ``bucket_turns`` turns in all, and builds them as nodes with dictionaries of children, which are
worked off in postorder without recursion. What lies above a subtrie's top is a path that its sequences share; those few
nodes are summed up from the tops by Spark.

Defined results: turns without a number come first, turns of one number go by the digest of their content; a null role or
text is empty; rows without a conversation's id belong to none and are left out; repeated rows are turns of their own; other
columns, whatever their names, are not read; an empty table has no nodes, not even a root. A turn's text may be of any
length; the digests and lengths of one conversation (20 bytes a turn) are together in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.runtime import ship_package
from spanforge.llm.common import cut, table, through_python

DIGEST = 16
#: Turns of a subtrie that isn't dealt again, and of a bucket of subtries.
GROUP_TURNS, BUCKET_TURNS = 1 << 12, 1 << 15
#: Conversations' ids are joined in blocks of 2^BLOCK_BITS neighbouring numbers.
BLOCK_BITS = 8
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations share the beginning of one in so many, of up to HEAD - 1 turns.
FAMILY, HEAD = 100, 6

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq): every conversation's turns in order, as digests d and lengths n in code points."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256)), 1, DIGEST)
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("at"), digest.alias("d"), F.char_length(said).cast("long").alias("n")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("seq"))


def with_heads(seqs: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % FAMILY; h = crc32(c) % HEAD."""
    seqs = cut(seqs)
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = seqs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, HEAD - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    own = F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("seq", 1, 0))
    return seqs.withColumn("base", base).join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("seq"))


def _prefix(path: str | Column, depth: Column) -> Column:
    return F.substring(path if isinstance(path, Column) else F.col(path), F.lit(1), (depth * DIGEST).cast("int"))


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """(path, sizes, n, conv_id, ends): each distinct sequence, its members' number and smallest id, and their ids' hash."""
    path = F.unhex(F.array_join(F.transform("seq", lambda t: F.hex(t["d"])), ""))
    blocks = seqs.select("conv_id", path.alias("path"), F.transform("seq", lambda t: t["n"]).alias("sizes"), F.shiftright("conv_id", BLOCK_BITS).alias("block"))
    blocks = blocks.groupBy("path", "block").agg(F.first("sizes").alias("sizes"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("path", "sizes", "block", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("conv_id"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sizes", "n", "conv_id", "ends"]
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        now, digest = None, None
        for batch in it:
            rows = []
            for path, sizes, n, first, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "conv_id", "ids")), strict=True):
                if now and now[0] == path:
                    now[2] += n
                    digest.update(f",{ids}".encode())
                else:
                    if now:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = [path, sizes, n, first], hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*now, digest.hexdigest()), kinds, strict=True)], names)

    return through_python(blocks.repartition("path").sortWithinPartitions("path", "block"), hashed, "path binary, sizes array<long>, n long, conv_id long, ends string")


def _common(lo: str, hi: str) -> Column:
    """How many turns two paths begin with in common."""
    turns = (F.least(F.length(lo), F.length(hi)) / DIGEST).cast("int")
    at = lambda path, i: F.substring(F.col(path), (i - 1) * DIGEST + 1, F.lit(DIGEST))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), turns), lambda i: at(lo, i) == at(hi, i)), False)
    return F.when(differs > 0, differs - 1).otherwise(turns).cast("long")


def subtries(seqs: DataFrame, group_turns: int = GROUP_TURNS) -> tuple[DataFrame, DataFrame]:
    """Sequences with the depth of their subtrie's top; and those that end above all tops."""
    done, above = [], []
    rest = seqs.where(F.length("path") > 0).withColumn("depth", F.lit(1).cast("long"))
    while True:
        keyed = rest.withColumn("key", _prefix("path", F.col("depth")))
        groups = keyed.groupBy("key").agg(F.sum(F.size("sizes")).alias("turns"), F.count(F.lit(1)).alias("members"), F.min("path").alias("lo"), F.max("path").alias("hi"))
        large = cut(groups.where((F.col("turns") > group_turns) & (F.col("members") > 1)).select("key", _common("lo", "hi").alias("common")))
        if large.isEmpty():
            done.append(keyed.drop("key"))
            break
        marked = keyed.join(large, "key", "left").drop("key")
        done.append(marked.where("common IS NULL").drop("common"))
        # Between the old top and the turn in which its sequences first differ there is one path; the new tops lie below it.
        again = cut(marked.where("common IS NOT NULL"))
        ends = F.length("path") == F.col("common") * DIGEST
        above.append(again.where(ends).withColumn("depth", F.col("common")).drop("common"))
        rest = again.where(~ends).withColumn("depth", F.col("common") + 1).drop("common")
    above.append(seqs.where(F.length("path") == 0).withColumn("depth", F.lit(0).cast("long")))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, above)


class Nodes:
    """A trie as lists: what each node has, and its children by their turns' digests."""

    def __init__(self) -> None:
        self.depth: list[int] = []
        self.size: list[int] = []
        self.n: list[int] = []
        self.conv: list[int] = []
        self.ends: list[str] = []
        self.children: list[dict[bytes, int]] = []

    def add(self, depth: int, size: int, conv: int) -> int:
        self.depth.append(depth)
        self.size.append(size)
        self.n.append(0)
        self.conv.append(conv)
        self.ends.append(NO_ENDS)
        self.children.append({})
        return len(self.n) - 1

    def insert(self, top: int, path: bytes, sizes: list[int], n: int, conv: int, ends: str) -> None:
        at = top
        for d in range(self.depth[top], len(sizes) + 1):
            if d > self.depth[top]:
                digest = path[(d - 1) * DIGEST : d * DIGEST]
                below = self.children[at].get(digest)
                if below is None:
                    below = self.children[at][digest] = self.add(d, sizes[d - 1], conv)
                at = below
            self.n[at] += n
            self.conv[at] = min(self.conv[at], conv)
        self.ends[at] = ends

    def rows(self, top: int) -> Iterator[tuple]:
        """(node, parent or None, leaves, saved) of all nodes from top on, children before their parents."""
        order, stack = [], [(top, None)]
        while stack:
            node, parent = stack.pop()
            order.append((node, parent))
            stack.extend((child, node) for child in self.children[node].values())
        leaves, saved = dict.fromkeys((n for n, _ in order), 0), {}
        for node, parent in reversed(order):
            leaves[node] = leaves[node] or 1
            saved[node] = saved.get(node, 0) + (self.n[node] - 1) * self.size[node]
            if parent is not None:
                leaves[parent] += leaves[node]
                saved[parent] = saved.get(parent, 0) + saved[node]
            yield node, parent, leaves[node], saved[node]


def _built(bucket: pd.DataFrame) -> pd.DataFrame:
    tries, tops, shared = Nodes(), {}, {}
    for path, sizes, n, conv, ends, depth in zip(*(bucket[c] for c in ("path", "sizes", "n", "conv_id", "ends", "depth")), strict=True):
        path, key = bytes(path), bytes(path[: depth * DIGEST])
        sizes = sizes.tolist()
        if key not in tops:
            tops[key] = tries.add(depth, sizes[depth - 1], conv)
            shared[key] = sizes[:depth]
        tries.insert(tops[key], path, sizes, n, conv, ends)
    rows = []
    for key, top in tops.items():
        for node, parent, leaves, saved in tries.rows(top):
            is_top = parent is None
            rows.append((tries.conv[node], tries.depth[node], None if is_top else tries.conv[parent], tries.n[node], len(tries.children[node]), leaves, saved, tries.ends[node], key if is_top else None, shared[key] if is_top else None))
    out = pd.DataFrame(rows, columns=[*(c.split()[0] for c in _NODE.split(", ")), "path", "sizes"])
    return out.astype({"parent_conv_id": "Int64"})


def trie(seqs: DataFrame, group_turns: int = GROUP_TURNS, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """One row per node of the trie of (conv_id, seq)."""
    names = [c.split()[0] for c in _NODE.split(", ")]
    ship_package(seqs.sparkSession)
    found = cut(distinct_sequences(seqs))
    turns = found.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    parts, above = subtries(found, group_turns)
    buckets = max(1, -(-turns // bucket_turns))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64(_prefix("path", F.col("depth"))), F.lit(buckets)))
    built = cut(parts.groupBy("bucket").applyInPandas(_built, f"{_NODE}, path binary, sizes array<long>"))
    tops = built.where("path IS NOT NULL")

    # The nodes above tops, from the tops and the sequences that end there: first by node and child, then by node.
    below = tops.select("path", "sizes", "depth", F.col("n_convs").alias("n"), "conv_id", F.lit(None).cast("string").alias("ends"), "n_leaves", "saved_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("at"))
    ended = above.select("path", "sizes", "depth", "n", "conv_id", "ends", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))).alias("at"))
    sums = [F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends").alias("ends"), F.max("size").alias("size")]
    here = F.col("at") == F.col("depth")
    steps = below.unionByName(ended).select(
        "at", _prefix("path", F.col("at")).alias("node"), F.when(~here, _prefix("path", F.col("at") + 1)).alias("child"), "n", "conv_id", "n_leaves", "saved_tokens",
        F.when(here, F.col("ends")).alias("ends"), F.when(F.col("at") > 0, F.get("sizes", (F.col("at") - 1).cast("int"))).otherwise(0).alias("size"),
    )
    upper = cut(steps.groupBy("at", "node", "child").agg(*sums).groupBy("at", "node").agg(*sums, F.count("child").alias("n_children")))
    own = upper.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("up"), "node", ((F.col("n") - 1) * F.col("size")).alias("saved"))
    own = own.groupBy(_prefix("node", F.col("up")).alias("node")).agg(F.sum("saved").alias("own"))
    upper = upper.join(own, "node").select(
        "node", "conv_id", F.col("at").alias("depth"), F.col("n").alias("n_convs"), "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    upper = cut(upper)
    root = upper.where("depth = 0").first()
    first = F.lit(root.conv_id if root else None).cast("long")
    parents = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Children of the root, the most of all, need no join.
    deep = tops.drop("parent_conv_id", "sizes").withColumnRenamed("path", "node").unionByName(upper).where("depth > 1")
    deep = deep.withColumn("parent", _prefix("node", F.col("depth") - 1)).join(parents, "parent")
    flat = tops.select(*names).unionByName(upper.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names)).where("depth <= 1")
    flat = flat.withColumn("parent_conv_id", F.when(F.col("depth") == 1, first))
    return built.where("path IS NULL").select(*names).unionByName(flat).unionByName(deep.select(*names))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(with_heads(sequences_of(table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH crc AS (  -- CRC-32 of decimal numbers, bit by bit
    SELECT conv_id, xor(list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, length(coalesce(text, '')) AS n,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
    SELECT c.conv_id, t.k, t.d, t.n FROM crc c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.k <= c.h
    UNION ALL
    SELECT c.conv_id, t.k, t.d, t.n FROM crc c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
seqs AS (
    SELECT c.conv_id, coalesce(r.ds, []) AS ds, coalesce(r.ns, []) AS ns
    FROM crc c LEFT JOIN (SELECT conv_id, list(d ORDER BY k) AS ds, list(n ORDER BY k) AS ns FROM rebuilt GROUP BY conv_id) r USING (conv_id)),
prefixes AS (
    SELECT conv_id, i AS depth, array_to_string(ds[1:i], '') AS node, CASE WHEN i > 0 THEN ns[i] ELSE 0 END AS n, i = len(ds) AS last
    FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS i FROM seqs)),
nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS own,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth),
children AS (SELECT node[:64 * (depth - 1)] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
marked AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
below AS (
    SELECT node[:64 * i] AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM marked) GROUP BY ALL)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves, b.saved_tokens, m.ends_sha256
FROM marked m JOIN below b USING (node) LEFT JOIN nodes p ON m.depth > 0 AND p.node = m.node[:64 * (m.depth - 1)]
"""
