"""The trie of conversations against prefixes that are listed one by one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spanforge.llm import conversation_trie as ct

TURNS = "conv_id long, turn long, role string, text string, path string, sizes int, depth int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def with_heads(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def nodes(seqs):
    members, last = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        last[tuple(s)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(last[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def story(r, convs, share):
    rows = []
    for c in range(convs):
        n = r.randint(1, 9)
        hot = r.random() < share
        for k in range(n):
            same = hot and (k < 3 or r.random() < 0.7)
            rows.append((c, k, r.choice(["user", None]) if not same else "user", f"turn {k}" if same else r.choice([None, "", "x", "ünï 😀", str(r.random())])))
    return rows


@pytest.mark.parametrize(("seed", "group", "bucket"), [(1, 1 << 12, 1 << 15), (2, 40, 100), (3, 5, 10), (4, 1, 1)])
def test_nodes_equal_all_prefixes(spark, stored, seed, group, bucket):
    rows = story(random.Random(seed), 250, 0.5)
    table = stored([(*r, "clash", 1, 2) for r in rows], TURNS, 3)
    df = ct.trie(ct.with_heads(ct.sequences_of(table)), group, bucket)
    assert got(df) == nodes(with_heads(ordered(rows)))


def test_awkward_rows(spark, stored):
    rows = [(7, None, "user", "first"), (7, 1, None, "b"), (7, 1, None, "b"), (None, 0, "user", "nobody's"), (100, 0, "user", "base"), (100, 1, "user", None), (101, 0, "user", "own"), (-5, 0, "user", "below"), (250, 3, None, None), (1 << 60, 0, "user", "x" * 100_000)]
    table = stored([(*r, None, None, None) for r in rows], TURNS, 2)
    for group in (1 << 12, 1):
        assert got(ct.trie(ct.with_heads(ct.sequences_of(table)), group)) == nodes(with_heads(ordered(rows)))
    assert ct.trie(ct.with_heads(ct.sequences_of(stored([], TURNS, 1)))).collect() == []


def test_turnless_conversations(spark, stored):
    """A conversation whose few turns fall to a family that has no first one."""
    empty = [c for c in range(1, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6][:5]
    rows = [(c, 0, "user", "gone") for c in empty]
    assert got(ct.trie(ct.with_heads(ct.sequences_of(stored([(*r, None, None, None) for r in rows], TURNS, 1))))) == nodes(with_heads(ordered(rows)))


def test_long_shared_path_and_hot_copies(spark, stored):
    long = [("user", f"turn {k}") for k in range(300)]
    rows = [(c, k, *t) for c in range(30) for k, t in enumerate([*long[: 300 - c % 7], ("user", f"own {c % 10}")])]
    rows += [(1000 + c, 0, "user", "same") for c in range(1500)]
    table = stored([(*r, None, None, None) for r in rows], TURNS, 3)
    seqs = ct.sequences_of(table)
    assert got(ct.trie(seqs, 100, 1000)) == nodes(ordered(rows))
    done, above = ct.subtries(ct.distinct_sequences(seqs).cache(), 100)
    assert max(r.depth for r in done.collect()) > 290
