"""Keyed upsert against a table that is changed in memory."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanforge.llm import keyed_upsert

SF = "/root/testdata/sf0.001"
CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def expected(clients, changes):
    """(rows, rewritten) of every file."""
    most = 1 + len(clients) // 1000
    names = [c.split()[0] for c in CLIENTS.split(", ")]
    start = sorted((c for c in clients if c["client_id"] is not None and crc(c["client_id"]) % 7 > 3), key=lambda c: c["client_id"])
    files = [start[i : i + most] for i in range(0, len(start), most)]
    if not files:
        return []
    firsts = [f[0]["client_id"] for f in files]
    best = {}
    low = -math.inf
    for c in changes:
        if c["client_id"] is not None:
            rank = tuple(low if c[k] is None else c[k] for k in ("seq", "change_id"))
            if c["client_id"] not in best or rank > best[c["client_id"]][0]:
                best[c["client_id"]] = rank, c
    after = [{r["client_id"]: dict(r) for r in f} for f in files]
    for i, (_, c) in best.items():
        home = max([k for k, first in enumerate(firsts) if first <= i], default=0)
        h = crc(firsts[home]) % 16
        if h > 7:
            continue
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            after[home].pop(i, None)
        else:
            row = after[home].setdefault(i, dict.fromkeys(names) | {"client_id": i})
            row.update({k: c[k] for k in ("source", "segment", "city", "balance")})
    out = []
    for f, now in zip(files, after, strict=True):
        rows = sorted(now.values(), key=lambda r: r["client_id"])
        if rows == f:
            out.append((f, False))
            continue
        parts, at = -(-len(rows) // most), 0
        for k in range(parts):
            size = len(rows) // parts + (k < len(rows) % parts)
            part, at = rows[at : at + size], at + size
            if k == 0 and out and out[-1][1] and len(out[-1][0]) + len(part) <= most or k and len(out[-1][0]) + len(part) <= most:
                out[-1] = out[-1][0] + part, True
            else:
                out.append((part, True))
    return out


def told(rows, rewritten):
    cents = sum(math.floor(100 * r["balance"] + 0.5) for r in rows if r["balance"] is not None)
    sums = sum(zlib.crc32("|".join(r[k] or "" for k in ("source", "segment", "city")).encode()) for r in rows)
    ids = hashlib.sha256(",".join(str(r["client_id"]) for r in rows).encode()).hexdigest()
    return rows[0]["client_id"], len(rows), cents, sums, ids, ",".join(c.split()[0] for c in CLIENTS.split(", ")), rewritten


def check(spark, folder):
    got = keyed_upsert.op13_keyed_upsert(spark, folder).collect()
    want = expected(pq.read_table(f"{folder}/clients.parquet").to_pylist(), pq.read_table(f"{folder}/client_changes.parquet").to_pylist())
    assert sorted((r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in got) == sorted(told(*x) for x in want)
    rows = {x[0][0]["client_id"]: x[0] for x in want}
    for r in got:
        assert pq.read_table(r.path).to_pylist() == rows[r.first_id]
    if got:
        there = [p for p in glob.glob(os.path.dirname(os.path.dirname(got[0].path)) + "/**", recursive=True) if os.path.isfile(p)]
        assert {os.path.basename(p) for p in there if not p.endswith(".crc")} == {os.path.basename(r.path) for r in got}
    return got


@pytest.fixture
def tables(spark, tmp_path):
    def make(clients, changes):
        for name, rows, schema in (("clients", clients, CLIENTS), ("client_changes", changes, CHANGES)):
            spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/t/{name}.parquet")
        return f"{tmp_path}/t"

    return make


def client(i, r):
    return (i, i, r.choice(["web", None]), None, f"n{i}", None, r.choice(["ä", "b", None]), 1, r.choice(["s", None]), r.choice([None, -0.005, 1.25, 10.0]))


def change(k, i, r, op=None):
    return (k, i, r.choice([None, *range(5)]), op or r.choice(["U", "I", "D", None]), None, r.choice(["web", None]), r.choice(["s", None]), r.choice(["b", None]), r.choice([None, 1.25, 7.0]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_brute_force(spark):
    got = check(spark, SF)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_awkward_rows(spark, tables, seed):
    r = random.Random(seed)
    n = [60, 1100, 2100][seed]
    clients = [client(i, r) for i in r.sample(range(-100, 3 * n), n)] + [client(None, r)] * 3
    changes = [change(k, r.choice([None, 7, *range(-200, 4 * n)]), r) for k in range(3 * n)]
    changes += [change(None, 7, r)] + [changes[0]] * 3
    check(spark, tables(clients, changes))


def test_empty_tables(spark, tables):
    r = random.Random(1)
    assert check(spark, tables([], [change(1, 2, r)])) == []
    assert not any(x.rewritten for x in check(spark, tables([client(i, r) for i in range(30)], [])))


def test_everything_goes(spark, tables):
    r = random.Random(2)
    got = check(spark, tables([client(i, r) for i in range(40)], [change(i, i, r, "D") for i in range(40)]))
    assert not any(x.rewritten for x in got)


@pytest.mark.parametrize("segment", [3, 40])
def test_hot_home_is_joined_in_segments(spark, tables, monkeypatch, segment):
    monkeypatch.setattr(keyed_upsert, "SEGMENT_KEYS", segment)
    r = random.Random(3)
    clients = [client(i, r) for i in range(1100)]
    check(spark, tables(clients, [change(k, i, r, "U") for k, i in enumerate([*range(1100, 1500), *range(0, 1100, 9), *range(-200, 0)])]))


def test_general_form(spark, tmp_path):
    """Other columns and types, clashing names, repeated keys, columns that changes lack."""
    rows = [(k, f"v{k}", [k], None) for k in (5, 1, 1, 9, 3, 7, None)]
    df = spark.createDataFrame(rows, 'home long, number string, `seg"ment` array<long>, place double')
    files = keyed_upsert.stored(df, "home", 2, f"file:{tmp_path}/t")
    assert [(f.first, f.rows) for f in files] == [(1, 2), (3, 2), (7, 2)]
    changes = spark.createDataFrame([(1, 1, "new"), (4, 1, "in"), (9, 1, "old"), (9, 2, "last"), (11, 1, "x"), (12, 1, "y"), (3, 1, None)], "home long, number long, place string").withColumnRenamed("place", "what").withColumnRenamed("number", "seq").withColumnRenamed("what", "number")
    files = keyed_upsert.upsert(spark, files, f"file:{tmp_path}/t", changes, ["seq"], ["number"], deletes=lambda h: h < 0, ignores=lambda h: False, rows_per_file=2)
    got = [pq.read_table(keyed_upsert._plain(f.path)).to_pylist() for f in files]
    assert [[(r["home"], r["number"]) for r in f] for f in got] == [[(1, "new"), (1, "new")], [(3, None), (4, "in")], [(5, "v5")], [(7, "v7"), (9, "last")], [(11, "x"), (12, "y")]]
    assert [f.rewritten for f in files] == [True] * 5
    assert got[0][0]['seg"ment'] == [1] and got[1][1]['seg"ment'] is None


def test_plan_joins_left_neighbours():
    plan = lambda homes, most: [(p.number, p.part, p.rows, p.sources) for p in keyed_upsert.planned(homes, most)]
    assert plan([(0, [("a", 2)]), (1, [("b", 2)]), (2, [("c", 0)]), (3, [("d", 1)]), (4, None), (5, [("e", 1)])], 5) == [(0, 0, 5, [("a", 0, 2), ("b", 0, 2), ("d", 0, 1)]), (5, 0, 1, [("e", 0, 1)])]
    assert plan([(0, [("a", 4), ("b", 0), ("c", 3)])], 3) == [(0, 0, 3, [("a", 0, 3)]), (0, 1, 2, [("a", 3, 1), ("c", 0, 1)]), (0, 2, 2, [("c", 1, 2)])]


def test_slices_of_a_file(tmp_path):
    path = str(tmp_path / "f.parquet")
    pq.write_table(pa.table({"a": list(range(100))}), path, row_group_size=7)
    for skip, take in ((0, None), (13, 20), (14, 7), (95, 5), (99, 1), (0, 0)):
        got = [x for b in keyed_upsert._batches_of(path, skip, take) for x in b.column(0).to_pylist()]
        assert got == list(range(100))[skip : None if take is None else skip + take]
