"""Tables that workers map, and models that don't pass through the driver."""

from __future__ import annotations

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import toxicity


@pytest.mark.parametrize("part_keys", [1 << 20, 300])
def test_stored_tables_find_what_is_there(spark, monkeypatch, part_keys):
    from spanforge.llm import common, stored_table
    from spanforge.llm.hashing import mix

    monkeypatch.setattr(stored_table, "PART_KEYS", part_keys)
    n = 5000
    keys = mix(np.arange(1, n + 1).astype(np.uint64))
    assert len(np.unique(keys)) == n
    rows = [(0, int(k), float(i), None if i % 3 else -float(i)) for i, k in enumerate(keys.view(np.int64))]
    rows += [(2, int(keys.view(np.int64)[0]), 7.0, 8.0)]
    df = spark.createDataFrame(rows, "table long, key long, v0 double, v1 double").repartition(3).withColumn("v1", F.coalesce("v1", F.lit(float("nan"))))
    whole, none, one = stored_table.stored(df, [n, 0, 1], 2, common.shared_folder(spark, "tables"))
    assert len(whole.files) == (1 if part_keys > n else 32) and not none.files and len(one.files) == 1
    asked = np.r_[keys, keys ^ np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]
    there = np.r_[np.ones(n, bool), np.zeros(n + 2, bool)]
    assert (whole.get(asked, -1.0) == np.where(there, np.r_[np.arange(n), np.zeros(n + 2)], -1.0)).all()
    other = np.arange(len(asked), dtype=float)  # a default for each key, which also stands in for no number
    assert (whole.get(asked, other, 1) == np.where(there & (other % 3 == 0), -other, other)).all()
    assert (none.get(keys, 5.0) == 5).all() and len(whole.get(keys[:0], 0.0)) == 0
    assert one.get(keys[:2], 0.0, 1).tolist() == [8.0, 0.0]


def test_files_of_a_store_that_is_not_mounted_are_copied_once(spark, monkeypatch, tmp_path):
    from pyarrow import fs

    from spanforge.llm import stored_table

    source = tmp_path / "0-0-a"
    source.write_bytes(b"some bytes")
    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path / "own"))
    os.mkdir(tmp_path / "own")
    assert stored_table._local(str(source)) == str(source)
    monkeypatch.setattr(stored_table, "opened", lambda path: (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), os.path.basename(path)))
    copy = stored_table._local("store://0-0-a")
    assert copy != str(source) and open(copy, "rb").read() == b"some bytes"
    assert stored_table._local("store://0-0-a") == copy and len(os.listdir(tmp_path / "own")) == 1


def test_toxicity_models_do_not_pass_through_the_driver(spark, stored, monkeypatch):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    rows = [(i, " ".join(r.choice([*vocabulary, "vile"] if i % 4 == 0 else vocabulary) for _ in range(60))) for i in range(600)]
    docs = stored(rows, "doc_id long, text string")
    labels = stored([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    kind, seen = type(spark.range(1)), []
    for name in ("collect", "toArrow", "toPandas"):
        of = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *a, of=of: seen.append(len(out := of(self, *a))) or out)
    broadcast, sent = type(spark.sparkContext).broadcast, []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or broadcast(self, value))
    models, _ = toxicity.train(docs, labels)
    assert max(seen) < 100 and not sent
    assert sum(n for _, n in models.ratios[1].files.values()) > 3000
