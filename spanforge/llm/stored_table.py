"""Tables of numbers by evenly spread 64-bit keys, larger than the driver or a worker should hold: tasks write them to the
shared checkpoint folder, in files of keys with the same first bits, and workers map these files and look up many keys at
a time. Where the folder is no mounted one, a worker first copies the files that it is asked for to its own disk.

Keys of a table are distinct; a table without rows has no files; a value that is not a number stands for none.
"""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.runtime import opened
from spanforge.llm.common import through_python
from spanforge.llm.hashing import U

#: Keys of a file, about; it is put together in memory.
PART_KEYS = 1 << 18


def _local(path: str) -> str:
    """The file's path on a mounted disk. A copy is made once for all workers that share a folder for temporary files."""
    from pyarrow import fs

    store, at = opened(path)
    if isinstance(store, fs.LocalFileSystem):
        return at
    copy = os.path.join(tempfile.gettempdir(), f"spanforge-{os.path.basename(at)}")
    if not os.path.exists(copy):
        own = f"{copy}-{uuid.uuid4().hex}"
        with store.open_input_stream(at) as source, open(own, "wb") as target:
            shutil.copyfileobj(source, target, 1 << 20)
        os.replace(own, copy)
    return copy


def _begins(keys: np.ndarray, bits: int, step: int) -> np.ndarray:
    """Which of 2**step parts of a file each key falls into, by the bits after the first ones."""
    return (keys << U(bits) >> U(64 - step)).astype(np.int64) if step else np.zeros(len(keys), np.int64)


@lru_cache(512)
def _mapped(path: str, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, values by column, both with one place more at their ends, and where each part begins."""
    with open(_local(path), "rb") as f:
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    keys = np.frombuffer(whole, U, n + 1)
    values = np.frombuffer(whole, float, width * (n + 1), keys.nbytes).reshape(width, n + 1)
    return keys, values, np.frombuffer(whole, np.int32, -1, keys.nbytes + values.nbytes)


@dataclass(frozen=True)
class StoredTable:
    """files: path and number of keys, by a key's first bits."""

    bits: int
    width: int
    files: dict[int, tuple[str, int]]

    def _in(self, file: int, keys: np.ndarray, column: int) -> np.ndarray:
        if file not in self.files:
            return np.full(len(keys), np.nan)
        held, values, begins = _mapped(*self.files[file], self.width)
        at = begins[_begins(keys, self.bits, len(begins).bit_length() - 1)]
        left = np.flatnonzero(held[at] < keys)
        while len(left):
            at[left] += 1
            left = left[held[at[left]] < keys[left]]
        return np.where(held[at] == keys, values[column, at], np.nan)

    def get(self, keys: np.ndarray, default: np.ndarray | float, column: int = 0) -> np.ndarray:
        if not self.bits:
            found = self._in(0, keys, column)
        else:
            file = (keys >> U(64 - self.bits)).astype(np.uint16)
            by = np.argsort(file, kind="stable")
            ends = np.searchsorted(file[by], np.arange((1 << self.bits) + 1)).tolist()
            found = np.empty(len(keys))
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    found[by[a:b]] = self._in(i, keys[by[a:b]], column)
        return np.where(np.isnan(found), default, found)


def stored(rows: DataFrame, sizes: list[int], width: int, folder: str) -> list[StoredTable]:
    """A table of ``width`` columns for each of the sizes, which its number of keys doesn't exceed by much. rows: table, its
    place in sizes; key; and the values v0, v1, ... One small row a file reaches the driver."""
    bits = [min(16, max(0, -(-n // PART_KEYS) - 1).bit_length()) for n in sizes]
    values = [f"v{i}" for i in range(width)]

    def put(file: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = np.concatenate([b.column(1).to_numpy().view(U) for b in held])
        by = np.argsort(keys)
        keys, n, own = keys[by], len(keys), bits[file >> 32]
        step = max(n - 1, 0).bit_length()
        begins = np.searchsorted(_begins(keys, own, step), np.arange(1 << step)).astype(np.int32)
        store, at = opened(path := f"{folder}/{file >> 32}-{file & 0xFFFFFFFF}-{uuid.uuid4().hex}")
        with store.open_output_stream(at) as f:
            f.write(np.r_[keys, ~U(0)].tobytes())
            for i in range(width):
                f.write(np.r_[np.concatenate([b.column(2 + i).to_numpy() for b in held])[by], np.nan].tobytes())
            f.write(begins.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([path]), pa.array([n])], ["file", "path", "n"])

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], -1
        for batch in it:
            file = batch.column(0).to_numpy()
            bounds = np.flatnonzero(np.r_[True, file[1:] != file[:-1]]).tolist() if len(file) else []
            for a, b in zip(bounds, [*bounds[1:], len(file)], strict=True):
                if held and file[a] != now:
                    yield put(now, held)
                    held = []
                now = int(file[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield put(now, held)

    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    # By a Column, as a second worker in the same task would double the memory that workers take.
    first = F.lit(0).cast("long")
    for table, b in enumerate(bits):
        if b:
            first = F.when(F.col("table") == table, F.shiftrightunsigned("key", 64 - b)).otherwise(first)
    moved = rows.select((F.shiftleft("table", 32) + first).alias("file"), "key", *values).repartition("file").sortWithinPartitions("file")
    found: list[dict[int, tuple[str, int]]] = [{} for _ in sizes]
    for r in through_python(moved, written, "file long, path string, n long").collect():
        found[r.file >> 32][r.file & 0xFFFFFFFF] = (r.path, r.n)
    return [StoredTable(b, width, files) for b, files in zip(bits, found, strict=True)]
