"""Keyed upsert of a table of sorted Parquet files by copying what changes and leaving every other file alone.

``stored`` writes a table as files of ``rows_per_file`` rows, sorted by the key. ``upsert`` applies changes to such files:

1. Of each key's changes one wins (aggregated before the shuffle, so that a hot key sends one row from each task).
2. A winner's home is the last file that begins at or below its key, else the first one. Winners are written as logs, one
   folder a home; the log of a home with many keys (say, of new keys past the last file) is cut at quantiles of its keys into
   segments.
3. One task per segment lets DuckDB join the file's rows with the log, full and by key, count the rows that come out and
   those that differ (IS DISTINCT FROM, so nulls are equal), and writes them, sorted, only where some differ.
4. From these counts, one small row a segment, the files to be are planned: the fewest of at most ``rows_per_file`` rows,
   cut as NTILE cuts, and then, in order, each joined to its rewritten left neighbour where both fit into one file.
5. One task per new file streams its rows from the segments into it; then files that were rewritten and all logs go.

Rows go from file to file in batches; DuckDB has ``JOIN_MEMORY`` and spills beyond it. The driver sees the list of files (key
and rows of each), and Spark's workers open the shared folder themselves. Data are written under a name of their own and
then moved, so a task that runs again does no harm; old files go last.

Defined results: a key's winning change is the highest by ``order``, nulls lowest, then by the other columns; rows without
a key are no part of a keyed table: ``stored`` leaves them out, as changes they are ignored; rows of the table that repeat a
key stay (of equal keys, the smaller by the other columns first) and are changed all together where they share the home;
changes to a table without files are ignored; columns that the table has and changes lack stay as they are, or null in an
inserted row; columns of changes that the table lacks are ignored; names may clash with any used here.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm.common import cut, free_name, removed, shared_checkpoints, small_table, table, through_python

#: Of a home's log, keys that one task joins; at least, or as many as four files have rows.
SEGMENT_KEYS = 10_000
QUANTILES = 1000
JOIN_MEMORY = "400MB"
#: Rows that are in memory of a file that is written.
GROUP_ROWS = 1 << 14
#: Rows of starting files that one task writes, at least, where there are more partitions than Spark's own number.
TASK_ROWS = 1 << 20


@dataclass(frozen=True)
class File:
    path: str
    first: int
    rows: int
    key: str
    rewritten: bool = False


def _opened(path: str):  # noqa: ANN202
    """A folder's or file's file system and its path there; plain paths are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class Written:
    """A sorted file in the making; it has its name once it is whole."""

    def __init__(self, folder: str, name: str, schema: pa.Schema) -> None:
        import pyarrow.parquet as pq

        self.store, self.folder = _opened(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.name, self.draft = f"{self.folder}/{name}", f"{self.folder}/_{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.draft)
        self.writer, self.rows = pq.ParquetWriter(self.stream, schema, compression="zstd"), 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch, row_group_size=GROUP_ROWS)
        self.rows += batch.num_rows

    def close(self) -> None:
        self.writer.close()
        self.stream.close()
        self.store.move(self.draft, self.name)


def _batches_of(path: str, skip: int = 0, take: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a file from skip on."""
    import pyarrow.parquet as pq

    store, where = _opened(path)
    with store.open_input_file(where) as f:
        file = pq.ParquetFile(f)
        groups, at = [], 0
        for g in range(file.metadata.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if at + n <= skip and not groups:
                skip -= n
            elif take is None or at < skip + take:
                groups.append(g)
                at += n
        for batch in file.iter_batches(GROUP_ROWS, row_groups=groups):
            passed = min(skip, batch.num_rows)
            batch, skip = batch.slice(passed), skip - passed
            if take is not None:
                batch = batch.slice(0, take)
                take -= batch.num_rows
            if batch.num_rows:
                yield batch
            if take == 0:
                return


def _row(**values: str | int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], pa.schema([(k, pa.string() if isinstance(v, str) else pa.int64()) for k, v in values.items()]))


def _shared_folder(spark: SparkSession) -> str:
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/upsert-{uuid.uuid4().hex}"


def _plain(path: str) -> str:
    return _opened(path)[1] if path.startswith("file:") else path


def stored(df: DataFrame, key: str, rows_per_file: int, folder: str) -> list[File]:
    """df as files of rows_per_file rows, the last with the rest, sorted by the key and then by the other columns."""
    spark = df.sparkSession
    place, number = free_name(df, "place", "number")
    order = [key, *(c for c in df.columns if c != key)]
    # Places within sorted ranges are kept; what a range's rows are numbered from follows from the ranges' sizes.
    ranged = df.where(F.col(key).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn(place, F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright(place, 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    total, starts = 0, {}
    for r in sizes:
        starts[r.part] = total
        total += r.n
    if not total:
        return []
    base = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[F.shiftright(place, 33)]
    rank = base + F.col(place).bitwiseAND((1 << 33) - 1)
    files = -(-total // rows_per_file)
    parts = min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS)))
    dealt = ranged.withColumn(number, F.floor(rank / F.lit(rows_per_file)).cast("long")).repartition(parts, number).sortWithinPartitions(number, place)
    n_columns, key_at = len(df.columns), df.columns.index(key)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now, first = None, None, None

        def closed() -> pa.RecordBatch:
            file.close()
            return _row(path=f"{folder}/{name_of(now)}", first=first, n=file.rows)

        for batch in it:
            numbers = batch.column(n_columns + 1).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a).select(list(range(n_columns)))
                if numbers[a] != now:
                    if file:
                        yield closed()
                    now, first = int(numbers[a]), part.column(key_at)[0].as_py()
                    file = Written(folder, name_of(now), part.schema)
                file.add(part)
        if file:
            yield closed()

    found = cut(through_python(dealt, batches, "path string, first long, n long"))
    return sorted((File(r.path, r.first, r.n, key) for r in found.collect()), key=lambda f: f.path)


def name_of(number: int, part: int | None = None) -> str:
    return f"part-{number:07d}.parquet" if part is None else f"part-{number:07d}-{part:07d}.parquet"


def homes_of(keys: np.ndarray, firsts: list[int]) -> np.ndarray:
    """Which file each key belongs to."""
    return np.maximum(np.searchsorted(np.array(firsts, np.int64), keys, "right") - 1, 0)


def _joined(file: str, log: list[str], folder: str, name: str, key: str, columns: list[str], changed: list[str], lo: int | None, hi: int | None) -> tuple[int, int]:
    """Rows of the file and of the log with keys from lo to hi, joined: how many come out and how many differ. They are
    written if some differ, or if other tasks have other keys of the file."""
    import tempfile

    import duckdb
    import pyarrow.dataset as ds

    def between(paths: list[str]) -> ds.Dataset:
        store, _ = _opened(paths[0])
        return ds.dataset([_opened(p)[1] for p in paths], filesystem=store, format="parquet")

    quoted = {c: '"' + c.replace('"', '""') + '"' for c in columns}
    k = quoted[key]
    bounds = " AND ".join([f"{k} >= {lo}"] * (lo is not None) + [f"{k} < {hi}"] * (hi is not None)) or "true"
    log_of = {c: f'l."c{i}"' for i, c in enumerate([key, *changed])}
    log_bounds = bounds.replace(k, '"c0"')
    after = {c: f"CASE WHEN l.here THEN {log_of[c]} ELSE b.{quoted[c]} END" if c in log_of else f"b.{quoted[c]}" for c in columns}
    differs = " OR ".join(f"b.{quoted[c]} IS DISTINCT FROM {log_of[c]}" for c in changed) or "false"
    source = f"""FROM (SELECT *, true AS kept FROM base WHERE {bounds}) b FULL JOIN (SELECT *, true AS here FROM log WHERE {log_bounds}) l
                 ON b.{k} = {log_of[key]}"""
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": JOIN_MEMORY, "threads": 1, "temp_directory": spill}) as con:
        con.register("base", between([file]))
        con.register("log", between(log))
        rows, changes = con.execute(f"""
            SELECT count(*) FILTER (l.here IS NULL OR NOT l.gone),
                   count(*) FILTER (l.here AND CASE WHEN l.gone THEN b.kept IS NOT NULL ELSE b.kept IS NULL OR {differs} END) {source}""").fetchall()[0]
        if changes or lo is not None or hi is not None:
            ties = ", ".join(f"{i + 1} NULLS FIRST" for i, c in enumerate(columns) if c != key)
            query = f"SELECT {', '.join(f'{x} AS {quoted[c]}' for c, x in after.items())} {source} WHERE l.here IS NULL OR NOT l.gone ORDER BY {columns.index(key) + 1}{', ' + ties if ties else ''}"
            schema = between([file]).schema
            out = Written(folder, name, schema)
            for batch in con.execute(query).to_arrow_reader(GROUP_ROWS):
                out.add(batch.cast(schema))
            out.close()
    return rows, changes


@dataclass
class Plan:
    """A file to be: its number, and rows (segment's path, rows before, rows) that it takes."""

    number: int
    part: int
    rows: int
    sources: list[tuple[str, int, int]]


def planned(homes: list[tuple[int, list[tuple[str, int]] | None]], rows_per_file: int) -> list[Plan]:
    """Files that are written in place of rewritten ones. homes: every starting file in order, with its segments' paths and
    rows, or None where it stays."""
    out: list[Plan] = []
    joinable = False  # whether the last of out is the left neighbour of what comes next
    for number, segments in homes:
        if segments is None:
            joinable = False
            continue
        total = sum(n for _, n in segments)
        files = -(-total // rows_per_file)
        queue, segment, used = [], 0, 0
        for part in range(files):
            want = total // files + (part < total % files)
            sources, left = [], want
            while left:
                path, n = segments[segment]
                take = min(left, n - used)
                if take:
                    sources.append((path, used, take))
                left -= take
                used += take
                if used == n:
                    segment, used = segment + 1, 0
            queue.append(Plan(number, part, want, sources))
        for plan in queue:
            if joinable and out[-1].rows + plan.rows <= rows_per_file:
                out[-1].rows += plan.rows
                out[-1].sources += plan.sources
            else:
                out.append(plan)
            joinable = True
    return out


def upsert(
    spark: SparkSession, files: list[File], folder: str, changes: DataFrame, order: list[str], changed: list[str], deletes: Callable[[Column], Column], ignores: Callable[[int], bool], rows_per_file: int, number_of_home: Callable[[int], int] = lambda first: first
) -> list[File]:
    """The files of the table in folder after the changes.

    deletes: from a column with what number_of_home gives for the home's first key, whether a winner takes its row away;
    ignores: whether a home, by that number, takes no changes."""
    if not files:
        return []
    firsts, n_homes, key = [f.first for f in files], len(files), files[0].key
    stage = f"{folder}-stage"
    columns = _schema_of(files[0].path).names
    winner = changes.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("c0"))
    rest = [c for c in changes.columns if c not in order and c != key]
    winner = winner.agg(F.max(F.struct(*order, *rest)).alias("w"))

    def homes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes_of(batch.column(0).to_numpy(), firsts), pa.int64())], [*batch.schema.names, "home"])

    homed = through_python(winner, homes, T.StructType([*winner.schema.fields, T.StructField("home", T.LongType())]))
    numbers = [number_of_home(x) for x in firsts]
    takes = [i for i in range(n_homes) if not ignores(numbers[i])]
    number = small_table(spark, [(i, numbers[i]) for i in takes], "home long, number long")
    log = homed.join(F.broadcast(number), "home")  # one small row a file
    log = cut(log.select("home", "c0", F.coalesce(deletes(F.col("number")), F.lit(False)).alias("gone"), *(F.col(f"w.{c}").alias(f"c{i + 1}") for i, c in enumerate(changed))))
    counts = {r.home: r.n for r in log.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return files
    most = max(SEGMENT_KEYS, 4 * rows_per_file)
    bounds: dict[int, list[int]] = {}
    if large := [(h, min(QUANTILES, -(-n // most))) for h, n in counts.items() if n > most]:
        asked = small_table(spark, large, "home long, parts long")
        quantiles = log.join(F.broadcast(asked), "home").groupBy("home").agg(F.percentile_approx("c0", [i / QUANTILES for i in range(1, QUANTILES)], QUANTILES * 10).alias("q"), F.max("parts").alias("parts"))
        picked = quantiles.select("home", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.element_at("q", F.floor(i * QUANTILES / F.col("parts")).cast("int")))).alias("at"))
        bounds = {r.home: sorted(r["at"]) for r in picked.collect()}
    marked = log.withColumn("segment", F.lit(0))
    if bounds:
        by_home = small_table(spark, [(h, b) for h, b in bounds.items()], "home long, bounds array<long>")
        marked = log.join(F.broadcast(by_home), "home", "left").withColumn("segment", F.size(F.filter(F.coalesce("bounds", F.array()), lambda b: b <= F.col("c0")))).drop("bounds")
    tasks = [(h, k, lo, hi) for h in counts for k, (lo, hi) in enumerate(zip([None, *bounds.get(h, [])], [*bounds.get(h, []), None], strict=True))]
    marked.repartition(min(len(tasks), 1 << 16), "home", "segment").write.partitionBy("home", "segment").parquet(f"{stage}/log")
    paths = [f.path for f in files]
    asked = small_table(spark, [(h, paths[h], k, lo, hi) for h, k, lo, hi in tasks], "home long, file string, segment long, lo long, hi long")

    def joins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                home = f"{stage}/log/home={r['home']}"
                # A segment may have no change; any log of the home then tells the columns, and none of its keys is in bounds.
                log = _data_in(f"{home}/segment={r['segment']}") or _data_in(home)[:1]
                name = name_of(r["home"], r["segment"])
                rows, differ = _joined(r["file"], log, f"{stage}/rows", name, key, columns, changed, r["lo"], r["hi"])
                yield _row(home=r["home"], segment=r["segment"], path=f"{stage}/rows/{name}", n=rows, differ=differ)

    done = cut(through_python(asked.repartition(min(len(tasks), 1 << 16)), joins, "home long, segment long, path string, n long, differ long")).collect()
    return _rewritten(spark, files, folder, stage, done, rows_per_file)


def _data_in(folder: str) -> list[str]:
    """Data files in a folder and those below it."""
    from pyarrow import fs

    store, where = _opened(folder)
    found = store.get_file_info(fs.FileSelector(where, allow_not_found=True, recursive=True))
    scheme = folder[: len(folder) - len(where)] if not folder.startswith("file:") else ""
    return [scheme + x.path for x in found if x.is_file and os.path.basename(x.path)[0] not in "._"]


def _schema_of(path: str) -> pa.Schema:
    import pyarrow.parquet as pq

    store, where = _opened(path)
    with store.open_input_file(where) as f:
        return pq.read_schema(f)


def _rewritten(spark: SparkSession, files: list[File], folder: str, stage: str, done: list, rows_per_file: int) -> list[File]:
    """Write the planned files in place of those whose rows differ."""
    segments: dict[int, list[tuple[str, int]]] = {}
    for r in sorted(done, key=lambda r: (r.home, r.segment)):
        segments.setdefault(r.home, []).append((r.path, r.n))
    gone = {r.home for r in done if r.differ}
    plans = planned([(i, segments[i] if i in gone else None) for i in range(len(files))], rows_per_file)
    made: list[File] = []
    if plans:
        rows = [(p.number, p.part, [{"path": a, "skip": b, "n": c} for a, b, c in p.sources]) for p in plans]
        asked = small_table(spark, rows, "number long, part long, sources array<struct<path: string, skip: long, n: long>>")

        def writes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for r in batch.to_pylist():
                    name, out, first = name_of(r["number"], r["part"]), None, None
                    for source in r["sources"]:
                        for rows in _batches_of(source["path"], source["skip"], source["n"]):
                            if out is None:
                                out, first = Written(folder, name, rows.schema), rows
                            out.add(rows)
                    out.close()
                    yield _row(path=f"{folder}/{name}", first=first.column(key)[0].as_py(), n=out.rows)

        key = files[0].key
        written = cut(through_python(asked.repartition(len(plans)), writes, "path string, first long, n long")).collect()
        made = [File(r.path, r.first, r.n, files[0].key, True) for r in written]
    for i in gone:
        removed(spark, files[i].path)
    removed(spark, stage)
    return sorted([*(f for i, f in enumerate(files) if i not in gone), *made], key=lambda f: os.path.basename(f.path))


def described(spark: SparkSession, files: list[File]) -> DataFrame:
    """One row per file, as clients' files are told: its rows' number, sums and digests, read back as a stream."""
    if not files:
        return small_table(spark, [], _DESCRIBED)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                n = cents = crc = 0
                ids, names = hashlib.sha256(), []
                for rows in _batches_of(r["path"]):
                    names = rows.schema.names
                    balance, *texts = (rows.column(c).to_pylist() for c in ("balance", "source", "segment", "city"))
                    cents += sum(math.floor(100 * x + 0.5) for x in balance if x is not None and math.isfinite(x))
                    crc += sum(zlib.crc32("|".join(x or "" for x in t).encode()) for t in zip(*texts, strict=True))
                    ids.update(("," * (n > 0) + ",".join(map(str, rows.column("client_id").to_pylist()))).encode())
                    n += rows.num_rows
                yield _row(first_id=r["first"], n_rows=n, cents=cents, rows_crc=crc, ids_sha256=ids.hexdigest(), columns=",".join(names), path=_plain(r["path"]), again=int(r["rewritten"]))

    asked = small_table(spark, [(f.path, f.first, f.rewritten) for f in files], "path string, first long, rewritten boolean")
    told = through_python(asked.repartition(len(files)), batches, _DESCRIBED.replace("rewritten boolean", "again long"))
    return told.withColumn("rewritten", F.col("again") == 1).drop("again")


_DESCRIBED = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean"


def op13_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    rows_per_file = 1 + clients.count() // 1000
    folder = f"{_shared_folder(spark)}/clients"
    files = stored(clients.where(crc(F.col("client_id")) % 7 > 3), "client_id", rows_per_file, folder)
    files = upsert(
        spark, files, folder, changes, ["seq", "change_id"], ["source", "segment", "city", "balance"],
        deletes=lambda h: (F.col("w.op") == "D") | (crc(F.col("w.change_id")) % 8 < h), ignores=lambda h: h > 7, rows_per_file=rows_per_file, number_of_home=lambda first: zlib.crc32(str(first).encode()) % 16,
    )
    return described(spark, files)
