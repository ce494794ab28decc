"""Transcripts that grow, as a stream: a source whose offset says how far each file has been read.

    spark.readStream.format("transcript-tail").load(folder)      # after register(spark)

An offset maps each file to the byte after its last whole line, so that a poll opens only files that have changed, a batch
reads only new bytes, and a query that is killed goes on from the offsets in its checkpoint: no line is lost or read twice. A
last line without its line end waits for the next poll. Large ranges are cut into splits of ``splitBytes``, small ones share
one; a line belongs to the split in which it begins. The order of a file's lines is that of their offsets.

Files are found in the folder and below it (or one file is given), wherever pyarrow can open them. A file that has become
shorter than what was read of it is a new one and read from its start; one that vanishes is forgotten.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spanforge.functions.runtime import opened, ship_package

SPLIT_BYTES, CHUNK = 64 << 20, 1 << 16
#: Rows and bytes that travel together.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
SCHEMA = "file string, session string, offset long, raw string"


@dataclass
class Split(InputPartition):
    """Ranges (file, begin, end, whether a line begins there)."""

    ranges: list[tuple[str, int, int, bool]]


def whole_lines_end(stream, size: int) -> int:  # noqa: ANN001
    """The byte after the last line end of a file of that size."""
    end = size
    while end > 0:
        begin = max(0, end - CHUNK)
        stream.seek(begin)
        at = stream.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return 0


def lines_in(stream, begin: int, end: int, at_line: bool) -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """(offset, line) of the lines that begin in a range; the last one may end beyond it."""
    at = begin if at_line else begin - 1
    stream.seek(at)
    held, skip = b"", not at_line
    while True:
        more = stream.read(CHUNK)
        if not more:
            return
        held += more
        start = 0
        while (stop := held.find(b"\n", start)) >= 0:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, held[start:stop]
            at += stop + 1 - start
            start = stop + 1
        held = held[start:]
        if at >= end:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"].rstrip("/"), int(options.get("splitBytes", SPLIT_BYTES))
        self.seen: dict[str, tuple[object, int]] = {}  # what a file looked like, and where its whole lines end

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        store, root = opened(self.path)
        given = store.get_file_info(root)
        found = [given] if given.is_file else store.get_file_info(fs.FileSelector(root, recursive=True)) if given.type == fs.FileType.Directory else []
        now = {}
        for x in found:
            if x.is_file and x.path.endswith(".jsonl"):
                looks = (x.size, x.mtime_ns)
                if x.path not in self.seen or self.seen[x.path][0] != looks:
                    try:
                        with store.open_input_file(x.path) as stream:
                            now[x.path] = looks, whole_lines_end(stream, x.size)
                    except FileNotFoundError:
                        continue
                else:
                    now[x.path] = self.seen[x.path]
        self.seen = now
        return {path: end for path, (_, end) in sorted(now.items())}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        out, room = [], 0
        for path, upto in end.items():
            at, first = start.get(path, 0), True
            at = at if at <= upto else 0
            while at < upto:
                stop = min(upto, at + self.split)
                if room < stop - at:
                    out.append(Split([]))
                    room = self.split
                out[-1].ranges.append((path, at, stop, first))
                room -= stop - at
                at, first = stop, False
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        rows: list[tuple[str, str, int, str]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "session", "offset", "raw"])

        for path, begin, end, at_line in partition.ranges:
            inside = path[len(root) :].lstrip("/") if path != root else os.path.basename(path)
            with store.open_input_file(path) as stream:
                for offset, line in lines_in(stream, begin, end, at_line):
                    rows.append((path, inside.removesuffix(".jsonl"), offset, line.decode("utf-8", "replace")))
                    size += len(line)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        size = 0
        if rows:
            yield batch()


class TranscriptTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript-tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> TailReader:  # noqa: ARG002, N802
        return TailReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(TranscriptTail)


def tail(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of (file, session, offset, raw): whole lines of all transcripts at path; session is the file's path under it."""
    register(spark)
    return spark.readStream.format(TranscriptTail.name()).option("splitBytes", str(split_bytes)).load(path)
