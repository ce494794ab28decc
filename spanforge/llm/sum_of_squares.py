"""Best-fit packing by sums of squares.

A document's ids are those of a tokenizer file and an end id; only documents longer than a window are cut, into whole
windows and a rest. Open sequences are counted by the tokens that still fit into them, their gap, and each piece goes
where the sum of the squared counts of all gaps becomes smallest: into a gap that many sequences have, so that few of any
gap are left over, or into a gap of its own size, which closes the sequence. Equal sums go to the smaller gap. Pieces come
longest first, and a new sequence is opened only where no open one has room: opened by the sum alone, as for pieces of
unknown order, sequences stay half empty at the end (0.4 % more sequences on the documents of check_l, and 1 % in random
order, where this rule reaches the least number that the tokens need).

Texts are read once; their ids become checksums at once and never move. What is dealt are the pieces, a few numbers each,
by the hash of a row number, in partitions of about ``partition_tokens`` tokens, each of which leaves a few sequences
unfilled at most. A partition is sorted by Spark and read as a stream; what a task holds are its open sequences.

Defined results: a null text counts as empty and gives the end id alone; rows that repeat an id are packed as often as they
occur; strings of added tokens in a text are those tokens; other columns, whatever their names, are not read; an empty
table gives no pieces; pieces of equal length go by row numbers, so that a rerun on other splits may deal them otherwise;
a text of any length is worked on in sections, beside its ids (4 bytes each).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import cut, documents, free_name, through_python
from spanforge.llm.word_ids import word_ids

WINDOW, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"
#: Tokens of a partition: some 8,000 sequences, of which a few stay unfilled.
PARTITION_TOKENS = 1 << 24
#: Texts that are tokenised at once, if they are short: rows and characters.
ROWS, CHARACTERS = 512, 1 << 22


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids_of = word_ids(tokenizer or public_tokenizers.path(VOCABULARY))
        end = np.array([END_ID], np.uint32)
        for batch in it:
            rows, lo = batch.num_rows, 0
            sizes = np.cumsum([len(t) if t else 0 for t in batch.column(1).to_pylist()])
            while lo < rows:
                hi = min(rows, lo + ROWS, max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHARACTERS))))
                part = batch.slice(lo, hi - lo)
                lo = hi
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of.many([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), window)):
                        own = ids[at : at + window]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return through_python(docs.select(id_col, text_col), batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Sequences:
    """Open sequences by their gaps."""

    def __init__(self, window: int, first: int = 0) -> None:
        self.window, self.next = window, first
        self.count = np.zeros(window, np.int64)  # of each gap under the window; nothing counts as the gap 0
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int) -> tuple[int, int]:
        """The sequence that takes a piece of this size, and where in it the piece begins."""
        window = self.window
        had = self.count[size:]
        gap = window
        if size < window and had.any():
            # Of one more in the gap that is left and one less in this: 2 * (left - had) + 2, and one less where none is left.
            grows = 2 * (self.count[: window - size] - had)
            grows[0] -= 1
            grows[had == 0] = np.iinfo(np.int64).max
            gap = size + int(grows.argmin())
        if gap < window:
            number = self.open[gap].pop()
            self.count[gap] -= 1
        else:
            number = self.next
            self.next += 1
        if gap > size:
            self.open[gap - size].append(number)
            self.count[gap - size] += 1
        return number, window - gap


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, id_col, text_col, window, tokenizer)
    (row,) = free_name(found, "row")
    found = cut(found.withColumn(row, F.monotonically_increasing_id()))
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = found.repartition(max(1, -(-total // partition_tokens)), F.xxhash64(row)).sortWithinPartitions(F.desc("length"), row).drop(row)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(window, TaskContext.get().partitionId() << 40)
        for batch in it:
            places = [sequences.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*places, strict=True))], [*batch.schema.names, "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return through_python(dealt, batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
