"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 sets, for each text's hash, a few bits of a blocked Bloom filter and keeps those that two rows set. Pass 2
tests every row against that filter: a row whose bits are not all kept has no equal and passes straight through; only
the others are shuffled. The filter is broadcast and never exceeds ``max_bits``; where the input outgrows it, more
rows take the shuffled way and the result is the same.

Defined results: a null text counts as empty; a null doc_id is smaller than any other; of rows that repeat a doc_id as
well as a text, deduplicate() keeps one (ties go by the other columns), while duplicate_groups() marks each of them as
kept, since it tells rows by their ids only; columns of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import bloom
from spanforge.llm.common import cut, documents, free_name

#: 64 MB: the most that is broadcast.
MAX_BITS = 1 << 29
BITS_PER_ROW = 16


def _filter(keys: DataFrame, key: str, max_bits: int) -> tuple[DataFrame, int]:
    blocks = bloom.n_blocks(keys.count(), BITS_PER_ROW, max_bits)
    return cut(bloom.build(keys, key, blocks, at_least=2)), blocks


def _hash_of(digest: str) -> F.Column:
    return F.xxhash64(F.col(digest))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. The largest id of equal texts stays."""
    digests = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")).withColumn("h", _hash_of("text_sha256"))
    digests = cut(digests)
    repeated, blocks = _filter(digests.select("h"), "h", max_bits)
    marked = bloom.mark(digests, "h", repeated, blocks, "maybe")
    single = marked.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = marked.where("maybe").select("doc_id", "text_sha256", "h")
    groups = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("h").alias("h"))
    # Joined by one column more than it is grouped by, so that both sides are dealt anew and a hot group can be split.
    several = rows.join(groups, ["text_sha256", "h"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(several)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the row with the largest id."""
    digest, key, maybe, best = free_name(docs, "digest", "h", "maybe", "best")
    keyed = docs.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).withColumn(key, _hash_of(digest))
    repeated, blocks = _filter(keyed.select(key), key, max_bits)
    marked = bloom.mark(keyed, key, repeated, blocks, maybe)
    order = [F.col(id_col), *(F.col(f.name) for f in docs.schema.fields if f.name not in (id_col, text_col) and _orderable(f.dataType))]
    # A group's best row is found before the shuffle, task by task, so a hot group sends one row from each.
    several = marked.where(F.col(maybe)).groupBy(digest).agg(F.max_by(F.struct(*docs.columns), F.struct(*order)).alias(best)).select(f"{best}.*")
    return marked.where(~F.col(maybe)).select(*docs.columns).unionByName(several)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
