"""Labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import held_out


def draw(doc_id: Column, seed: int) -> Column:
    """A fixed number from 0 to 1 for each id."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def known_labels(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of all ids that are not held out."""
    return labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(column).alias("label"))


def sample(labels: DataFrame, column: str, most: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, u): about ``most`` rows of either label at most, none of them held out; u orders them at random."""
    known = known_labels(labels, column, id_col)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().where("label IN (0, 1)").collect()}
    drawn = known.withColumn("u", draw(F.col("doc_id"), seed))
    share = F.when(F.col("label") == 1, F.lit(most / max(counts.get(1, 0), 1))).otherwise(F.lit(most / max(counts.get(0, 0), 1)))
    return drawn.where(F.col("label").isin(0, 1) & (F.col("u") < share)).withColumn("u", F.col("u") / F.least(share, F.lit(1.0)))


def with_texts(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, u) of the chosen ids, equal texts once; chosen is bounded by sample() and so may be broadcast."""
    picked = F.broadcast(chosen.select(F.col("doc_id").alias("__id"), "label", "u"))
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, F.col("__doc") == F.col("__id"))
    return rows.groupBy(F.sha2("text", 256)).agg(F.min(F.struct("__id", "label", "u", "text")).alias("row")).select("row.text", "row.label", "row.u")


def labelled_texts(docs: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """(text, label, u) of all rows of docs (doc_id, text) that have a label in known; u, from 0 to 1, is fixed for each text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
    return rows.select("text", "label", draw(F.col("text"), seed).alias("u"))
