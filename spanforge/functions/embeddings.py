"""Dense embeddings by a model that the caller brings, computed once for each text and kept as a table.

A model is given as a function that makes an encoder (texts to a matrix); each Python worker makes one and feeds it Arrow
batches. The cache is a Parquet table that is only ever appended to: of a text's rows the latest counts, one without an
embedding takes it back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.runtime import exists, ship_package
from spanforge.functions.text import content_hash

Encoder = Callable[[list[str]], np.ndarray]
CACHE = "content_hash string, embedding array<float>, source string, at timestamp"
TTL_HOURS, BATCH = 168, 64


def embed(texts: DataFrame, make: Callable[[], Encoder], batch: int = BATCH) -> DataFrame:
    """texts with an embedding of the column text; a null text has none, and no encoder sees it."""
    ship_package(texts.sparkSession)

    @F.pandas_udf("array<float>")
    def encoded(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for part in it:
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            told = part[part.notna()]
            for lo in range(0, len(told), batch):
                some = told.iloc[lo : lo + batch]
                for at, row in zip(some.index, np.asarray(encode(some.tolist()), np.float32), strict=True):
                    out.at[at] = row
            yield out

    return texts.withColumn("embedding", encoded("text"))


def embed_once(texts: DataFrame, make: Callable[[], Encoder], batch: int = BATCH) -> DataFrame:
    """embed(), but equal texts go through the encoder once."""
    named = texts.withColumn("content_hash", content_hash(F.col("text")))
    known = embed(named.where("text IS NOT NULL").select("content_hash", "text").dropDuplicates(["content_hash"]), make, batch)
    return named.join(known.select("content_hash", "embedding"), "content_hash", "left").drop("content_hash")


def cached(spark: SparkSession, path: str, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """(content_hash, embedding) that are neither older than that nor taken back."""
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE).select("content_hash", "embedding")
    latest = spark.read.schema(CACHE).parquet(path).groupBy("content_hash").agg(F.max_by(F.struct("embedding", "at"), "at").alias("x"))
    age = (F.unix_micros(F.current_timestamp()) - F.unix_micros("x.at")) / 3.6e9
    return latest.where(F.col("x.embedding").isNotNull() & (age <= ttl_hours)).select("content_hash", "x.embedding")


def get_or_compute(texts: DataFrame, make: Callable[[], Encoder], path: str, ttl_hours: float = TTL_HOURS, source: str | None = None, batch: int = BATCH) -> DataFrame:
    """texts with content_hash and embedding; what the cache lacks is computed, equal texts once, and added to it. A null text
    keeps its row, without an embedding."""
    spark = texts.sparkSession
    named = texts.withColumn("content_hash", content_hash(F.col("text")))
    lacking = named.where("text IS NOT NULL").select("content_hash", "text").dropDuplicates(["content_hash"]).join(cached(spark, path, ttl_hours).select("content_hash"), "content_hash", "left_anti")
    fresh = embed(lacking, make, batch).select("content_hash", "embedding", F.lit(source).cast("string").alias("source"), F.current_timestamp().alias("at"))
    fresh.write.mode("append").parquet(path)
    return named.join(cached(spark, path, ttl_hours), "content_hash", "left")


def embed_spans(spans: DataFrame, make: Callable[[], Encoder], cache: str | None = None, least: int = 0, merge: bool = False, batch: int = BATCH) -> DataFrame:
    """Spans (session_id, position, phase, text, token_count, and more) with embeddings: of their own texts, or, with merge, of
    runs of one phase as one text, whose vector each span of the run gets. Spans of fewer than ``least`` tokens have none, and
    a run goes on over them. cache: a table of embeddings that outlives the run."""
    own = spans.where(F.col("token_count") >= least)
    order = W.partitionBy("session_id").orderBy("position")
    before = F.lag("phase").over(order)
    changes = F.when(before.isNull() | (before != F.col("phase")), 1).otherwise(0) if merge else F.lit(1)
    runs = own.select("session_id", "position", "text", changes.alias("fresh")).select("session_id", "position", "text", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("run"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda t: t["text"])
    units = runs.groupBy("session_id", "run").agg(F.concat_ws(" ", texts).alias("text")) if merge else runs.select("session_id", "run", "text")
    vectors = (get_or_compute(units, make, cache, batch=batch) if cache else embed_once(units, make, batch)).select("session_id", "run", "embedding")
    placed = runs.select("session_id", "position", "run").join(vectors, ["session_id", "run"]).drop("run")
    return spans.join(placed, ["session_id", "position"], "left")


def invalidate(spark: SparkSession, path: str, prefix: str | None = None, source: str | None = None) -> None:
    """Take back the embeddings of texts whose hash begins so, or that came from the source."""
    if not exists(spark, path):
        return
    rows = spark.read.schema(CACHE).parquet(path)
    chosen = F.col("content_hash").startswith(prefix) if prefix is not None else F.col("source") == source
    gone = rows.where(chosen).select("content_hash").distinct()
    gone.select("content_hash", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("source"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def cache_stats(spark: SparkSession, path: str) -> DataFrame:
    """entries, bytes and oldest_hours of the cache."""
    if not exists(spark, path):
        return spark.range(1).select(F.lit(0).cast("long").alias("entries"), F.lit(0).cast("long").alias("bytes"), F.lit(0.0).alias("oldest_hours"))
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    rows = spark.read.schema(CACHE).parquet(path).where("embedding IS NOT NULL")
    own = rows.agg(F.countDistinct("content_hash").alias("entries"), F.coalesce((F.unix_micros(F.current_timestamp()) - F.unix_micros(F.min("at"))) / 3.6e9, F.lit(0.0)).alias("oldest_hours"))
    return own.withColumn("one", F.lit(1)).join(size.withColumn("one", F.lit(1)), "one").select("entries", "bytes", "oldest_hours")
