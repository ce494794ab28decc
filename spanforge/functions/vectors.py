"""Vectors: dense arrays, and sparse hashed trigram counts as rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions.text import trigrams

DIMENSIONS = 384
#: Trigrams that a worker remembers before it starts anew.
MOST_TRIGRAMS = 1 << 20


class Buckets(dict):
    """A trigram's bucket: its md5 modulo DIMENSIONS."""

    def __missing__(self, gram: str) -> int:
        if len(self) > MOST_TRIGRAMS:
            self.clear()
        self[gram] = out = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest(), 16) % DIMENSIONS
        return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    both = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / F.when(both == 0, 1.0).otherwise(both))


def bucket(gram: Column) -> Column:
    """md5 modulo 384, from parts of 15, 15 and 2 hex digits: 2**68 and 2**8 both leave 256."""
    digest = F.md5(gram.cast("binary"))
    a, b, c = (F.conv(F.substring(digest, at, n), 16, 10).cast("long") for at, n in ((1, 15), (16, 15), (31, 2)))
    return ((256 * (a % DIMENSIONS + b % DIMENSIONS) + c) % DIMENSIONS).cast("int")


def trigram_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, bucket, weight): unit vectors of hashed trigram counts, one row for each bucket in use; texts of fewer
    than three characters have the first unit vector."""
    low = F.lower(F.col(text))
    grams = df.select(*keys, F.explode(F.when(F.length(low) >= 3, trigrams(low)).otherwise(F.array(F.lit("")))).alias("gram"))
    # Equal trigrams are counted before they are hashed.
    counted = grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    counts = counted.select(*keys, F.when(F.col("gram") == "", 0).otherwise(bucket(F.col("gram"))).alias("bucket"), "n").groupBy(*keys, "bucket").agg(F.sum("n").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(*keys)))
    return counts.select(*keys, "bucket", (F.col("n") / norm).alias("weight"))
