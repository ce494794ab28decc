"""What the operators of this subpackage share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.runtime import ship_package

#: Code points that separate words in every contract here.
WORD_SEPARATORS = "\x20\x09-\x0d"
#: Rows that a Python worker gets at once.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder; the cluster's own setting is never replaced. Only a session of a single
    process gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spanforge-checkpoints-")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared checkpoint folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, written once to the shared checkpoint folder, so that every later pass reads the same
    numbers, however a scan of df would be split by then."""
    shared_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    df.withColumn(name, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def through_python(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, on workers that can import this package, with batches small enough for rows of long texts: the
    session's batch size is lowered to BATCH_ROWS, where it is more."""
    ship_package(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(batches, schema)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has, a few, as a table that no Python worker has a part in."""
    kind = T._parse_datatype_string(schema)
    told = json.dumps([dict(zip(kind.fieldNames(), r, strict=True)) for r in rows])
    one = spark.range(1).select(F.explode(F.from_json(F.lit(told), T.ArrayType(kind))).alias("row"))
    return one.select("row.*")


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold from which nothing is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
