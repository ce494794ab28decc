"""History of results: one row for each project and session, the one that was stored last.

append() adds files, by project and month, and never reads; history() lets the latest version of a key win, so that a run that
is stored twice counts once; compact() writes all latest rows as a new base and then removes the files that are in it. A
reader finds the same rows before, while and after that: what is both in the base and in a file is the same version twice.

Defined results: of versions of one time, any one counts; a null or missing project is the empty one; results without
``timestamp`` or ``ts`` belong to the month in which they are stored; columns that came later are null in earlier rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.runtime import exists
from spanforge.sources.transcripts import Snapshots

#: Folders are named with a letter before the value, so that none is taken for a number or a date.
SAVED, PLACES = "saved_at", ("in_project", "in_month")


def append(results: DataFrame, path: str, project: str | None = None, at: datetime.datetime | None = None) -> None:
    """Store results (session_id, and more) as their keys' latest versions; ``at`` is now, or a time that is given."""
    given = F.lit(project) if project is not None else F.col("project") if "project" in results.columns else F.lit("")
    now = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    when = next((F.col(c) for c in ("timestamp", "ts") if c in results.columns), now)
    rows = results.withColumn("project", F.coalesce(given, F.lit(""))).withColumn(SAVED, now)
    rows = rows.withColumn("in_project", F.concat(F.lit("p"), "project")).withColumn("in_month", F.concat(F.lit("m"), F.date_format(F.coalesce(when, now), "yyyy-MM")))
    rows.repartition(*PLACES).write.partitionBy(*PLACES).mode("append").parquet(f"{path}/new")


def _versions(spark: SparkSession, path: str, base: DataFrame | None) -> list[DataFrame]:
    new = [spark.read.option("mergeSchema", "true").parquet(f"{path}/new")] if exists(spark, f"{path}/new") and _files(spark, path) else []
    return [*([] if base is None else [base]), *new]


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that append() has left and no compact() has taken."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/new")
    found, out = there.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(there, True), []
    while found.hasNext():
        name = found.next().getPath()
        if name.getName().endswith(".parquet"):
            out.append(name.toString())
    return out


def _latest(versions: list[DataFrame]) -> DataFrame:
    rows = versions[0]
    for v in versions[1:]:
        rows = rows.unionByName(v, allowMissingColumns=True)
    best = rows.groupBy(F.col("project").alias("p"), F.col("session_id").alias("s")).agg(F.max_by(F.struct(*rows.columns), SAVED).alias("v"))
    return best.select("v.*")


def history(spark: SparkSession, path: str, project: str | None = None, since: str | None = None) -> DataFrame:
    """The latest version of every key; of one project, or of months (yyyy-MM) from one on, by reading only their files."""
    versions = _versions(spark, path, Snapshots(spark, f"{path}/base").read())
    if not versions:
        return spark.createDataFrame([], f"session_id string, project string, {SAVED} timestamp")
    if project is not None:
        versions = [v.where(F.col("in_project") == f"p{project}") for v in versions]
    if since is not None:
        versions = [v.where(F.col("in_month") >= f"m{since}") for v in versions]
    return _latest(versions).drop(*PLACES)


def compact(spark: SparkSession, path: str) -> None:
    """Store the latest versions as the base, and remove the files that are in it."""
    base = Snapshots(spark, f"{path}/base")
    taken = _files(spark, path) if exists(spark, f"{path}/new") else []
    if taken:
        base.write(_latest(_versions(spark, path, base.read())), by=PLACES)
        for name in taken:
            there = spark._jvm.org.apache.hadoop.fs.Path(name)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, False)
