"""Transcripts as tables: JSONL files to lines, entries, messages, blocks, spans, prompts and calls.

The order of a file's lines is part of the data; files may be many and small, or large and read in splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.functions import text as T
from spanforge.streaming.tail import tail

MESSAGE = "role STRING, content STRING, stop_reason STRING, requestId STRING, usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT, cache_creation_input_tokens: BIGINT, cache_read_input_tokens: BIGINT>"
ENTRY = f"type STRING, uuid STRING, parentUuid STRING, sessionId STRING, timestamp STRING, requestId STRING, message STRUCT<{MESSAGE.replace(' STRING', ': STRING').replace('usage STRUCT', 'usage: STRUCT')}>"
BLOCK = "type STRING, text STRING, content STRING, thinking STRING, name STRING, input STRING, id STRING, tool_use_id STRING"


def _checked(spark: SparkSession, path: str) -> bool:
    """A single file must be there and a .jsonl one; whether it is without any byte."""
    if any(c in path for c in "*?[{"):
        return False
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(there):
        raise FileNotFoundError(path)
    status = files.getFileStatus(there)
    if status.isFile() and not path.endswith(".jsonl"):
        raise ValueError(f"not a .jsonl file: {path}")
    return status.isFile() and status.getLen() == 0


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, stem, blank, line_no, raw), line_no from 1; blank: whether the file has nothing but white space.

    A large file is read in several splits. Its lines' order is that of the splits' places in it and, within a split, that of
    reading, so numbers are those of one reading from start to end. A file without any byte has a blank line where it is
    named itself; in a folder it is passed over."""
    empty = [p for p in ([path] if isinstance(path, str) else path) if _checked(spark, p)]
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("lineSep", "\n")
    read = files.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    of = W.partitionBy("file")
    lines = read.withColumn("line_no", F.row_number().over(of.orderBy("split", "place"))).withColumn("blank", ~F.max(F.col("raw").rlike(r"\S")).over(of)).select("file", "blank", "line_no", "raw")
    for p in empty:
        lines = lines.unionByName(spark.range(1).select(F.lit(p).alias("file"), F.lit(True).alias("blank"), F.lit(1).alias("line_no"), F.lit("").alias("raw")))
    return lines.select("file", F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("stem"), "blank", "line_no", "raw")


def parse_entries(lines: DataFrame, mode: str = "strict") -> DataFrame:
    """Non-blank lines as entries. mode: strict raises on a malformed line and on an empty file, skip leaves such out, report
    keeps malformed lines as such."""
    strict = mode == "strict"
    kept = F.col("raw").rlike(r"\S")
    kept = kept | F.col("blank") if strict else kept
    full = lines.where(kept).withColumn("v", F.try_parse_json("raw"))
    bad = F.col("v").isNull()
    if mode == "skip":
        full = full.where(~bad)
    raw = F.col("raw")
    if strict:
        where = F.concat(F.lit("malformed line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"))
        raw = F.when(F.col("blank"), F.raise_error(F.concat(F.lit("empty file "), F.col("file")))).when(bad, F.raise_error(where)).otherwise(raw)
    content_type = F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant"))
    out = full.select("file", "stem", "line_no", F.from_json(raw, ENTRY).alias("e"), F.coalesce(content_type == "STRING", F.lit(False)).alias("plain_content"), bad.alias("malformed"), "raw")
    return out if mode == "report" else out.drop("malformed", "raw")


def deduplicate(entries: DataFrame) -> DataFrame:
    """Of entries of one request, the one with the most output tokens (the first of several), at the first one's place."""
    request, out = F.col("e.requestId"), F.coalesce(F.col("e.message.usage.output_tokens"), F.lit(0))
    key = F.coalesce(F.concat(F.lit("r"), request), F.concat(F.lit("l"), F.col("line_no").cast("string")))
    of = W.partitionBy("file", "key")
    marked = entries.withColumn("key", key).withColumn("place", F.min("line_no").over(of)).withColumn("best", F.row_number().over(of.orderBy(out.desc(), "line_no")))
    return marked.where("best = 1").drop("best", "key")


def messages(entries: DataFrame) -> DataFrame:
    """User and assistant entries, in order, with session_id, position, role, usage, timestamp and content."""
    kept = deduplicate(entries).where(F.col("e.type").isin("user", "assistant"))
    of = W.partitionBy("file").orderBy("place")
    agent = F.col("file").rlike("/subagents/[^/]+$")
    named = F.first(F.nullif(F.col("e.sessionId"), F.lit("")), ignorenulls=True).over(of.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    u = lambda c: F.coalesce(F.col(f"e.message.usage.{c}"), F.lit(0))
    return kept.select(
        "file", "stem", F.when(agent, F.col("stem")).otherwise(F.coalesce(named, F.col("stem"))).alias("session_id"),
        F.regexp_extract("file", r"([^/]+)/subagents/[^/]+$", 1).alias("parent"), (F.row_number().over(of) - 1).alias("position"),
        F.coalesce("e.message.role", "e.type").alias("role"), F.col("e.uuid").alias("uuid"), F.try_to_timestamp("e.timestamp").alias("timestamp"), F.col("e.message.stop_reason").alias("stop_reason"),
        F.col("e.message.usage").isNotNull().alias("has_usage"), u("input_tokens").alias("input_tokens"), u("output_tokens").alias("output_tokens"), u("cache_creation_input_tokens").alias("cache_creation_tokens"), u("cache_read_input_tokens").alias("cache_read_tokens"),
        F.col("e.message.content").alias("content"), "plain_content",
    )


def blocks(msgs: DataFrame, accept_thinking_key: bool = False, quick: bool = False) -> DataFrame:
    """Content blocks: a string is one text block; of a list, strings and objects count, anything else is passed over. The
    quick reading passes over strings in lists too, and prefers ``thinking`` to ``text``."""
    listed = F.from_json("content", "array<string>")
    items = F.when(F.col("plain_content"), F.array(F.to_json(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), F.col("content"))))).otherwise(F.coalesce(listed, F.array().cast("array<string>")))
    out = msgs.select(*(c for c in msgs.columns if c not in ("content", "plain_content")), F.posexplode(items).alias("block_seq", "item"))
    v = F.try_parse_json("item")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    bare = F.lit(False) if quick else v.isNull() | F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    out = out.withColumn("is_object", is_object).where(is_object | bare).withColumn("b", F.from_json("item", BLOCK))
    inner = F.from_json("b.content", "array<struct<text: string>>")
    joined = F.concat_ws(" ", F.filter(F.transform(inner, lambda x: x["text"]), lambda t: t != ""))
    listed_content = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")).startswith("ARRAY"), F.lit(False))
    text = F.coalesce("b.text", F.when(listed_content, joined).otherwise(F.col("b.content")))
    text = F.coalesce(text, F.col("b.thinking")) if accept_thinking_key else text
    text = F.when(F.col("b.type") == "thinking", F.coalesce(F.nullif("b.thinking", F.lit("")), text)).otherwise(text) if quick else text
    return out.select(
        *(c for c in out.columns if c not in ("item", "b", "is_object")), F.when(F.col("is_object"), F.coalesce("b.type", F.lit("text"))).otherwise("text").alias("block_type"), F.when(F.col("is_object"), text).otherwise(F.col("item")).alias("text"),
        F.col("b.name").alias("tool"), F.col("b.input").alias("tool_input"), F.coalesce("b.id", "b.tool_use_id").alias("tool_use_id"),
    )


def escaped_length(text: Column) -> Column:
    """Length as ASCII JSON has it: five characters more for a code point of the basic plane, eleven for one beyond."""
    return F.length(text) + 5 * F.regexp_count(text, F.lit(r"[\x{80}-\x{FFFF}]")) + 11 * F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def spans(blks: DataFrame) -> DataFrame:
    """Blocks with text, as spans with phase, dense position and token count."""
    call = F.concat_ws(" ", F.coalesce("tool", F.lit("unknown_tool")), F.when(F.col("tool_input").isin("{}", "[]", '""', "null", "0", "false"), F.lit(None)).otherwise(F.col("tool_input")))
    kind = F.col("block_type")
    text = F.when(kind == "tool_use", call).when(kind.isin("text", "thinking", "tool_result"), F.coalesce("text", F.lit(""))).otherwise("")
    phase = F.when(kind == "thinking", "reasoning").when(kind.isin("tool_use", "tool_result"), "tool_use").otherwise("generation")
    full = blks.withColumn("text", text).where("text <> ''")
    long = F.when(kind == "tool_use", escaped_length(F.col("text"))).otherwise(F.length("text"))
    order = W.partitionBy("file").orderBy("position", "block_seq")
    return full.select("file", "session_id", "parent", (F.row_number().over(order) - 1).alias("position"), F.col("position").alias("msg_seq"), "uuid", F.col("role").alias("source_role"), "block_type", phase.alias("phase"), "text", F.greatest(F.lit(1), F.floor(long / 4)).cast("long").alias("token_count"), "tool", F.col("tool_input").alias("parameters"), "tool_use_id")


def prompts(blks: DataFrame) -> DataFrame:
    """One prompt for each text block of the user."""
    order = W.partitionBy("file").orderBy("position", "block_seq")
    own = blks.where("role = 'user' AND block_type = 'text' AND text <> ''")
    return own.select("file", "session_id", (F.row_number().over(order) - 1).alias("prompt_index"), "text")


def calls(blks: DataFrame) -> DataFrame:
    """Tool calls with their results' tokens: the last result of a call counts, none counts 0."""
    use = blks.where("block_type = 'tool_use'").withColumn("seq", F.col("position") * 100000 + F.col("block_seq"))
    results = blks.where("block_type = 'tool_result'").withColumn("seq", F.col("position") * 100000 + F.col("block_seq"))
    sizes = results.groupBy("session_id", "tool_use_id").agg(F.max_by(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4), "seq").cast("long").alias("result_tokens"))
    out = use.join(sizes, ["session_id", "tool_use_id"], "left")
    return out.select("session_id", F.col("seq").alias("position"), "tool", "tool_use_id", F.col("tool_input").alias("parameters"), F.coalesce(T.file_path(F.col("tool_input"))).alias("file"), F.get_json_object("tool_input", "$.command").alias("command"), F.coalesce("result_tokens", F.lit(0)).alias("token_count"))


def quick(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts, spans) by the tolerant reading: entries with a message, of each request the one with the most output tokens
    (the first of several), those without a request first, all in the order of their timestamps as text. User text makes
    prompts and no spans; a call's text is its name and its input as compact JSON; reasoning is read from ``thinking``, else
    ``text``.

    prompts: file, session_id, prompt_index, text; spans: file, session_id, position, phase, text, token_count."""
    m = F.col("e.message")
    own = entries.where(m.isNotNull())
    request = F.coalesce(F.nullif(m["requestId"], F.lit("")), F.nullif(F.col("e.requestId"), F.lit("")))
    own = own.withColumn("request", request).withColumn("key", F.coalesce(F.concat(F.lit("r"), "request"), F.concat(F.lit("l"), F.col("line_no").cast("string"))))
    of = W.partitionBy("file", "key")
    best = own.withColumn("place", F.min("line_no").over(of)).withColumn("best", F.row_number().over(of.orderBy(F.coalesce(m["usage"]["output_tokens"], F.lit(0)).desc(), "line_no"))).where("best = 1")
    named = F.first(F.nullif(F.col("e.sessionId"), F.lit("")), ignorenulls=True).over(W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ids = entries.select("file", "stem", named.alias("id")).distinct().select("file", F.coalesce("id", "stem").alias("session_id"))
    order = W.partitionBy("file").orderBy(F.coalesce("e.timestamp", F.lit("")), F.col("request").isNotNull(), "place")
    msgs = best.join(ids, "file").select("file", "session_id", (F.row_number().over(order) - 1).alias("position"), F.coalesce(m["role"], F.col("e.type")).alias("role"), m["content"].alias("content"), "plain_content")
    text, kind = F.coalesce("text", F.lit("")), F.col("block_type")
    blks = blocks(msgs, quick=True)
    empty_input = F.col("tool_input").isNull() | F.col("tool_input").isin("{}", "[]", '""', "null", "0", "false")
    call = F.concat(F.coalesce("tool", F.lit("unknown")), F.lit(": "), F.when(empty_input, "").otherwise(F.col("tool_input")))
    full = blks.where(kind.isin("text", "thinking", "tool_use", "tool_result")).withColumn("text", F.when(kind == "tool_use", call).otherwise(text)).where(F.col("text").rlike(r"\S"))
    by = W.partitionBy("file").orderBy("position", "block_seq")
    mine = (F.col("role") == "user") & (kind == "text")
    prompts_ = full.where(mine).select("file", "session_id", (F.row_number().over(by) - 1).alias("prompt_index"), "text")
    phase = F.when(kind == "thinking", "reasoning").when(kind.isin("tool_use", "tool_result"), "tool_use").otherwise("generation")
    spans_ = full.where(~mine).select("file", "session_id", (F.row_number().over(by) - 1).alias("position"), phase.alias("phase"), "text", T.span_tokens(F.col("text")).alias("token_count"))
    return prompts_, spans_


def sessions(spark: SparkSession, folder: str, limit: int = 20) -> DataFrame:
    """Session files, the newest first, with size and number of sub-agents; no content is read. Files in a folder named
    ``subagents`` under the given one are agents of the session that the folder above is named for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "modificationTime", "length")
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toUri().getPath().rstrip("/")
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    files = files.withColumn("under", F.when(plain.startswith(root + "/"), F.substr(plain, F.lit(len(root) + 1))).otherwise(plain))
    agents = files.where(F.col("under").rlike("/subagents/[^/]+$")).groupBy(F.regexp_extract("path", r"^(.*)/subagents/[^/]+$", 1).alias("stem_path")).agg(F.count(F.lit(1)).alias("subagents"))
    own = files.where(~F.col("under").rlike("/subagents/")).withColumn("stem_path", F.regexp_replace("path", r"\.jsonl$", ""))
    out = own.join(agents, "stem_path", "left").select("path", F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.coalesce("subagents", F.lit(0)).alias("subagents"))
    return out.orderBy(F.desc("modified"), "path").limit(limit)


def hashes(spark: SparkSession, folder: str) -> DataFrame:
    """sha256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Between two listings (path, modificationTime): new and modified files."""
    b = before.select("path", F.col("modificationTime").alias("t0"))
    joined = after.select("path", F.col("modificationTime").alias("t1")).join(b, "path", "full_outer")
    return joined.where("t1 IS NOT NULL AND (t0 IS NULL OR t1 > t0)").select("path", F.when(F.col("t0").isNull(), "new_session").otherwise("modified_session").alias("event"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime) of all transcripts."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "modificationTime")


class Snapshots:
    """Tables that are written anew at each poll, numbered, in a folder that outlives the process."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _last(self, upto: int | None = None) -> int:
        if not self.files.exists(self.path):
            return -1
        names = [s.getPath() for s in self.files.listStatus(self.path)]
        done = [int(p.getName()) for p in names if p.getName().isdigit() and self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((n for n in done if upto is None or n <= upto), default=-1)

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The latest table, or the latest one with a number up to the given one."""
        n = self._last(upto)
        return None if n < 0 else self.spark.read.parquet(f"{self.folder}/{n}")

    def write(self, table: DataFrame, number: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """The table as the next one, or as the one with that number. The one before stays, those before that go."""
        n = self._last() + 1 if number is None else number
        table.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{n}")
        return self._kept(n)

    def _kept(self, n: int) -> DataFrame:
        while (old := self._last(n - 2)) >= 0:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)
        return self.spark.read.parquet(f"{self.folder}/{n}")

    def staged(self, table: DataFrame) -> DataFrame:
        """The table, stored, but not yet the latest one."""
        table.write.mode("overwrite").parquet(f"{self.folder}/staged")
        return self.spark.read.parquet(f"{self.folder}/staged")

    def commit(self) -> DataFrame:
        """Make what is staged the latest table."""
        n = self._last() + 1
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        self.files.rename(path(f"{self.folder}/staged"), path(f"{self.folder}/{n}"))
        return self._kept(n)


def poll_changes(spark: SparkSession, folder: str, snapshots: str) -> DataFrame:
    """(path, event): transcripts that are new or modified since the last call with the same snapshots."""
    held = Snapshots(spark, snapshots)
    before = held.read()
    now = held.write(listing(spark, folder))
    return changes(now.limit(0) if before is None else before, now)


def tell_changes(spark: SparkSession, folder: str, snapshots: str, on_change: Callable[[dict], None], settle_seconds: float = 0.0) -> None:
    """Call on_change with path and event of each transcript that is new or modified since the last call with the same
    snapshots; the first call takes what is there as known. A file that changed less than settle_seconds ago is still being
    written and waits. Changes count as told once all callbacks have returned."""
    held = Snapshots(spark, snapshots)
    before, found = held.read(), listing(spark, folder)
    young = F.lit(settle_seconds > 0) & (F.unix_micros(F.current_timestamp()) - F.unix_micros("modificationTime") < int(settle_seconds * 1e6))
    if before is not None:
        settled = found.where(~young)
        found = settled.unionByName(before.join(found.where(young).select("path"), "path", "left_semi"))
    now = held.staged(found)
    if before is not None:
        for row in changes(before, now).orderBy("path").toLocalIterator():
            on_change(row.asDict())
    held.commit()


def watch_changes(spark: SparkSession, folder: str, snapshots: str, on_change: Callable[[dict], None], interval: str = "30 seconds", settle_seconds: float = 2.0) -> StreamingQuery:
    """tell_changes() at every interval, until the query is stopped; another one with the same snapshots goes on."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    each = lambda _, __: tell_changes(spark, folder, f"{snapshots}/listings", on_change, settle_seconds)
    return clock.writeStream.foreachBatch(each).option("checkpointLocation", f"{snapshots}/clock").trigger(processingTime=interval).start()


def poll_lines(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame], None]) -> None:
    """Give each() the lines (file, session, offset, raw) that transcripts have gained since the last call with the same
    checkpoint. Lines count as read once each() has returned; a last line without its line end waits for the next call."""
    stream = tail(spark, folder).writeStream.foreachBatch(lambda batch, _: each(batch)).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
