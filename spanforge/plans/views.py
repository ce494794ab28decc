"""Session-shaped views of the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as spans; system turns are no messages."""
    rows = table(spark, sf, "conversations").where("role <> 'system' AND text <> ''")
    order = W.partitionBy("conv_id").orderBy("turn")
    return rows.select(F.col("conv_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("position"), F.col("turn").alias("msg_seq"), F.col("role").alias("source_role"), "role", F.lit("text").alias("block_type"), F.lit("generation").alias("phase"), "text", T.span_tokens(F.col("text")).alias("token_count"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    order = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").where("role = 'user' AND text <> ''").select(F.col("conv_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("prompt_index"), "text")


def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts' lines, as sources.transcripts.read_lines() has them. An assistant's turn is a request with
    two entries, a beginning and the whole: reasoning, a call, and the answer; the user's turn after it may bring the call's
    result before its text."""
    rows = table(spark, sf, "conversations").withColumn("session", F.col("conv_id").cast("string"))
    called = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")) == "assistant"
    rows = rows.withColumn("called", F.coalesce(called, F.lit(False)) & (F.col("turn") % 2 == 0))
    n, at = F.length("text"), F.col("turn").cast("string")
    block = lambda **x: F.struct(*(x.get(k, F.lit(None)).cast("string").alias(k) for k in ("type", "text", "content", "id", "tool_use_id", "name")), (x["input"] if "input" in x else F.lit(None).cast("struct<file_path: string>")).alias("input"))
    text = block(type=F.lit("text"), text=F.col("text"))

    def entry(content: Column, output: Column | None) -> Column:
        usage = [] if output is None else [F.struct(n.alias("input_tokens"), output.alias("output_tokens"), (n % 7).alias("cache_read_input_tokens")).alias("usage")]
        request = [] if output is None else [F.concat(F.lit("r"), at).alias("requestId")]
        return F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("u"), at).alias("uuid"), F.col("session").alias("sessionId"), *request, F.struct("role", content.alias("content"), *usage).alias("message")))

    whole = F.array(block(type=F.lit("thinking"), text=F.substring("text", 1, 40)), block(type=F.lit("tool_use"), id=F.concat(F.lit("t"), at), name=F.lit("Read"), input=F.struct(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string"), F.lit(".py")).alias("file_path"))), text)
    result = F.array(block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")), content=F.substring("text", 1, 80)), text)
    said = F.when(F.col("role") == "assistant", F.array(entry(F.array(block(type=F.lit("text"), text=F.lit("so far"))), F.lit(1)), entry(whole, n % 50 + 2))).when(F.col("called"), F.array(entry(result, None))).otherwise(F.array(entry(F.col("text"), None)))
    out = rows.select(F.concat(F.lit("/"), "session", F.lit(".jsonl")).alias("file"), F.col("session").alias("stem"), F.lit(False).alias("blank"), "turn", F.posexplode(said).alias("k", "raw"))
    return out.select("file", "stem", "blank", (F.col("turn") * 2 + F.col("k") + 1).alias("line_no"), "raw")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a session's tool calls: the user is the session, the type the tool, the property the file or command."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    out = table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("position"), "ts", kind.alias("tool"), F.concat_ws(" ", kind, "props").alias("signature"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("file"), F.col("props").alias("parameters"),
        F.when(kind.isin("view", "signup"), "reasoning").when(kind == "click", "generation").otherwise("tool_use").alias("phase"), (kind != "error").alias("aligned"), F.greatest(F.lit(1), F.floor(F.abs("value"))).cast("long").alias("token_count"),
        F.when(kind == "error", "tool_result").otherwise("tool_use").alias("block_type"), F.when((kind == "error") & (k % 2 == 0), "Error: permission denied").when(kind == "error", "command failed").otherwise("ok").alias("text"), "event_id", k.alias("k"),
    )
    return out


def labelled_calls(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("aligned"), F.concat(F.lit("aligned_"), F.col("phase"))).when(F.col("phase") == "reasoning", "redundant_reasoning").otherwise("unnecessary_tool_call")
    stale = (F.col("tool") == "view") & (F.col("k") < 60)
    rows = calls(spark, sf).withColumn("aligned", F.col("aligned") & ~stale)
    return rows.withColumn("label", label).withColumn("source_role", F.when(F.col("k") % 3 == 0, "user").otherwise("assistant"))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as billed messages: the order is the session, its lines the turns."""
    q, p = F.col("l_quantity").cast("long"), F.floor("l_extendedprice").cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("turn"), F.when(F.col("l_returnflag") == "R", "user").otherwise("assistant").alias("role"), (q * 10).alias("input_tokens"), F.floor(p / 100).cast("long").alias("output_tokens"), (q * 3).alias("cache_creation_tokens"), F.floor(p / 20).cast("long").alias("cache_read_tokens"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as session results: a project is a priority, a tag the status and the year."""
    price = F.floor("o_totalprice").cast("long")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("project"), F.col("o_orderdate").alias("ts"), F.round((price % 1000) / 1000.0, 3).alias("aggregate_ter"), price.alias("total_tokens"), F.floor(price / 7).cast("long").alias("waste_tokens"), F.array(F.col("o_orderstatus"), F.year("o_orderdate").cast("string")).alias("tags"), F.round((price % 997) / 997.0, 3).alias("reasoning_score"), F.round((price % 991) / 991.0, 3).alias("tool_use_score"), F.round((price % 983) / 983.0, 3).alias("generation_score"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


TURNS = "turns AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, turn AS msg_seq, role AS source_role, role, 'generation' AS phase, text, greatest(1, length(text) // 4)::BIGINT AS token_count FROM conversations WHERE role <> 'system' AND text <> '')"
SPOKEN = """spoken AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' AND turn % 2 = 0 THEN 1 ELSE 0 END AS called FROM conversations),
told AS (SELECT conv_id::VARCHAR AS session_id, turn, role, text, called, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS message FROM spoken WHERE role IN ('user', 'assistant')),
said AS (SELECT session_id, turn, message, role, 0 AS k, 'thinking' AS block_type, substr(text, 1, 40) AS text FROM told WHERE role = 'assistant'
  UNION ALL SELECT session_id, turn, message, role, 1, 'tool_use', 'Read {"file_path":"f' || (turn % 3)::VARCHAR || '.py"}' FROM told WHERE role = 'assistant'
  UNION ALL SELECT session_id, turn, message, role, 1, 'tool_result', substr(text, 1, 80) FROM told WHERE role = 'user' AND called = 1
  UNION ALL SELECT session_id, turn, message, role, 2, 'text', text FROM told)"""
PROMPTS = "prompts AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS prompt_index, text FROM conversations WHERE role = 'user' AND text <> '')"
CALLS = """calls AS (SELECT *, CASE WHEN tool IN ('view', 'signup') THEN 'reasoning' WHEN tool = 'click' THEN 'generation' ELSE 'tool_use' END AS phase, tool <> 'error' AS aligned, 'f' || (k % 7)::VARCHAR AS file,
  CASE WHEN tool = 'error' THEN 'tool_result' ELSE 'tool_use' END AS block_type, CASE WHEN tool = 'error' AND k % 2 = 0 THEN 'Error: permission denied' WHEN tool = 'error' THEN 'command failed' ELSE 'ok' END AS text
  FROM (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position, ts, event_type AS tool, event_type || ' ' || props AS signature, props AS parameters, greatest(1, floor(abs(value)))::BIGINT AS token_count, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
LABELLED = CALLS + """, labelled AS (SELECT * EXCLUDE (aligned, ok), ok AS aligned, CASE WHEN ok THEN 'aligned_' || phase WHEN phase = 'reasoning' THEN 'redundant_reasoning' ELSE 'unnecessary_tool_call' END AS label, CASE WHEN k % 3 = 0 THEN 'user' ELSE 'assistant' END AS source_role
  FROM (SELECT *, aligned AND NOT (tool = 'view' AND k < 60) AS ok FROM calls))"""
USAGE = "usage AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS turn, CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'assistant' END AS role, trunc(l_quantity)::BIGINT * 10 AS input_tokens, floor(floor(l_extendedprice) / 100)::BIGINT AS output_tokens, trunc(l_quantity)::BIGINT * 3 AS cache_creation_tokens, floor(floor(l_extendedprice) / 20)::BIGINT AS cache_read_tokens FROM lineitem)"
RESULTS = "results AS (SELECT session_id, project, ts, round((p % 1000) / 1000.0, 3)::DOUBLE AS aggregate_ter, p AS total_tokens, p // 7 AS waste_tokens, [o_orderstatus, year(ts)::VARCHAR] AS tags, round((p % 997) / 997.0::DOUBLE, 3) AS reasoning_score, round((p % 991) / 991.0::DOUBLE, 3) AS tool_use_score, round((p % 983) / 983.0::DOUBLE, 3) AS generation_score FROM (SELECT o_orderkey AS session_id, o_orderpriority AS project, o_orderdate AS ts, o_orderstatus, floor(o_totalprice)::BIGINT AS p FROM orders))"


def vectors_sql(source: str, keys: str, name: str = "vec") -> str:
    """Unit vectors of hashed trigram counts, as rows."""
    part = lambda i: f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT"
    return f"""{name}_g AS (SELECT {keys}, md5(substr(lower(text), i::INT, 3)) AS h FROM (SELECT {keys}, text, unnest(range(1, length(text) - 1)) AS i FROM {source} WHERE length(text) >= 3)),
{name}_c AS (SELECT {keys}, bucket, count(*)::DOUBLE AS n FROM (SELECT {keys}, ((256 * ({part(0)} + {part(1)} + {part(2)}) + {part(3)}) % 384)::INT AS bucket FROM {name}_g UNION ALL SELECT {keys}, 0 FROM {source} WHERE length(text) < 3) GROUP BY {keys}, bucket),
{name} AS (SELECT {keys}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS weight FROM {name}_c)"""
