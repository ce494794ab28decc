"""Every registered query and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.functions import vectors as V
from spanforge.operators import economics, history, inputs, intents, patterns, quality, reasoning, similar, spans
from spanforge.plans import analyze, assemble, views
from spanforge.sources import transcripts
from spanforge.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '\\s+'), lambda w: w <> '')"


def hits(column: str, cues: tuple[str, ...]) -> str:
    return "(" + " + ".join("contains(lower({}), '{}')::INT".format(column, c.replace("'", "''")) for c in cues) + ")"


def ter_sql(source: str, by: str = "session_id") -> str:
    w = spans.PHASE_WEIGHTS
    sums = ", ".join(f"coalesce(sum(token_count) FILTER (WHERE phase = '{p}'), 0)::BIGINT AS {p}_n, coalesce(sum(token_count) FILTER (WHERE phase = '{p}' AND aligned), 0)::BIGINT AS {p}_a" for p in spans.PHASES)
    scores = ", ".join(f"round(CASE WHEN {p}_n = 0 THEN 1.0::DOUBLE ELSE {p}_a / {p}_n::DOUBLE END, 4) AS {p}_score" for p in spans.PHASES)
    return f"""SELECT {by}, round(round({" + ".join(f"{p}_score * {w[p]}::DOUBLE" for p in spans.PHASES)}, 9)::DECIMAL(18, 9), 4)::DOUBLE AS aggregate_ter, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE a / n::DOUBLE END, 4) AS raw_ratio, {", ".join(f"{p}_score" for p in spans.PHASES)}, n AS total_tokens, a AS aligned_tokens, n - a AS waste_tokens
FROM (SELECT *, {scores} FROM (SELECT {by}, {sums}, sum(token_count)::BIGINT AS n, coalesce(sum(token_count) FILTER (WHERE aligned), 0)::BIGINT AS a FROM {source} GROUP BY {by}))"""


LABEL_SQL = f"""WITH {views.TURNS}, {views.PROMPTS},
intents AS (SELECT session_id, string_agg(CASE WHEN prompt_index = 0 THEN text ELSE text || ' ' || text END, ' ' ORDER BY prompt_index) AS text FROM prompts GROUP BY session_id),
{views.vectors_sql("turns", "session_id, position")}, {views.vectors_sql("intents", "session_id", "goal")},
near AS (SELECT v.session_id, v.position, round(sum(v.weight * g.weight), 9) AS similarity FROM vec v JOIN goal g USING (session_id, bucket) GROUP BY ALL),
pairs AS (SELECT a.session_id, a.position, b.position AS other, sum(a.weight * b.weight) AS s FROM vec a JOIN vec b ON a.session_id = b.session_id AND a.bucket = b.bucket AND b.position < a.position AND a.position - b.position <= 10 GROUP BY ALL),
rep AS (SELECT session_id, position, round(max(s), 9) AS repetition FROM pairs GROUP BY ALL),
l AS (SELECT t.*, coalesce(similarity, 0) AS similarity, NOT (coalesce(repetition, 0) >= 0.88 OR (coalesce(similarity, 0) < 0.088 AND len({words("text")}) > 50)) AS aligned FROM turns t LEFT JOIN near USING (session_id, position) LEFT JOIN rep USING (session_id, position))
"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.label(views.turns(spark, sf), analyze.intents_of(views.prompts(spark, sf)))


@query(LABEL_SQL + ter_sql("l"))
def ter_by_session(spark: SparkSession, sf: str) -> DataFrame:
    return spans.ter(_labelled(spark, sf))


@query(LABEL_SQL + "SELECT session_id, position, round(similarity, 6) AS similarity, CASE WHEN aligned THEN 'aligned_generation' ELSE 'over_explanation' END AS label FROM l")
def span_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("session_id", "position", F.round("similarity", 6).alias("similarity"), "label")


@query(f"WITH {views.LABELLED} " + ter_sql("labelled"))
def ter_from_events(spark: SparkSession, sf: str) -> DataFrame:
    return spans.ter(views.labelled_calls(spark, sf))


@query(f"WITH {views.TURNS} SELECT role, count(*) AS n_spans, sum(token_count)::BIGINT AS tokens, max(token_count) AS longest FROM turns GROUP BY role")
def spans_tokens_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return views.turns(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n_spans"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("longest"))


_THIRD = ", ".join(f"round(CASE WHEN coalesce(sum(token_count) FILTER (WHERE third = {k}), 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(sum(token_count) FILTER (WHERE third = {k} AND aligned), 0) / (sum(token_count) FILTER (WHERE third = {k}))::DOUBLE END, 4) AS {n}_ter" for k, n in enumerate(("early", "mid", "late")))


@query(f"WITH {views.LABELLED}, t AS (SELECT *, least((row_number() OVER (PARTITION BY session_id ORDER BY position) - 1) // greatest(1, count(*) OVER (PARTITION BY session_id) // 3), 2) AS third FROM labelled) SELECT session_id, {_THIRD} FROM t GROUP BY session_id")
def positional_ter(spark: SparkSession, sf: str) -> DataFrame:
    return spans.thirds(views.labelled_calls(spark, sf))


@query(f"""WITH {views.USAGE}, s AS (SELECT session_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_creation_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens FROM usage WHERE role = 'assistant' GROUP BY session_id)
SELECT *, round(CASE WHEN cache_read_tokens + input_tokens = 0 THEN 0 ELSE cache_read_tokens / (cache_read_tokens + input_tokens)::DOUBLE END, 4) AS cache_hit_rate, round(round(CASE WHEN output_tokens = 0 THEN 0 ELSE input_tokens / output_tokens::DOUBLE END, 9)::DECIMAL(18, 9), 2)::DOUBLE AS io_ratio,
round((input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE + cache_read_tokens * 0.3::DOUBLE + cache_creation_tokens * 3.75::DOUBLE) / 1e6, 8) AS cost_usd FROM s""")
def session_economics(spark: SparkSession, sf: str) -> DataFrame:
    return economics.usage(views.usage(spark, sf))


@query(f"""WITH {views.USAGE}, c AS (SELECT session_id, turn, input_tokens + cache_read_tokens AS context FROM usage WHERE role = 'assistant' AND input_tokens + cache_read_tokens > 100),
d AS (SELECT *, context - lag(context) OVER (PARTITION BY session_id ORDER BY turn) AS step FROM c),
g AS (SELECT session_id, count(*) AS turns, arg_min(context, turn) AS f, arg_max(context, turn) AS l, arg_min(step, turn) FILTER (WHERE step IS NOT NULL) AS fs, arg_max(step, turn) FILTER (WHERE step IS NOT NULL) AS ls FROM d GROUP BY session_id),
r AS (SELECT session_id, turns, round(round(CASE WHEN turns < 2 THEN 1.0::DOUBLE ELSE l / f::DOUBLE END, 9)::DECIMAL(18, 9), 2)::DOUBLE AS growth_rate, coalesce(turns >= 3 AND ls > fs, false) AS super_linear FROM g)
SELECT *, super_linear AND growth_rate > 2 AS bloat FROM r""")
def input_growth(spark: SparkSession, sf: str) -> DataFrame:
    return economics.growth(views.usage(spark, sf))


@query(f"""WITH {views.LABELLED}, b AS (SELECT c_custkey AS session_id, sum(floor(o_totalprice / 1000)::BIGINT)::BIGINT AS output_tokens FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey),
s AS (SELECT session_id, coalesce(sum(token_count) FILTER (WHERE source_role = 'assistant'), 0) AS e, coalesce(sum(token_count) FILTER (WHERE source_role = 'assistant' AND NOT aligned), 0) AS w FROM labelled GROUP BY session_id)
SELECT session_id, round(r, 4) AS calibration, round(w * r * 15.0::DOUBLE / 1e6, 6) AS waste_cost_usd FROM (SELECT session_id, w, CASE WHEN e = 0 OR output_tokens = 0 THEN 1.0::DOUBLE ELSE output_tokens / e::DOUBLE END AS r FROM s JOIN b USING (session_id))""")
def output_waste_cost(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = views.table(spark, sf, "orders"), views.table(spark, sf, "customer")
    billed = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_custkey").alias("session_id")).agg(F.sum(F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("output_tokens"))
    return economics.waste_cost(views.labelled_calls(spark, sf), billed)


def pattern_sql(kind: str, body: str, start: str, end: str, n: str, tokens: str, detail: str, with_: str = views.LABELLED) -> str:
    return f"WITH {with_}, {body} SELECT session_id, '{kind}' AS pattern_type, ({start})::BIGINT AS start_position, ({end})::BIGINT AS end_position, ({n})::BIGINT AS spans_involved, ({tokens})::BIGINT AS tokens_wasted, ({detail})::VARCHAR AS detail FROM found"


_ISLAND = "sum(CASE WHEN {change} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING)"


@query(pattern_sql("reasoning_loop", f"m AS (SELECT *, phase = 'reasoning' AND label = 'redundant_reasoning' AS here FROM labelled), i AS (SELECT *, {_ISLAND.format(change='NOT here')} AS island FROM m), found AS (SELECT session_id, min(position) AS s, max(position) AS e, count(*) AS n, sum(token_count) AS t FROM i WHERE here GROUP BY session_id, island HAVING count(*) >= 2)", "s", "e", "n", "t", "NULL"))
def reasoning_loops(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.reasoning_loops(views.labelled_calls(spark, sf), least=2)


@query(pattern_sql("edit_fragmentation", f"e AS (SELECT *, lag(file) OVER (PARTITION BY session_id ORDER BY position) AS b FROM calls WHERE tool IN ('click', 'purchase')), i AS (SELECT *, {_ISLAND.format(change='b IS NULL OR b <> file')} AS island FROM e), found AS (SELECT session_id, count(*) AS n, sum(token_count) - arg_min(token_count, position) AS t, any_value(file) AS d FROM i GROUP BY session_id, island HAVING count(*) >= 3)", "0", "0", "n", "t", "d"))
def edit_runs(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.edit_fragmentation(views.calls(spark, sf).where("tool IN ('click', 'purchase')"))


@query(pattern_sql("duplicate_tool_call", "p AS (SELECT a.session_id, a.signature, a.position, min(b.position) AS f, any_value(a.token_count) AS t FROM calls a JOIN calls b ON a.session_id = b.session_id AND a.signature = b.signature AND b.position < a.position AND a.position - b.position <= 5 GROUP BY ALL), found AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY session_id, signature ORDER BY position) = 1)", "f", "position", "2", "t", "signature"))
def duplicate_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.duplicate_calls(views.calls(spark, sf))


@query(pattern_sql("repetitive_read", "found AS (SELECT session_id, file, count(*) AS n, sum(token_count) - arg_min(token_count, position) AS t FROM calls WHERE tool = 'view' GROUP BY session_id, file HAVING count(*) >= 3)", "0", "0", "n", "t", "file"))
def repetitive_reads(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.repeated(views.calls(spark, sf).where("tool = 'view'"), "repetitive_read", "file")


_COMMAND = "CASE k % 6 WHEN 0 THEN 'cat  a.txt | tail -' || k WHEN 1 THEN 'ls | grep x' WHEN 2 THEN 'find . -name b' WHEN 3 THEN ' make   test | head -20 ' WHEN 4 THEN 'make test' ELSE 'rg foo | head -3' END"
_COMMANDS = views.CALLS + f", cmd AS (SELECT *, {_COMMAND} AS command FROM calls)"


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    return views.calls(spark, sf).withColumn("command", F.expr(_COMMAND))


@query(pattern_sql("repeated_command", r"p AS (SELECT *, regexp_replace(regexp_replace(trim(command), '\s*\|\s*(tail|head)\s+-\d+\s*$', ''), '\s+', ' ', 'g') AS plain FROM cmd), found AS (SELECT session_id, plain, count(*) AS n, sum(token_count) - arg_min(token_count, position) AS t FROM p GROUP BY session_id, plain HAVING count(*) >= 3)", "0", "0", "n", "t", "plain", _COMMANDS))
def repeated_commands(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.repeated(_commands(spark, sf).withColumn("plain", T.plain_command(F.col("command"))), "repeated_command", "plain")


_BETTER = "CASE " + " ".join(f"WHEN regexp_matches(trim(command), '{p}') THEN '{t}'" for p, t in T.SHELL_TOOLS) + " END"


@query(pattern_sql("bash_antipattern", f"p AS (SELECT *, {_BETTER} AS better FROM cmd), b AS (SELECT session_id, better, count(*) AS n, sum(greatest(token_count, 1)) AS t FROM p WHERE better IS NOT NULL GROUP BY ALL), found AS (SELECT session_id, sum(n) AS n, sum(t) AS t, string_agg(better || '=' || n, ',' ORDER BY better) AS d FROM b GROUP BY session_id)", "0", "0", "n", "t", "d", _COMMANDS))
def bash_antipatterns(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.shell_antipatterns(_commands(spark, sf))


@query(pattern_sql("failed_tool_retry", "b AS (SELECT session_id, k, arg_max(token_count, position) AS t FROM calls WHERE starts_with(text, 'Error:') GROUP BY ALL), found AS (SELECT session_id, count(*) AS n, sum(t) AS t FROM b GROUP BY session_id)", "0", "0", "n", "t", "NULL"))
def failed_results(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.failed_results(views.calls(spark, sf).withColumn("tool_use_id", F.col("k")))


def _chain_sql(kind: str, trouble: str, least: int, alike: str = "true") -> str:
    body = f"""s AS (SELECT *, sum(CASE WHEN block_type = 'tool_result' AND {trouble} THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS trouble FROM calls),
u AS (SELECT *, lag(tool) OVER w AS t0, lag(trouble) OVER w AS x0, lag(parameters) OVER w AS p0 FROM s WHERE block_type = 'tool_use' WINDOW w AS (PARTITION BY session_id ORDER BY position)),
i AS (SELECT *, {_ISLAND.format(change=f"NOT coalesce(t0 = tool AND trouble > x0 AND {alike}, false)")} AS island FROM u),
found AS (SELECT session_id, min(position) AS s, max(position) AS e, count(*) AS n, sum(token_count) - arg_min(token_count, position) AS t, any_value(tool) AS d FROM i GROUP BY session_id, island HAVING count(*) >= {least + 1})"""
    return pattern_sql(kind, body, "s", "e", "n", "t", "d")


@query(_chain_sql("permission_loop", "contains(lower(text), 'permission denied')", 1))
def permission_loops(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.permission_loops(views.calls(spark, sf), least=1)


_GRAMS = lambda c: f"list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i::INT, 3))"
_MANY = lambda c: f"len(list_filter({_GRAMS(c)}, lambda x: x = g))"
_SUM = lambda c, a, b: f"list_sum(list_transform(list_distinct({_GRAMS(c)}), lambda g: {_MANY(a)} * {_MANY(b)}))::DOUBLE"
_ALIKE = f"CASE WHEN p0 = parameters THEN 1.0 WHEN p0 = '' OR parameters = '' THEN 0.0 WHEN length(p0) < 3 OR length(parameters) < 3 THEN 1.0 ELSE {_SUM('p0', 'p0', 'parameters')} / sqrt({_SUM('p0', 'p0', 'p0')} * {_SUM('parameters', 'parameters', 'parameters')}) END >= 0.5"


@query(_chain_sql("error_retry_spiral", hits("text", T.ERROR_WORDS) + " > 0", 1, _ALIKE))
def error_spirals(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.error_spirals(views.calls(spark, sf), least=1, similarity=0.5)


_OPS = "o AS (SELECT *, tool = 'click' AS is_write, tool = 'view' AS is_read FROM calls WHERE tool IN ('click', 'view'))"


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    return views.calls(spark, sf).where("tool IN ('click', 'view')").withColumn("is_write", F.col("tool") == "click").withColumn("is_read", F.col("tool") == "view")


@query(pattern_sql("over_reading", f"{_OPS}, n AS (SELECT *, sum(is_write::INT) OVER (PARTITION BY session_id, file ORDER BY position ROWS UNBOUNDED PRECEDING) AS epoch FROM o), m AS (SELECT *, max(epoch) OVER (PARTITION BY session_id, file) AS last FROM n), found AS (SELECT session_id, file, min(position) AS s, max(position) AS e, count(*) AS n, sum(token_count) - arg_min(token_count, position) AS t FROM m WHERE is_read AND epoch = last GROUP BY session_id, file HAVING count(*) >= 3)", "s", "e", "n", "t", "file"))
def over_reading(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.over_reading(_operations(spark, sf))


@query(pattern_sql("abandoned_approach", f"{_OPS}, n AS (SELECT *, max(position) OVER (PARTITION BY session_id) AS last FROM o), found AS (SELECT session_id, file, min(position) AS s, max(position) AS e, count(*) AS n, sum(token_count) AS t FROM n GROUP BY session_id, file HAVING arg_max(is_write, position) AND any_value(last) > max(position))", "s", "e", "n", "t", "file"))
def abandoned_approaches(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.abandoned(_operations(spark, sf))


@query(pattern_sql("verbose_thinking", "a AS (SELECT *, min(CASE WHEN phase <> 'reasoning' THEN position END) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM calls), j AS (SELECT a.*, greatest(c.token_count, 1) AS g FROM a LEFT JOIN calls c ON c.session_id = a.session_id AND c.position = a.np WHERE a.phase = 'reasoning' AND a.token_count >= 20), found AS (SELECT * FROM j WHERE np IS NULL OR token_count / g::DOUBLE > 1.5)", "position", "coalesce(np, position)", "CASE WHEN np IS NULL THEN 1 ELSE 2 END", "CASE WHEN np IS NULL THEN token_count ELSE token_count - floor(1.5::DOUBLE * g) END", "CASE WHEN np IS NULL THEN 'inf' ELSE round(round(token_count / g::DOUBLE, 9)::DECIMAL(18, 9), 2)::DOUBLE::VARCHAR END"))
def verbose_thinking(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.verbose_thinking(views.calls(spark, sf), least=20, ratio=1.5)


_REST = f"""WITH {views.TURNS}, {views.vectors_sql("turns", "session_id, position")},
p AS (SELECT a.session_id, a.position, b.position AS prior, round(sum(a.weight * b.weight), 9) AS s FROM vec a JOIN vec b ON a.session_id = b.session_id AND a.bucket = b.bucket AND b.position < a.position GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= 0.85),
f AS (SELECT session_id, position, min(prior) AS prior FROM p GROUP BY ALL)
SELECT session_id, 'context_restatement' AS pattern_type, position AS start_position, position AS end_position, 1::BIGINT AS spans_involved, token_count AS tokens_wasted, prior::VARCHAR AS detail FROM f JOIN turns USING (session_id, position)"""


@query(_REST)
def context_restatements(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.restatements(views.turns(spark, sf))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS nth FROM embeddings),
p AS (SELECT a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.label = b.label AND b.nth < a.nth AND a.nth - b.nth <= 10 GROUP BY a.vec_id)
SELECT 0 AS session_id, v.vec_id AS position, v.label::VARCHAR AS phase, round(coalesce(s, 0), 6) AS repetition, round(coalesce(s, 0), 6) >= 0.2 AS repeats FROM v LEFT JOIN p USING (vec_id)""")
def vector_repetition(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "embeddings").select(F.lit(0).alias("session_id"), F.col("vec_id").alias("position"), F.col("label").cast("string").alias("phase"), "embedding")
    return spans.dense_repetition(rows, 0.2)


_PV = f"WITH {views.PROMPTS}, {views.vectors_sql('prompts', 'session_id, prompt_index')}"
_PAIRS = _PV + ", met AS (SELECT a.session_id, a.prompt_index AS i, b.prompt_index AS j, round(sum(a.weight * b.weight), 4) AS s FROM vec a JOIN vec b ON a.session_id = b.session_id AND a.bucket = b.bucket AND a.prompt_index < b.prompt_index GROUP BY ALL), pairs AS (SELECT a.session_id, a.prompt_index AS i, b.prompt_index AS j, coalesce(s, 0)::DOUBLE AS similarity FROM prompts a JOIN prompts b ON a.session_id = b.session_id AND a.prompt_index < b.prompt_index LEFT JOIN met ON met.session_id = a.session_id AND met.i = a.prompt_index AND met.j = b.prompt_index) "
_STEPS = _PV + ", s AS (SELECT a.session_id, a.prompt_index, sum(a.weight * b.weight) AS s FROM vec a JOIN vec b ON a.session_id = b.session_id AND a.bucket = b.bucket AND b.prompt_index = a.prompt_index - 1 GROUP BY ALL), d AS (SELECT p.session_id, p.prompt_index, round(coalesce(s, 0), 4) AS similarity FROM prompts p LEFT JOIN s USING (session_id, prompt_index) WHERE p.prompt_index > 0), steps AS (SELECT *, CASE WHEN similarity >= 0.6 THEN 'convergent' WHEN similarity <= 0.4 THEN 'divergent' ELSE 'evolving' END AS direction FROM d) "


@query(_PAIRS + "SELECT * FROM pairs")
def prompt_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similar.pairs(views.prompts(spark, sf))


@query(_PAIRS + ", l AS (SELECT DISTINCT session_id, unnest([i, j]) AS x FROM pairs WHERE similarity >= 0.75), c AS (SELECT session_id, count(*) AS like_ FROM l GROUP BY 1) SELECT session_id, count(*) AS prompts, round(coalesce(any_value(like_), 0) / count(*)::DOUBLE, 4) AS redundancy FROM prompts LEFT JOIN c USING (session_id) GROUP BY session_id".replace(", l AS", ", l AS", 1))
def prompt_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    p = views.prompts(spark, sf)
    return inputs.redundancy(p)


@query(_PAIRS + "SELECT session_id, i, j, similarity FROM pairs UNION ALL SELECT session_id, j, i, similarity FROM pairs UNION ALL SELECT session_id, prompt_index, prompt_index, 1.0::DOUBLE FROM prompts")
def prompt_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return similar.matrix(views.prompts(spark, sf))


@query(_PV + " SELECT session_id, prompt_index, bucket, round(weight, 9) AS weight FROM vec")
def trigram_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return V.trigram_rows(views.prompts(spark, sf), ["session_id", "prompt_index"]).withColumn("weight", F.round("weight", 9))


@query(_STEPS + "SELECT * FROM steps")
def drift_steps(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.drift_steps(views.prompts(spark, sf))


@query(_STEPS + ", g AS (SELECT session_id, count(*) AS steps, round(avg(similarity), 4) AS avg_similarity, count_if(direction = 'convergent') AS c, count_if(direction = 'divergent') AS d FROM steps GROUP BY session_id) SELECT session_id, steps, avg_similarity, CASE WHEN c = 0 AND d = 0 THEN 'stable' WHEN c > steps / 2.0 THEN 'convergent' WHEN d > steps / 2.0 THEN 'divergent' ELSE 'mixed' END AS trajectory FROM g")
def drift_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.trajectory(inputs.drift_steps(views.prompts(spark, sf)))


_RESPONSES = f"""WITH {views.TURNS}, t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS turn FROM turns),
r AS (SELECT session_id, turn, max(text) FILTER (WHERE role = 'user') AS prompt, string_agg(text, ' ' ORDER BY position) FILTER (WHERE role = 'assistant') AS response FROM t WHERE turn > 0 GROUP BY ALL HAVING count_if(role = 'assistant') > 0),
pr AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS pair_index, prompt, response FROM r)"""


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.prompt_responses(views.turns(spark, sf).withColumn("is_prompt", F.col("role") == "user"))


@query(_RESPONSES + " SELECT session_id, pair_index, length(prompt)::BIGINT AS prompt_length, md5(response) AS response_md5 FROM pr")
def prompt_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).select("session_id", "pair_index", F.length("prompt").cast("long").alias("prompt_length"), F.md5("response").alias("response_md5"))


@query(_RESPONSES + f", pp AS (SELECT session_id, pair_index, prompt AS text FROM pr), rr AS (SELECT session_id, pair_index, response AS text FROM pr), {views.vectors_sql('pp', 'session_id, pair_index', 'a')}, {views.vectors_sql('rr', 'session_id, pair_index', 'b')}, s AS (SELECT session_id, pair_index, sum(a.weight * b.weight) AS s FROM a JOIN b USING (session_id, pair_index, bucket) GROUP BY ALL) SELECT session_id, count(*) AS pairs, round(avg(round(coalesce(s, 0), 4)), 4) AS avg_alignment, count_if(round(coalesce(s, 0), 4) < 0.3)::BIGINT AS low_pairs FROM pr LEFT JOIN s USING (session_id, pair_index) GROUP BY session_id")
def prompt_response_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.alignment(similar.between(_responses(spark, sf), F.col("prompt"), F.col("response")))


@query(f"""WITH {views.PROMPTS}, g AS (SELECT session_id, string_agg(text, ' ' ORDER BY prompt_index) AS all_text, string_agg(CASE WHEN prompt_index = 0 THEN text ELSE text || ' ' || text END, ' ' ORDER BY prompt_index) AS text, count(*) AS n FROM prompts GROUP BY session_id),
b AS (SELECT *, len({words("all_text")}) AS w FROM g), c AS (SELECT *, CASE WHEN w <= 1 THEN 0.2 WHEN w <= 2 THEN 0.3 WHEN w <= 5 THEN 0.5 WHEN w <= 10 THEN 0.7 ELSE 0.85 END::DOUBLE AS base FROM b)
SELECT session_id, md5(text) AS intent_md5, round(CASE WHEN n > 1 THEN least(0.95, base + least(0.1, n * 0.03)) ELSE base END, 2)::DOUBLE AS confidence, n::INT AS prompts FROM c""")
def intent_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.intents_of(views.prompts(spark, sf)).select("session_id", F.md5("text").alias("intent_md5"), "confidence", "prompts")


_WALK = _STEPS.replace("WITH ", "WITH RECURSIVE ", 1) + """, walk AS (SELECT session_id, prompt_index, 0 AS segment, 1 AS length FROM prompts WHERE prompt_index = 0 UNION ALL
SELECT session_id, prompt_index, CASE WHEN fresh THEN segment + 1 ELSE segment END, CASE WHEN fresh THEN 1 ELSE length + 1 END FROM (SELECT p.session_id, p.prompt_index, w.segment, w.length, coalesce(d.similarity, 0) < 0.45 OR w.length >= 5 AS fresh FROM walk w JOIN prompts p ON p.session_id = w.session_id AND p.prompt_index = w.prompt_index + 1 LEFT JOIN d ON d.session_id = p.session_id AND d.prompt_index = p.prompt_index))"""


@query(_WALK + " SELECT session_id, prompt_index::INT AS prompt_index, segment::INT AS segment FROM walk")
def sliding_intents(spark: SparkSession, sf: str) -> DataFrame:
    p = views.prompts(spark, sf)
    return intents.sliding(p, similar.steps(p))


_SURE = "(CASE WHEN w <= 1 THEN 0.2 WHEN w <= 2 THEN 0.3 WHEN w <= 5 THEN 0.5 WHEN w <= 10 THEN 0.7 ELSE 0.85 END)::DOUBLE"


@query(_WALK + f""", own AS (SELECT session_id, segment, prompt_index, text, {_SURE} AS sure FROM (SELECT *, len({words("text")}) AS w FROM walk JOIN prompts USING (session_id, prompt_index)))
SELECT session_id, segment::INT AS part, md5(string_agg(text, ' ' ORDER BY prompt_index)) AS text_md5, round(round(CASE WHEN count(*) > 1 THEN least(0.95, avg(sure) + least(0.1, count(*) * 0.03)) ELSE avg(sure) END, 9)::DECIMAL(18, 9), 2)::DOUBLE AS confidence, count(*)::INT AS prompts FROM own GROUP BY session_id, segment""")
def segment_intents(spark: SparkSession, sf: str) -> DataFrame:
    return intents.strategy("sliding")(views.prompts(spark, sf)).select("session_id", "part", F.md5("text").alias("text_md5"), "confidence", "prompts")


_BLEND = f"""WITH {views.TURNS}, {views.PROMPTS}, {views.vectors_sql("turns", "session_id, position")}, {views.vectors_sql("prompts", "session_id, prompt_index", "goal")},
met AS (SELECT v.session_id, v.position, g.prompt_index, sum(v.weight * g.weight) AS s FROM vec v JOIN goal g USING (session_id, bucket) GROUP BY ALL),
every AS (SELECT t.session_id, t.position, p.prompt_index AS part, round(coalesce(s, 0), 4) AS s FROM turns t JOIN prompts p USING (session_id) LEFT JOIN met ON met.session_id = t.session_id AND met.position = t.position AND met.prompt_index = p.prompt_index),
best AS (SELECT session_id, position, max(s) AS best, arg_min(part, (-s, part)) AS part FROM (SELECT session_id, position, part, s FROM every WHERE part > 0) GROUP BY ALL)"""


@query(_BLEND + " SELECT e.session_id, e.position, round(CASE WHEN best IS NULL THEN e.s ELSE 0.7::DOUBLE * best + (1 - 0.7::DOUBLE) * e.s END, 6) AS score, (CASE WHEN best >= e.s THEN b.part END)::INT AS part FROM every e LEFT JOIN best b USING (session_id, position) WHERE e.part = 0")
def hierarchical_scores(spark: SparkSession, sf: str) -> DataFrame:
    return intents.scores(views.turns(spark, sf), views.prompts(spark, sf))


_WASTE = f"""{views.LABELLED}, c AS (SELECT session_id, CASE WHEN source_role <> 'assistant' THEN 'user_side' ELSE label END AS source, sum(token_count)::BIGINT AS tokens, count(*) AS n FROM labelled WHERE NOT aligned GROUP BY ALL)"""


@query(f"""WITH {_WASTE}, d AS (SELECT a.session_id, a.signature, a.position, any_value(a.token_count) AS t FROM calls a JOIN calls b ON a.session_id = b.session_id AND a.signature = b.signature AND b.position < a.position AND a.position - b.position <= 5 GROUP BY ALL),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY session_id, signature ORDER BY position) = 1),
p AS (SELECT session_id, 'duplicate_tool_call' AS source, sum(t)::BIGINT AS tokens, count(*) AS n FROM f WHERE session_id NOT IN (SELECT session_id FROM c WHERE source = 'unnecessary_tool_call') GROUP BY session_id),
u AS (SELECT * FROM c UNION ALL SELECT * FROM p)
SELECT session_id, source, tokens, n, CASE WHEN source = 'user_side' THEN 'input' ELSE 'output' END AS pricing, round(tokens * CASE WHEN source = 'user_side' THEN 3.0::DOUBLE ELSE 15.0::DOUBLE END / 1e6, 6) AS cost_usd FROM u""")
def waste_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return economics.waste_breakdown(views.labelled_calls(spark, sf), patterns.duplicate_calls(views.calls(spark, sf)))


@query(f"""WITH w AS ({ORACLES["waste_breakdown"]}), t AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS total FROM w)
SELECT session_id, sum(tokens)::BIGINT AS total_tokens, round(sum(cost_usd), 6) AS total_cost_usd, string_agg(source || ':' || tokens::VARCHAR || ':' || n::VARCHAR || ':' || round(round_even(tokens * 100 / total::DOUBLE, 1) * 10)::BIGINT::VARCHAR, ',' ORDER BY cost_usd DESC, source) AS sources FROM t GROUP BY session_id""")
def waste_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The waste table of every session's report as one row: source, tokens, number and tenths of a percent."""
    table = assemble.waste_table(waste_breakdown(spark, sf)).select("session_id", "waste_breakdown.*")
    told = F.transform("sources", lambda x: F.concat_ws(":", x["source"], x["tokens"], x["n"], F.round(x["percentage"] * 10).cast("long")))
    return table.select("session_id", "total_tokens", "total_cost_usd", F.concat_ws(",", told).alias("sources"))


@query(f"""WITH {views.CALLS}, a AS (SELECT session_id, 'repetitive_read' AS pattern_type, file AS detail, sum(token_count) - arg_min(token_count, position) AS t FROM calls WHERE tool = 'view' GROUP BY session_id, file HAVING count(*) >= 3),
e AS (SELECT *, lag(file) OVER (PARTITION BY session_id ORDER BY position) AS b FROM calls WHERE tool IN ('click', 'purchase')), i AS (SELECT *, {_ISLAND.format(change="b IS NULL OR b <> file")} AS island FROM e),
f AS (SELECT session_id, 'edit_fragmentation' AS pattern_type, any_value(file) AS detail, sum(token_count) - arg_min(token_count, position) AS t FROM i GROUP BY session_id, island HAVING count(*) >= 3), u AS (SELECT * FROM a UNION ALL SELECT * FROM f)
SELECT session_id, pattern_type, detail, t::BIGINT AS tokens_wasted, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, pattern_type, detail) AS rank FROM u) WHERE rank <= 5""")
def top_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = patterns.together(repetitive_reads(spark, sf), edit_runs(spark, sf))
    return patterns.top(found).select("session_id", "pattern_type", "detail", "tokens_wasted", "rank")


_BY = " UNION ALL ".join(f"SELECT session_id, '{d}' AS dimension, {c} AS name, sum(token_count)::BIGINT AS tokens FROM labelled WHERE NOT aligned GROUP BY ALL" for d, c in (("category", "label"), ("phase", "phase")))


@query(f"WITH {views.LABELLED} {_BY}")
def waste_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.waste_by(views.labelled_calls(spark, sf))


@query(f"""WITH {views.LABELLED}, n AS (SELECT session_id, sum(token_count)::BIGINT AS n, coalesce(sum(token_count) FILTER (WHERE NOT aligned), 0)::BIGINT AS w FROM labelled GROUP BY session_id), c AS (SELECT session_id, arg_min(label, (-t, label)) AS label, max(t) AS t FROM (SELECT session_id, label, sum(token_count) AS t FROM labelled WHERE NOT aligned GROUP BY ALL) GROUP BY session_id),
f AS (SELECT session_id, file, sum(token_count) - arg_min(token_count, position) AS t FROM calls WHERE tool = 'view' GROUP BY session_id, file HAVING count(*) >= 3), p AS (SELECT session_id, max(t) AS t FROM f GROUP BY session_id)
SELECT session_id, n AS total_tokens, w AS waste_tokens, label AS category, CASE WHEN p.t IS NOT NULL THEN 'repetitive_read' END AS pattern, CASE WHEN w = 0 THEN 'No token is waste.' ELSE concat_ws(' ', format('{{:,}}', w) || ' of ' || format('{{:,}}', n) || ' tokens (' || printf('%.1f', round_even(w * 100 / n::DOUBLE, 1)) || ' %) are waste.', 'Most of it is ' || replace(label, '_', ' ') || ' (' || format('{{:,}}', c.t::BIGINT) || ').', 'The dearest pattern is repetitive read (' || format('{{:,}}', p.t::BIGINT) || ').') END AS explanation FROM n LEFT JOIN c USING (session_id) LEFT JOIN p USING (session_id)""")
def waste_explanations(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.explanations(views.labelled_calls(spark, sf), repetitive_reads(spark, sf))


@query(f"""WITH {views.LABELLED}, t AS ({ter_sql("labelled")}) SELECT session_id % 10 AS group_id, round(sum(aggregate_ter * total_tokens) / sum(total_tokens), 4) AS group_ter, sum(total_tokens)::BIGINT AS total_tokens, sum(waste_tokens)::BIGINT AS waste_tokens, round(sum(waste_tokens) * 100 / sum(total_tokens)::DOUBLE, 1) AS waste_percent, count(*) AS sessions FROM t GROUP BY 1""")
def group_weighted_ter(spark: SparkSession, sf: str) -> DataFrame:
    return spans.group_ter(ter_from_events(spark, sf).withColumn("group_id", F.col("session_id") % 10), "group_id")


_RUN = ", ".join(f"sum(CASE WHEN phase = '{p}' THEN token_count ELSE 0 END) OVER w AS {p}_n, sum(CASE WHEN phase = '{p}' AND aligned THEN token_count ELSE 0 END) OVER w AS {p}_a" for p in spans.PHASES)
_WEIGHED = " + ".join(f"CASE WHEN {p}_n = 0 THEN 1.0::DOUBLE ELSE {p}_a / {p}_n::DOUBLE END * {w}::DOUBLE" for p, w in spans.PHASE_WEIGHTS.items())
_SIGNALS = f"""{views.LABELLED}, r AS (SELECT session_id, position AS msg_seq, sum(token_count) OVER w AS n, sum(CASE WHEN aligned THEN token_count ELSE 0 END) OVER w AS a, {_RUN} FROM labelled WINDOW w AS (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
s AS (SELECT session_id, msg_seq, n::BIGINT AS total_tokens, a::BIGINT AS aligned_tokens, round(round({_WEIGHED}, 9)::DECIMAL(18, 9), 4)::DOUBLE AS ter, round(a / n::DOUBLE, 4) AS raw_ratio, row_number() OVER (PARTITION BY session_id ORDER BY msg_seq)::DOUBLE AS nth FROM r)"""
_ROLL = f"""WITH {_SIGNALS},
d AS (SELECT *, count(*) OVER w AS c, regr_slope(ter, nth) OVER w AS slope FROM s WINDOW w AS (PARTITION BY session_id ORDER BY msg_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
x AS (SELECT session_id, msg_seq, total_tokens, aligned_tokens, ter, raw_ratio, CASE WHEN c < 2 THEN 0.0 ELSE round(slope * c, 6) END + 0.0 AS drift FROM d),
y AS (SELECT *, CASE WHEN abs(drift) < 0.1 THEN 'stable' WHEN drift > 0 THEN 'improving' ELSE 'degrading' END AS direction FROM x),
z AS (SELECT *, CASE WHEN ter < 0.4 THEN 'alert' WHEN (direction = 'degrading' AND abs(drift) > 0.1) OR (total_tokens > 5000 AND raw_ratio < 0.5) THEN 'caution' ELSE 'none' END AS warning FROM y)
SELECT *, warning = 'none' AND direction <> 'degrading' AS healthy FROM z"""


@query(_ROLL)
def rolling_ter_drift(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.labelled_calls(spark, sf).withColumn("msg_seq", F.col("position"))
    return live.warnings(live.drift(live.rolling(rows)))


@query(f"WITH {_SIGNALS}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY msg_seq DESC) = 1) SELECT count(*) AS sessions, round(avg(ter), 4) AS mean_ter, sum(total_tokens)::BIGINT AS total_tokens, (sum(total_tokens) - sum(aligned_tokens))::BIGINT AS waste_tokens FROM l")
def live_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return live.dashboard(live.rolling(views.labelled_calls(spark, sf).withColumn("msg_seq", F.col("position"))))


_NOVEL = f"""WITH {views.TURNS}, f AS (SELECT session_id, position, text, CASE WHEN length(text) >= 3 THEN list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i::INT, 3))) ELSE [] END AS g FROM turns),
s AS (SELECT *, flatten(list(g) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS seen FROM f WHERE len(g) > 0),
n AS (SELECT session_id, position, len(list_filter(g, lambda x: NOT list_contains(coalesce(seen, []), x))) / len(g)::DOUBLE AS novelty FROM s)"""


@query(_NOVEL + " SELECT t.session_id, t.position, round(coalesce(novelty, 0), 6) AS novelty FROM turns t LEFT JOIN n USING (session_id, position)")
def novelty(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.novelty(views.turns(spark, sf)).select("session_id", "position", F.round("novelty", 6).alias("novelty"))


@query(_NOVEL + """, o AS (SELECT t.session_id, t.position, t.token_count, coalesce(novelty, 0) < 0.6 AS stale, row_number() OVER (PARTITION BY t.session_id ORDER BY t.position) - 1 AS idx, count(*) OVER (PARTITION BY t.session_id) AS n FROM turns t LEFT JOIN n USING (session_id, position)),
c AS (SELECT *, CASE WHEN stale AND coalesce(lag(stale) OVER (PARTITION BY session_id ORDER BY position), false) THEN idx - 1 END AS cut FROM o),
m AS (SELECT *, CASE WHEN n >= 3 THEN min(cut) OVER (PARTITION BY session_id) END AS cutoff FROM c),
z AS (SELECT session_id, any_value(cutoff) AS cutoff, sum(token_count)::BIGINT AS total_tokens, coalesce(sum(token_count) FILTER (WHERE cutoff IS NULL OR idx <= cutoff), 0)::BIGINT AS useful_tokens FROM m GROUP BY session_id)
SELECT session_id, coalesce(cutoff, -1)::INT AS cutoff, total_tokens, useful_tokens, total_tokens - useful_tokens AS wasted_tokens, total_tokens - useful_tokens > total_tokens * 0.2 AS is_overthinking, round(useful_tokens / total_tokens::DOUBLE, 4) AS efficiency, CASE WHEN cutoff IS NULL THEN total_tokens ELSE floor(useful_tokens * 1.2::DOUBLE)::BIGINT END AS recommended_budget FROM z""")
def overthinking_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.overthinking(reasoning.segments(views.turns(spark, sf).select("session_id", "position", "text")), 0.6).withColumn("cutoff", F.coalesce("cutoff", F.lit(-1)))


_FILL = "(" + " + ".join("regexp_matches(lower(text), '\\b{}\\b')::INT".format(c.replace("'", "''")) for c in T.FILLERS) + ")"


@query(f"""WITH {views.TURNS}, x AS (SELECT session_id, position, text, len({words("text")}) AS w, {_FILL} AS f, {hits("text", T.NEAR_ANSWER)} * 2.0 AS a, {hits("text", T.CONFIRMING)} * 1.5 AS b, {hits("text", T.EXPLORING)} * 1.0 AS c, {hits("text", T.HIGH_VALUE)} AS high_value FROM turns)
SELECT session_id, position, CASE WHEN w > 0 AND f / greatest(1.0, w / 20.0) > 0.5 THEN 'filler' WHEN greatest(a, b, c) = 0 THEN 'ambiguous' WHEN a = greatest(a, b, c) THEN 'near_answer' WHEN b = greatest(a, b, c) THEN 'confirming' ELSE 'exploring' END AS reasoning_phase, high_value FROM x""")
def reasoning_phases(spark: SparkSession, sf: str) -> DataFrame:
    return views.turns(spark, sf).select("session_id", "position", T.reasoning_phase(F.col("text")).alias("reasoning_phase"), T.hits(F.col("text"), T.HIGH_VALUE).alias("high_value"))


@query(_NOVEL + f""", x AS (SELECT t.session_id, t.position, coalesce(novelty, 0.0) AS novelty, least(1.0::DOUBLE, {_FILL} / greatest(1, len(regexp_extract_all(text, '[.!?]')))::DOUBLE) AS filler, {hits("text", T.HIGH_VALUE)} AS high_value FROM turns t LEFT JOIN n USING (session_id, position))
SELECT session_id, position, round(filler, 6) AS filler_ratio, round(novelty * (1 + 0.2::DOUBLE * high_value) * (1 - 0.5::DOUBLE * filler), 6) AS marginal_value, round(sum(novelty) OVER (PARTITION BY session_id ORDER BY position ROWS UNBOUNDED PRECEDING), 6) AS cumulative_novelty FROM x""")
def marginal_values(spark: SparkSession, sf: str) -> DataFrame:
    """What each span adds: new trigrams, more for valuable words and less for filler; and the sum of novelty so far."""
    parts = reasoning.segments(views.turns(spark, sf))
    return parts.select("session_id", "position", F.round("filler", 6).alias("filler_ratio"), *(F.round(c, 6).alias(c) for c in ("marginal_value", "cumulative_novelty")))


_ROUND4 = lambda x: f"round(round({x}, 9)::DECIMAL(18, 9), 4)::DOUBLE"


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, unnest({words("lower(text)")}) AS word FROM t), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
z AS (SELECT doc_id, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS u, sum(n * log2(n)) AS plogp FROM c GROUP BY doc_id),
s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS sents FROM t), sr AS (SELECT doc_id, unnest(sents) AS x FROM s), sw AS (SELECT doc_id, {words("lower(x)")} AS ws FROM sr),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM sw), r AS (SELECT doc_id, count(*) AS k, count(DISTINCT g) AS d FROM g GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n, 0) AS n, u / n AS rich, log2(n) - plogp / n AS entropy, CASE WHEN len(sents) > 1 AND k > 0 THEN 1 - d / k::DOUBLE ELSE 0.0 END AS red FROM s LEFT JOIN z USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CASE WHEN n > 1 THEN entropy / log2(n) ELSE 0 END AS norm FROM e)
SELECT doc_id, CASE WHEN n > 0 THEN {_ROUND4("0.4::DOUBLE * rich + 0.4::DOUBLE * norm + 0.2::DOUBLE * (1 - red)")} ELSE 0 END AS density, CASE WHEN n > 0 THEN {_ROUND4("rich")} ELSE 0 END AS vocabulary_richness, CASE WHEN n > 0 THEN {_ROUND4("entropy")} ELSE 0 END AS entropy, CASE WHEN n > 0 THEN {_ROUND4("entropy / greatest(1, floor(n / 4))")} ELSE 0 END AS avg_information, CASE WHEN n > 0 THEN {_ROUND4("red")} ELSE 1 END AS redundancy FROM f""")
def semantic_density(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.density(views.texts(spark, sf), "doc_id")


@query(r"""SELECT doc_id, round(d, 6) AS code_density, round_even(length(text) / 3.2::DOUBLE, 0)::BIGINT AS tool_tokens, round_even(length(text) / 4.0::DOUBLE, 0)::BIGINT AS prose_tokens, round(0.8::DOUBLE - d * 0.15::DOUBLE, 6) AS confidence
FROM (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE least(1.0, len(regexp_extract_all(text, '[{}\[\]();=<>]')) / length(text)::DOUBLE) END AS d FROM documents)""")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return views.texts(spark, sf).select("doc_id", F.round(T.code_density(t), 6).alias("code_density"), T.phase_tokens(t, F.lit("tool_use")).alias("tool_tokens"), T.phase_tokens(t, F.lit("generation")).alias("prose_tokens"), F.round(T.count_confidence(t, F.lit("heuristic")), 6).alias("confidence"))


@query(r"""WITH d AS (SELECT doc_id, text, CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE least(1.0, len(regexp_extract_all(text, '[{}\[\]();=<>]')) / length(text)::DOUBLE) END AS d, CASE doc_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'calibrated' ELSE 'heuristic' END AS kind FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
m AS (SELECT *, CASE WHEN length(text) = 0 THEN 'heuristic' ELSE kind END AS method FROM d)
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 WHEN method = 'api' THEN doc_id % 100 WHEN method = 'calibrated' THEN round_even(length(text) / 3.7::DOUBLE, 0) ELSE round_even(length(text) / 4.0::DOUBLE, 0) END::BIGINT AS tokens, round(CASE WHEN length(text) = 0 OR method = 'api' THEN 1.0 WHEN method = 'calibrated' THEN 0.9::DOUBLE - d * 0.15::DOUBLE ELSE 0.8::DOUBLE - d * 0.15::DOUBLE END, 6) AS confidence, method FROM m""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    multiplier = F.when(F.col("doc_id") % 3 == 1, 3.7)
    counted = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 100)
    out = views.texts(spark, sf).select("doc_id", T.count_tokens(F.col("text"), F.lit("generation"), multiplier, counted).alias("c"))
    return out.select("doc_id", "c.tokens", F.round("c.confidence", 6).alias("confidence"), "c.method")


_SENT = "greatest(1, len(regexp_extract_all(text, '[.!?]')))"
_COMPLEX = rf"""f AS (SELECT doc_id, len({words("text")}) AS w, {_SENT} AS s, contains(text, '`')::INT AS code, regexp_matches(text, '[/\\]\w+\.\w+')::INT AS path, {hits("text", T.SIMPLE)} AS si, {hits("text", T.MULTI_FILE)} AS mf, {hits("text", T.ARCHITECTURE)} AS ar, {hits("text", T.BUG)} AS bu, {hits("text", T.FEATURE)} AS fe FROM documents),
g AS (SELECT doc_id, (si * 3 + (w < 15)::INT * 2 + (s <= 2)::INT)::DOUBLE AS a, (bu * 2 + fe * 2 + (w BETWEEN 15 AND 80)::INT * 1.5 + path)::DOUBLE AS b, (mf * 3 + ar * 3 + (w > 80)::INT * 2 + (s > 5)::INT + code * 1.5)::DOUBLE AS c FROM f),
t AS (SELECT doc_id, CASE WHEN a + b + c = 0 THEN 'standard' WHEN a = greatest(a, b, c) THEN 'simple' WHEN b = greatest(a, b, c) THEN 'standard' ELSE 'complex' END AS tier, CASE WHEN a + b + c = 0 THEN 0.33 ELSE greatest(a, b, c) / (a + b + c) END AS confidence FROM g)"""
_TIER = lambda i: "CASE tier " + " ".join(f"WHEN '{t}' THEN {v[i]!r}" for t, v in economics.TIERS.items()) + " END"
_RATE = lambda i: "CASE model " + " ".join(f"WHEN '{m}' THEN {v[i]}::DOUBLE" for m, v in economics.BUDGET_RATES.items()) + " END"


@query(f"WITH {_COMPLEX}, m AS (SELECT *, {_TIER(0)} AS model, {_TIER(1)}::BIGINT AS thinking_tokens, {_TIER(2)}::BIGINT AS total_tokens FROM t) SELECT doc_id, tier, model, thinking_tokens, total_tokens, round((total_tokens - thinking_tokens) / 1e6 * {_RATE(0)} + (thinking_tokens + total_tokens * 0.3::DOUBLE) / 1e6 * {_RATE(1)}, 4) AS cost_usd, round(confidence, 4) AS confidence FROM m")
def complexity_budget(spark: SparkSession, sf: str) -> DataFrame:
    tasks = views.texts(spark, sf).select("doc_id", T.complexity(F.col("text")).alias("c")).select("doc_id", "c.tier", "c.confidence")
    return economics.recommend(tasks)


_HISTORY = "h AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'simple' WHEN 'O' THEN 'standard' ELSE 'complex' END AS complexity, (floor(o_totalprice)::BIGINT % 1000) / 1000.0::DOUBLE AS ter, floor(o_totalprice / 40)::BIGINT AS thinking, floor(o_totalprice / 9)::BIGINT AS total FROM orders)"


@query(f"""WITH {_HISTORY}, g AS (SELECT complexity, count(*) AS n, avg(ter) AS ter, avg(thinking) AS th, avg(total) AS tt FROM h GROUP BY complexity)
SELECT complexity, n, CASE WHEN n < 5 THEN 1.0 ELSE round(greatest(0.3, least(2.0, th / CASE complexity WHEN 'simple' THEN 2048 WHEN 'standard' THEN 8192 ELSE 32768 END * 1.2::DOUBLE)), 3) END AS thinking_multiplier, CASE WHEN n < 5 THEN 1.0 ELSE round(greatest(0.3, least(2.0, tt / CASE complexity WHEN 'simple' THEN 5000 WHEN 'standard' THEN 25000 ELSE 100000 END * 1.2::DOUBLE)), 3) END AS total_multiplier,
CASE WHEN n < 5 THEN NULL WHEN ter > 0.85 AND complexity <> 'simple' THEN CASE complexity WHEN 'standard' THEN 'haiku' ELSE 'sonnet' END WHEN ter < 0.45 AND complexity <> 'complex' THEN CASE complexity WHEN 'simple' THEN 'sonnet' ELSE 'opus' END END AS model_override, round(CASE WHEN n < 5 THEN n / 5.0::DOUBLE ELSE least(1.0, n / 20.0::DOUBLE) END, 3) AS data_confidence FROM g""")
def budget_adjustments(spark: SparkSession, sf: str) -> DataFrame:
    return economics.adjustments(_budgets(spark, sf))


def _budgets(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return views.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "simple").when(F.col("o_orderstatus") == "O", "standard").otherwise("complex").alias("complexity"), ((F.floor(price) % 1000) / 1000.0).alias("ter"), F.floor(price / 40).cast("long").alias("thinking_tokens"), F.floor(price / 9).cast("long").alias("total_tokens"))


@query(f"WITH {_HISTORY} SELECT complexity, count(*) AS n, round(avg(ter), 4) AS avg_ter, floor(avg(thinking))::BIGINT AS avg_thinking_tokens, floor(avg(total))::BIGINT AS avg_total_tokens FROM h GROUP BY complexity")
def budget_summary(spark: SparkSession, sf: str) -> DataFrame:
    return economics.budget_summary(_budgets(spark, sf))


@query(f"""WITH {views.LABELLED}, s AS (SELECT session_id, sum(token_count) * 15.0::DOUBLE / 1e6 AS t, coalesce(sum(token_count) FILTER (WHERE aligned), 0) * 15.0::DOUBLE / 1e6 AS g FROM labelled GROUP BY session_id)
SELECT session_id, round(CASE WHEN t = 0 THEN 1.0 ELSE g / t END, 4) AS cost_weighted_ter, round(t, 6) AS total_cost_usd, round(t - g, 6) AS waste_cost_usd FROM s""")
def cost_weighted_ter(spark: SparkSession, sf: str) -> DataFrame:
    return economics.cost_weighted(views.labelled_calls(spark, sf))


@query(f"WITH {views.LABELLED} SELECT session_id, phase, round(sum(round(token_count / 1e6 * 15.0::DOUBLE, 6)), 6) AS cost_usd, round(coalesce(sum(round(token_count / 1e6 * 15.0::DOUBLE, 6)) FILTER (WHERE NOT aligned), 0), 6) AS waste_cost_usd FROM labelled GROUP BY ALL")
def phase_costs(spark: SparkSession, sf: str) -> DataFrame:
    return economics.phase_costs(views.labelled_calls(spark, sf))


def _usd(x: str) -> str:
    return f"'$' || printf('%.4f', {x})"


@query(f"""WITH {views.LABELLED}, s AS (SELECT session_id, sum(token_count) AS n, sum(token_count) * 15.0::DOUBLE / 1e6 AS t, coalesce(sum(token_count) FILTER (WHERE aligned), 0) * 15.0::DOUBLE / 1e6 AS g FROM labelled GROUP BY session_id),
p AS (SELECT session_id, phase, round(coalesce(sum(round(token_count / 1e6 * 15.0::DOUBLE, 6)) FILTER (WHERE NOT aligned), 0), 6) AS w FROM labelled GROUP BY ALL), x AS (SELECT session_id, max(w) AS w, arg_min(phase, (-w, phase)) AS phase FROM p GROUP BY session_id),
r AS (SELECT session_id, round(CASE WHEN t = 0 THEN 1.0 ELSE g / t END, 4) AS ter, round(t - g, 6) AS waste, round(n * 11.0::DOUBLE / 1e6, 6) AS saving, x.w, x.phase FROM s JOIN x USING (session_id))
SELECT session_id, ter AS cost_weighted_ter, waste AS waste_cost_usd, concat_ws('; ', CASE WHEN waste > 0.01 THEN 'waste costs ' || {_usd("waste")} END, CASE WHEN w > 0 THEN 'most waste is in ' || phase || ': ' || {_usd("w")} END, CASE WHEN session_id % 2 = 0 THEN 'text is repetitive: shorten prompts' END, CASE WHEN session_id % 3 = 0 THEN 'text is thin: much of it is filler' END, CASE WHEN saving > 0 AND ter > 0.7 THEN 'haiku would save ' || {_usd("saving")} END) AS advice FROM r""")
def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.labelled_calls(spark, sf)
    density = rows.select("session_id").distinct().select("session_id", F.when(F.col("session_id") % 3 == 0, 0.2).otherwise(0.8).alias("density"), F.when(F.col("session_id") % 2 == 0, 0.5).otherwise(0.1).alias("redundancy"))
    return economics.cost_report(rows, density).select("session_id", "cost_weighted_ter", "waste_cost_usd", F.concat_ws("; ", "advice").alias("advice"))


@query(f"""WITH {views.CALLS}, s AS (SELECT session_id, sum(token_count) AS t FROM calls GROUP BY session_id) SELECT session_id, model, round(t * (15.0::DOUBLE - rate) / 1e6, 6) AS saving_usd FROM s, (VALUES ('haiku', 4.0::DOUBLE), ('opus', 75.0::DOUBLE)) r(model, rate)""")
def alternative_savings(spark: SparkSession, sf: str) -> DataFrame:
    return economics.alternatives(views.calls(spark, sf))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KEYS = f"""WITH {views.TURNS}, {views.PROMPTS}, w AS (SELECT session_id, unnest({words("replace(replace(lower(text), '-', ' '), '_', ' ')")}) AS word FROM prompts),
c AS (SELECT session_id, word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, word)::INT AS rank FROM c QUALIFY rank <= 30)"""


@query(_KEYS + " SELECT * FROM k")
def prompt_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.keywords(views.prompts(spark, sf), "session_id")


@query(_KEYS + ", kk AS (SELECT session_id, list(word) AS ks FROM k GROUP BY 1), l AS (SELECT t.*, ks IS NULL OR len(list_filter(ks, lambda x: contains(lower(text), x))) / len(ks)::DOUBLE >= 0.4 AS aligned FROM turns t LEFT JOIN kk USING (session_id)) " + ter_sql("l"))
def keyword_quick_ter(spark: SparkSession, sf: str) -> DataFrame:
    return spans.ter(reasoning.quick_labels(views.turns(spark, sf), reasoning.keywords(views.prompts(spark, sf), "session_id")))


@query("""WITH u AS (SELECT DISTINCT o_custkey AS tool_use_id FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey AS tool_use_id FROM orders WHERE o_orderstatus = 'O')
SELECT 0 AS session_id, tool_use_id, 'unmatched_result' AS kind FROM r WHERE tool_use_id NOT IN (SELECT tool_use_id FROM u) UNION ALL SELECT 0, tool_use_id, 'unresolved_call' FROM u WHERE tool_use_id NOT IN (SELECT tool_use_id FROM r)""")
def orphan_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(F.lit(0).alias("session_id"), F.col("o_custkey").alias("tool_use_id"), "o_orderstatus")
    return quality.orphans(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"))


@query("""WITH o AS (SELECT o_custkey AS session_id, o_orderkey AS position, o_orderdate AS ts, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) SELECT session_id, min(position) AS position FROM o WHERE b > ts GROUP BY session_id""")
def chronology(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("position"), F.col("o_orderdate").alias("timestamp"))
    return quality.inversions(rows)


@query(f"""WITH {views.TURNS} SELECT session_id, count(*) AS blocks, count(*) AS text_blocks, 0::BIGINT AS tool_use_blocks, 0::BIGINT AS tool_result_blocks, 0::BIGINT AS thinking_blocks, sum(greatest(1, round_even(length(text) / 4.0::DOUBLE, 0)))::BIGINT AS tokens, round(count(*) * 0.0005::DOUBLE, 4) AS seconds, 100.0::DOUBLE AS text_percent FROM turns GROUP BY session_id""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.health(views.turns(spark, sf))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as messages, some of them billed."""
    zero = F.lit(0).cast("long")
    return views.turns(spark, sf).select("session_id", "position", "role", F.lit(None).cast("timestamp").alias("timestamp"), F.when(F.col("session_id") % 3 == 0, F.col("token_count")).otherwise(zero).alias("input_tokens"), zero.alias("output_tokens"), zero.alias("cache_creation_tokens"), F.when(F.col("position") == 7, -1).otherwise(0).cast("long").alias("cache_read_tokens"))


@query(f"""WITH {views.TURNS}, g AS (SELECT session_id, count_if(role = 'user')::BIGINT AS user_messages, count_if(role = 'assistant')::BIGINT AS assistant_messages, count(*) AS n, sum(greatest(1, round_even(length(text) / 4.0::DOUBLE, 0)))::BIGINT AS e, (sum(CASE WHEN session_id % 3 = 0 THEN token_count ELSE 0 END) - count_if(position = 7))::BIGINT AS b FROM turns GROUP BY session_id)
SELECT session_id, user_messages, assistant_messages, n AS text_blocks, 0::BIGINT AS tool_use_blocks, 0::BIGINT AS tool_result_blocks, 0::BIGINT AS thinking_blocks, 0::BIGINT AS other_blocks, 0::BIGINT AS reasoning_tokens, 0::BIGINT AS tool_use_tokens, e AS generation_tokens, round(n * 0.0005::DOUBLE, 4) AS seconds, CASE WHEN b > 0 THEN b ELSE e END AS tokens FROM g""")
def health_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.health_report(_messages(spark, sf), views.turns(spark, sf))


@query(f"""WITH {views.TURNS}, m AS (SELECT session_id, count(*) AS messages, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, bool_or(position = 7) AS neg, bool_or(role = 'assistant' AND position % 5 = 1) AS unresolved, bool_or(role = 'user' AND position % 5 = 2) AS unmatched FROM turns GROUP BY session_id)
SELECT session_id, messages, concat_ws(',', CASE WHEN NOT u THEN 'no user message' END, CASE WHEN NOT a THEN 'no assistant message' END, CASE WHEN neg THEN 'negative token count' END, CASE WHEN unmatched THEN 'result without a call' END) AS errors, CASE WHEN unresolved THEN 'call without a result' ELSE '' END AS warnings, u AND a AND NOT neg AND NOT unmatched AS valid FROM m""")
def session_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.turns(spark, sf).withColumn("tool_use_id", F.concat_ws(":", "role", "position"))
    uses, results = rows.where("role = 'assistant' AND position % 5 = 1"), rows.where("role = 'user' AND position % 5 = 2")
    found = quality.sessions(_messages(spark, sf), uses, results)
    return found.withColumn("errors", F.concat_ws(",", "errors")).withColumn("warnings", F.concat_ws(",", "warnings"))


@query(f"WITH {views.TURNS}, l AS (SELECT session_id, count_if(role = 'assistant') AS n, arg_max(role, position) AS last FROM turns GROUP BY session_id) SELECT session_id, CASE WHEN n = 0 THEN 0.5 ELSE 0.7 END::DOUBLE AS completeness FROM l")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.completeness(views.turns(spark, sf).withColumn("stop_reason", F.lit(None).cast("string")).withColumn("last_block", F.lit("text")))


@query(f"""WITH {views.RESULTS}, h AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts, session_id) - 1 AS nth, count(*) OVER (PARTITION BY project) AS n FROM results),
g AS (SELECT project, count(*) AS sessions, round(avg(aggregate_ter), 4) AS avg_ter, round(min(aggregate_ter), 4) AS min_ter, round(max(aggregate_ter), 4) AS max_ter, sum(total_tokens)::BIGINT AS total_tokens, sum(waste_tokens)::BIGINT AS waste_tokens, round(avg(aggregate_ter) FILTER (WHERE nth >= n // 2) - avg(aggregate_ter) FILTER (WHERE nth < n // 2), 9) AS d FROM h GROUP BY project)
SELECT * EXCLUDE d, CASE WHEN d > 0.02 THEN 'improving' WHEN d < -0.02 THEN 'degrading' ELSE 'stable' END AS direction FROM g""")
def trend_summary(spark: SparkSession, sf: str) -> DataFrame:
    return history.trend(views.results(spark, sf))


@query(f"WITH {views.RESULTS} SELECT project, session_id, aggregate_ter, row_number() OVER (PARTITION BY project ORDER BY ts DESC, session_id DESC)::INT AS rank FROM results QUALIFY rank <= 20")
def trend_rows(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest(views.results(spark, sf)).select("project", "session_id", "aggregate_ter", "rank")


@query(f"WITH {views.RESULTS}, e AS (SELECT aggregate_ter, total_tokens, waste_tokens, unnest(tags) AS tag FROM results) SELECT tag, count(*) AS sessions, round(avg(aggregate_ter), 4) AS avg_ter, round(avg(total_tokens), 2) AS avg_tokens, round(sum(waste_tokens) / sum(total_tokens)::DOUBLE, 4) AS waste_ratio FROM e GROUP BY tag")
def tag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return history.tag_stats(views.results(spark, sf))


@query(f"WITH {views.RESULTS}, f AS (SELECT session_id, aggregate_ter, concat_ws(',', CASE WHEN aggregate_ter < 0.5 THEN 'aggregate' END, CASE WHEN reasoning_score < 0.4 THEN 'reasoning' END, CASE WHEN tool_use_score < 0.4 THEN 'tool_use' END, CASE WHEN generation_score < 0.4 THEN 'generation' END) AS failed FROM results) SELECT session_id, aggregate_ter, failed = '' AS passed, failed FROM f")
def threshold_check(spark: SparkSession, sf: str) -> DataFrame:
    return history.check(views.results(spark, sf), 0.5, 0.4)


_DUPLICATES = "dup_d AS (SELECT a.session_id, a.signature, a.position FROM calls a JOIN calls b ON a.session_id = b.session_id AND a.signature = b.signature AND b.position < a.position AND a.position - b.position <= 5 GROUP BY ALL), dups AS (SELECT DISTINCT session_id FROM dup_d)"
_PHASE_HINT = " UNION ALL ".join("SELECT session_id, '{}' AS category, '{}' AS suggestion, '{}' AS impact, NULL AS pattern_type FROM t WHERE {}_score < 0.6".format(p, x, i, p) for p, x, i in history.PHASE_HINTS)
_PATTERN_HINT = next("SELECT session_id, '{}' AS category, '{}' AS suggestion, '{}' AS impact, '{}' AS pattern_type FROM dups".format(c, x, i, k) for k, c, x, i in history.PATTERN_HINTS if k == "duplicate_tool_call")


@query(f"WITH {views.LABELLED}, t AS ({ter_sql('labelled')}), {_DUPLICATES}, h AS ({_PATTERN_HINT} UNION ALL {_PHASE_HINT}) SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pattern_type IS NULL, pattern_type, category)::INT AS rank FROM h")
def prompt_hints(spark: SparkSession, sf: str) -> DataFrame:
    return history.hints(ter_from_events(spark, sf), duplicate_tool_calls(spark, sf))


@query(f"WITH {views.RESULTS} SELECT count(*) AS sessions, round(avg(aggregate_ter), 4) AS average_ter, sum(total_tokens)::BIGINT AS total_tokens, sum(waste_tokens)::BIGINT AS waste_tokens FROM results")
def comparison_totals(spark: SparkSession, sf: str) -> DataFrame:
    return history.comparison_totals(views.results(spark, sf))


@query(f"""WITH {views.LABELLED}, a AS ({ter_sql("labelled")}), b AS ({ter_sql("(SELECT * REPLACE (tool <> 'error' AS aligned) FROM labelled)")})
SELECT session_id, round(b.aggregate_ter - a.aggregate_ter, 4) AS aggregate_ter_delta, round(b.raw_ratio - a.raw_ratio, 4) AS raw_ratio_delta, b.total_tokens - a.total_tokens AS total_tokens_delta, b.waste_tokens - a.waste_tokens AS waste_tokens_delta FROM a JOIN b USING (session_id)""")
def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    return history.baseline_delta(ter_from_events(spark, sf), spans.ter(views.calls(spark, sf)), "session_id")


@query(f"SELECT source, round(sum(length(text)::DOUBLE * w) / sum(w::DOUBLE * w), 6) AS multiplier, count(*) AS n FROM (SELECT source, text, len({words('text')}) AS w FROM documents) WHERE w > 0 GROUP BY source")
def calibrate_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.texts(spark, sf).select("source", F.length("text").alias("chars"), T.n_words(F.col("text")).alias("tokens"))
    return economics.calibrate(rows, ["source"])


@query(f"""WITH {views.CALLS}, b AS (SELECT *, lag(phase) OVER (PARTITION BY session_id ORDER BY position) AS before FROM calls), i AS (SELECT *, {_ISLAND.format(change="before IS NULL OR before <> phase")} AS island FROM b)
SELECT session_id, phase, min(position) AS first_position, count(*) AS n_spans, sum(token_count)::BIGINT AS token_count, md5(string_agg(text, ' ' ORDER BY position)) AS text_md5 FROM i GROUP BY session_id, island, phase""")
def merge_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    out = spans.merge_adjacent(views.calls(spark, sf))
    return out.select("session_id", "phase", "first_position", "n_spans", "token_count", F.md5("text").alias("text_md5"))


@query(f"WITH {views.TURNS} SELECT session_id, position, 'low_signal' AS label, 0.1::DOUBLE AS confidence FROM turns WHERE token_count < 40")
def short_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans.short_spans(views.turns(spark, sf), 40)


@query(f"WITH {views.TURNS} SELECT DISTINCT sha256(text) AS content_hash, text FROM turns WHERE sha256(text) NOT IN (SELECT sha256(text) FROM turns WHERE role = 'user')")
def uncached_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.turns(spark, sf)
    return spans.uncached(rows, rows.where("role = 'user'").select(T.content_hash(F.col("text")).alias("content_hash")))


@query(f"WITH {views.PROMPTS}, b AS (SELECT session_id, floor(sum(length(text) // 4))::BIGINT AS user_prompt FROM prompts GROUP BY 1), m AS (SELECT conv_id AS session_id, sum(length(text) // 4)::BIGINT AS g FROM conversations WHERE role = 'assistant' GROUP BY 1), a AS (SELECT DISTINCT conv_id AS session_id FROM conversations WHERE role <> 'system') SELECT session_id, coalesce(user_prompt, 0) AS user_prompt, 0::BIGINT AS user_tool_result, 0::BIGINT AS model_reasoning, 0::BIGINT AS model_tool, coalesce(g, 0) AS model_generation, round(CASE WHEN coalesce(user_prompt, 0) + coalesce(g, 0) = 0 THEN 0 ELSE coalesce(user_prompt, 0) / (coalesce(user_prompt, 0) + coalesce(g, 0))::DOUBLE END, 4) AS user_ratio FROM a LEFT JOIN b USING (session_id) LEFT JOIN m USING (session_id)")
def token_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.token_breakdown(views.turns(spark, sf))


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.messages(transcripts.parse_entries(views.transcript_lines(spark, sf)))


@query(f"""WITH {views.SPOKEN} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY message, k) - 1 AS position, message AS msg_seq, role AS source_role, block_type,
  CASE block_type WHEN 'thinking' THEN 'reasoning' WHEN 'text' THEN 'generation' ELSE 'tool_use' END AS phase, text, greatest(1, length(text) // 4)::BIGINT AS token_count FROM said WHERE text <> ''""")
def transcript_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts, read back: entries, one of each request, blocks, spans."""
    found = transcripts.spans(transcripts.blocks(_spoken(spark, sf)))
    return found.select("session_id", F.col("position").cast("long").alias("position"), F.col("msg_seq").cast("long").alias("msg_seq"), "source_role", "block_type", "phase", "text", "token_count")


@query(f"""WITH {views.SPOKEN} SELECT session_id, count(*) AS messages, (count(*) FILTER (role = 'assistant')) AS billed, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS input_tokens,
  coalesce(sum(length(text) % 50 + 2) FILTER (role = 'assistant'), 0)::BIGINT AS output_tokens, coalesce(sum(length(text) % 7) FILTER (role = 'assistant'), 0)::BIGINT AS cache_read_tokens FROM told GROUP BY ALL""")
def transcript_usage(spark: SparkSession, sf: str) -> DataFrame:
    """What transcripts' requests were billed, each once."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens")]
    return _spoken(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if("has_usage").alias("billed"), *sums)


@query(f"""WITH {views.SPOKEN} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY message) - 1 AS prompt_index, text FROM said WHERE role = 'user' AND block_type = 'text' AND text <> ''""")
def transcript_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.prompts(transcripts.blocks(_spoken(spark, sf))).select("session_id", F.col("prompt_index").cast("long").alias("prompt_index"), "text")


@query(f"""WITH {views.SPOKEN} SELECT a.session_id, 't' || a.turn::VARCHAR AS tool_use_id, 'f' || (a.turn % 3)::VARCHAR || '.py' AS file, coalesce(length(r.text) // 4, 0)::BIGINT AS token_count
  FROM told a LEFT JOIN said r ON r.session_id = a.session_id AND r.block_type = 'tool_result' AND r.turn = a.turn + 1 WHERE a.role = 'assistant'""")
def transcript_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with the tokens of their results."""
    return transcripts.calls(transcripts.blocks(_spoken(spark, sf))).select("session_id", "tool_use_id", "file", "token_count")


@query(f"""WITH {views.SPOKEN}, s AS (SELECT *, CASE block_type WHEN 'thinking' THEN 'reasoning' WHEN 'text' THEN 'generation' ELSE 'tool_use' END AS phase, greatest(1, length(text) // 4)::BIGINT AS token_count FROM said WHERE text <> ''),
  low AS (SELECT *, row_number() OVER w AS nth FROM s WINDOW w AS (PARTITION BY session_id, phase ORDER BY message, k))
  SELECT session_id, phase, count(*) AS spans, sum(token_count)::BIGINT AS tokens, count(*) FILTER (repeats) AS repeats FROM (
    SELECT a.*, EXISTS (SELECT 1 FROM low b WHERE b.session_id = a.session_id AND b.phase = a.phase AND b.nth < a.nth AND b.nth >= a.nth - 10 AND lower(b.text) = lower(a.text)) AS repeats FROM low a) GROUP BY ALL""")
def transcript_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of each phase whose text one of the phase's ten before had."""
    found = transcripts.spans(transcripts.blocks(_spoken(spark, sf)))
    before = W.partitionBy("session_id", "phase").orderBy("position").rowsBetween(-spans.REPETITION_WINDOW, -1)
    again = F.array_contains(F.collect_list(F.lower("text")).over(before), F.lower("text"))
    return found.withColumn("again", again).groupBy("session_id", "phase").agg(F.count(F.lit(1)).alias("spans"), F.sum("token_count").alias("tokens"), F.count_if("again").alias("repeats"))
