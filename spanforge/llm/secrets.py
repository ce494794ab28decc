"""Secret scans with DataFrame functions only.

Base patterns find assigned values, access keys and long hex runs. Beside them, two character Markov models, one of
random strings and one of ordinary identifiers, judge every other token of ``LENGTHS[0]`` characters or more: its
log-likelihood ratio a character must exceed a bound that the labelled samples set, for each class of lengths its own.
The models are counts of character pairs over a fixed alphabet, so what is gathered for them (one row for each pair)
doesn't grow with the input. A bound lies half way between the random strings' low means and those of all ordinary
ones but a thousandth, as a sample of real texts holds some secrets itself. The ordinary sample's documents are drawn by a hash of their first characters and length;
their whole texts are used.

Positions are code points, ends exclusive. Defined results: a null text counts as empty; texts without spans give zero
counts and the digest of nothing; a Markov span never overlaps a base span; rows that repeat are scanned alike; an empty table gives no rows; other
columns are not read, whatever their names. Work grows with a text's length and number of tokens, however long it is;
a task holds one text's matches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import documents
from spanforge.llm.labelled import draw

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Classes of tokens that the models judge, by their least length; shorter ones carry too little.
LENGTHS = (12, 16, 20)
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LENGTHS[0]},}}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
SAMPLE_ROWS, SAMPLE_STRINGS = 4000, 20000
#: Values of a block of running sums.
BLOCK = 128
#: The share of ordinary strings that a bound must exceed. Not all of them: a sample of real texts holds some secrets.
ORDINARY = 0.999
#: Ordinary words of which identifiers are composed for the labelled sample.
WORDS = "account address amount array async block buffer cache call channel client code column command config connection content context count create current data database date default delete description device document domain element error event example export field file filter format frame function group handler header height image index input instance interface item label length level library limit line list local manager message method model module name network node number object offset option order output package page parameter parser path pattern point policy process project property provider query queue range record reference region report request resource response result role root route schema scope script search section server service session setting size source stack start state status storage stream string style system table target task template test text thread time title track transfer type update user value version view widget window worker".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    """For each value, join of all up to it. An array grows by copying, so it is put together from blocks: work per value
    is bounded by BLOCK, and that of the blocks' own sums grows with their number's square, a BLOCK^2-th of the values'."""

    def along(items: Column, start: Column) -> Column:
        add = lambda a, x: F.struct(join(a["last"], x).alias("last"), F.concat(a["out"], F.array(join(a["last"], x))).alias("out"))
        return F.aggregate(items, F.struct(start.alias("last"), F.expr("cast(array() AS array<int>)").alias("out")), add, lambda a: a["out"])

    def of(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), along)))

    def starts(blocks: Column) -> Column:
        ends = along(F.transform(blocks, lambda b: F.aggregate(b, first, join)), first)
        return F.slice(F.concat(F.array(first), ends), 1, F.size(blocks))

    return let(values, of)


def spans(text: Column, pattern: str, found: Column, good: Callable[[Column], Column]) -> Column:
    """array<struct<start, end>> of those of the found matches (all of the pattern's in text, in order) that are good.
    Texts without a good one are not read again."""

    def placed(matches: Column) -> Column:
        both = F.zip_with(matches, F.slice(F.split(text, pattern, -1), 1, F.size(matches)), lambda m, b: F.length(b) + F.length(m))
        at = F.zip_with(running(both, lambda a, x: a + x, F.lit(0)), matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), good(m).alias("good")))
        return F.transform(F.filter(at, lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(F.exists(found, good), let(found, placed)).otherwise(F.expr("cast(array() AS array<struct<start: int, end: int>>)"))


def states(token: Column) -> Column:
    """The token's characters as states; 0 for any other character."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pairs(token: Column) -> Column:
    """The token's pairs of neighbouring states, as one number each."""
    return let(states(token), lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a * STATES + b))


def labelled_strings(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(string, label): 1 for random strings, 0 for identifiers and for long words of a bounded sample of docs."""
    spark = docs.sparkSession
    n = spark.range(strings)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    some_of = F.substring(F.translate(F.base64(F.unhex(digest("few"))), "+/=", "abc"), F.lit(1), (F.col("id") % (LENGTHS[2] - LENGTHS[0]) + LENGTHS[0]).cast("int"))
    random = F.array(some_of, digest("hex"), F.substring(F.base64(F.unhex(digest("b64"))), 1, 40), F.translate(F.base64(F.unhex(digest("url"))), "+/=", "-_"), F.upper(F.translate(F.base64(F.unhex(digest("up"))), "+/=", "xyz")))
    positive = n.select(F.explode(random).alias("string"), F.lit(1).alias("label"))
    words = F.from_json(F.lit(json.dumps(WORDS)), "array<string>")
    pick = lambda salt: F.element_at(words, F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(len(WORDS))).cast("int") + 1)
    a, b, c = pick(1), pick(2), pick(3)
    named = F.array(F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.upper(F.concat_ws("_", c, a, b)), F.concat_ws("-", b, a, c, (F.col("id") % 100).cast("string")), F.concat_ws("/", c, b, a), F.concat(b, c, F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string")))
    negative = n.select(F.explode(named).alias("string"), F.lit(0).alias("label"))
    share = rows / max(1, docs.count())
    some = docs.where(draw(F.xxhash64(F.substring(F.col(text_col), 1, 200), F.length(text_col)), 3) < share) if share < 1 else docs
    ordinary = some.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[A-Za-z][A-Za-z-]{9,}+"), F.lit(0))).alias("string"), F.lit(0).alias("label"))
    return positive.unionByName(negative).unionByName(ordinary)


def train(samples: DataFrame) -> tuple[list[float], list[float]]:
    """(log-likelihood ratio, random to ordinary, by pair of states; the bounds on a token's mean, by class of lengths)."""
    counted = samples.select("label", F.explode(pairs(F.col("string"))).alias("pair")).groupBy("label", "pair").count().collect()
    count = {(r["label"], r["pair"]): r["count"] for r in counted}

    def logs(label: int) -> list[float]:
        out = []
        for a in range(STATES):
            row = [count.get((label, a * STATES + b), 0) + 0.5 for b in range(STATES)]
            total = sum(row)
            out += [math.log(x / total) for x in row]
        return out

    table = [round(r - o, 6) for r, o in zip(logs(1), logs(0), strict=True)] + [0.0] * STATES
    # Half way between the highest means of ordinary strings, but for a few, and the lowest of random ones.
    means = samples.where(F.length("string") >= LENGTHS[0]).select("label", class_of(F.length("string")).alias("class"), mean_ratio(F.col("string"), table).alias("m"))
    low = means.groupBy("label", "class").agg(F.percentile_approx("m", ORDINARY, 10000).alias("most"), F.percentile_approx("m", 0.01, 1000).alias("least")).collect()
    by = {(r["label"], r["class"]): r for r in low}
    bounds = []
    for c in range(len(LENGTHS)):
        both = (0, c) in by and (1, c) in by
        bounds.append(round(max(by[0, c]["most"], (by[0, c]["most"] + by[1, c]["least"]) / 2, 0.2), 6) if both else 0.5)
    return table, bounds


def class_of(length: Column) -> Column:
    out = F.lit(0)
    for c, least in enumerate(LENGTHS[1:], 1):
        out = F.when(length >= least, c).otherwise(out)
    return out


def mean_ratio(token: Column, table: list[float]) -> Column:
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")
    add = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.get(ratios, a["last"] * STATES + c)).alias("sum"))
    # The table's last entry is for the pair that precedes a token's first character.
    return F.aggregate(states(token), F.struct(F.lit(STATES).alias("last"), F.lit(0.0).alias("sum")), add, lambda a: a["sum"]) / F.greatest(F.length(token) - 1, F.lit(1))


def apart(found: Column, base: Column) -> Column:
    """Those of the found spans, in order and without overlaps, that overlap no base span. All are sorted together: a
    span is apart if no base span that starts before its end reaches beyond its start."""
    event = lambda at, own, s: F.struct(at.alias("at"), F.lit(own).alias("own"), s["start"].alias("start"), s["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(found, lambda s: event(s["end"], 0, s)), F.transform(base, lambda s: event(s["start"], 1, s))))

    def alone(es: Column) -> Column:
        reach = running(F.transform(es, lambda e: F.when(e["own"] == 1, e["end"]).otherwise(F.lit(0))), lambda a, x: F.greatest(a, x), F.lit(0))
        free = F.zip_with(es, reach, lambda e, r: F.struct(e["start"].alias("start"), e["end"].alias("end"), ((e["own"] == 0) & (r <= e["start"])).alias("free")))
        return F.transform(F.filter(free, lambda s: s["free"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(let(events, alone))


def _listed(kind: str, found: Column, order: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: tuple[list[float], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the three kinds' base spans and the Markov spans, as arrays of start and end."""
    table, bounds = model
    text, none = F.col("text"), F.expr("cast(array() AS array<string>)")
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        named = named | low.contains(word)
    found = lambda test, pattern: F.when(test, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = base.select("*", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tokens"), found(named, ASSIGN).alias("assigns"))
    # Long hex runs and access keys lie within tokens.
    matched = tokens.select("*", found(F.exists("tokens", lambda t: t.contains("AKIA")), ACCESS).alias("accesses"), found(F.exists("tokens", lambda t: F.length(t) >= 32), HEX).alias("hexes"))
    every = lambda m: F.lit(True)
    bound = lambda length: F.get(F.array(*map(F.lit, bounds)), class_of(length))
    placed = matched.select(
        "doc_id",
        spans(text, ASSIGN, F.col("assigns"), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8).alias("assign"),
        spans(text, ACCESS, F.col("accesses"), every).alias("access"),
        spans(text, HEX, F.col("hexes"), every).alias("hex"),
        spans(text, TOKEN, F.col("tokens"), lambda t: mean_ratio(t, table) > bound(F.length(t))).alias("random"),
    )
    return placed.select("doc_id", "assign", "access", "hex", apart(F.col("random"), F.concat("assign", "access", "hex")).alias("markov"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, train(labelled_strings(docs)))
    base = F.concat(*(_listed(k, F.col(k), i) for i, k in enumerate(("assign", "access", "hex"))))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, _listed("markov", F.col("markov"), 3))).alias("spans"))
