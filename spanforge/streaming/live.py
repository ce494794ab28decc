"""Live efficiency: the running state of each session, in batch and as a stream.

Lines come from transcripts that grow (streaming.tail), a file being a session that is named by its path under the folder and
a message's place the offset of its line, or as files in a landing folder, as session_id, msg_seq, request_id, role,
block_type, text. User text extends the intent and forms no span; a user's tool results are ignored; an assistant block is aligned if its trigram vector is close enough to the
intent's, or if there is no intent. A session's efficiency is the phases' aligned shares (1 without tokens), weighted; 0
before the first token.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanforge.functions.runtime import ship_package
from spanforge.functions.vectors import Buckets
from spanforge.operators.spans import PHASE_WEIGHTS, PHASES
from spanforge.sources.transcripts import Snapshots
from spanforge.streaming.tail import tail

#: Drift is that of the last WINDOW values; a session's state keeps RING of them.
THRESHOLD, DRIFT, WINDOW, RING = 0.4, 0.10, 5, 10
PHASE_OF = {"thinking": "reasoning", "tool_use": "tool_use", "tool_result": "tool_use"}
LINE = "session_id string, msg_seq long, request_id string, role string, block_type string, text string"
SIGNAL = "session_id string, msg_seq long, total_tokens long, aligned_tokens long, ter double, raw_ratio double, drift double, direction string"


def drift(signals: DataFrame) -> DataFrame:
    """signals (session_id, msg_seq, ter) with the drift of the last five values: slope times their number."""
    last = W.partitionBy("session_id").orderBy("msg_seq").rowsBetween(-(WINDOW - 1), 0)
    numbered = signals.withColumn("nth", F.row_number().over(W.partitionBy("session_id").orderBy("msg_seq")).cast("double"))
    n = F.count(F.lit(1)).over(last)
    amount = F.when(n < 2, 0.0).otherwise(F.round(F.coalesce(F.regr_slope("ter", "nth").over(last), F.lit(0.0)) * n, 6))
    out = numbered.withColumn("drift", amount + F.lit(0.0)).drop("nth")
    return out.withColumn("direction", F.when(F.abs("drift") < DRIFT, "stable").when(F.col("drift") > 0, "improving").otherwise("degrading"))


def warnings(signals: DataFrame) -> DataFrame:
    """The level of each signal: falling, low, or long and low; a signal without any that doesn't fall is healthy."""
    alert = F.col("ter") < 0.4
    caution = ((F.col("direction") == "degrading") & (F.abs("drift") > DRIFT)) | ((F.col("total_tokens") > 5000) & (F.col("raw_ratio") < 0.5))
    out = signals.withColumn("warning", F.when(alert, "alert").when(caution, "caution").otherwise("none"))
    return out.withColumn("healthy", (F.col("warning") == "none") & (F.col("direction") != "degrading"))


def rolling(blocks: DataFrame) -> DataFrame:
    """Batch form: running tokens after each message. blocks: session_id, msg_seq, phase, token_count, aligned."""
    of = lambda p, good: F.sum(F.when((F.col("phase") == p) & (F.col("aligned") if good else F.lit(True)), F.col("token_count")).otherwise(0))
    per = blocks.groupBy("session_id", "msg_seq").agg(*(of(p, False).alias(f"{p}_n") for p in PHASES), *(of(p, True).alias(f"{p}_a") for p in PHASES))
    run = W.partitionBy("session_id").orderBy("msg_seq").rowsBetween(W.unboundedPreceding, 0)
    sums = per.select("session_id", "msg_seq", *(F.sum(f"{p}_{k}").over(run).alias(f"{p}_{k}") for p in PHASES for k in "na"))
    total, good = (sum((F.col(f"{p}_{k}") for p in PHASES), F.lit(0)) for k in "na")
    share = lambda a, n, none: F.when(n == 0, none).otherwise(a / F.when(n == 0, 1).otherwise(n))
    ter = sum((share(F.col(f"{p}_a"), F.col(f"{p}_n"), 1.0) * PHASE_WEIGHTS[p] for p in PHASES), F.lit(0.0))
    out = sums.select("session_id", "msg_seq", total.alias("total_tokens"), good.alias("aligned_tokens"), F.round(F.round(F.when(total == 0, 0.0).otherwise(ter), 9), 4).alias("ter"), F.round(share(good, total, 0.0), 4).alias("raw_ratio"))
    return out


_BUCKETS = Buckets()


def counts_of(text: str) -> Counter:
    """A text's trigrams by their buckets; each distinct trigram is hashed once in a worker."""
    low = text.lower()
    return Counter(_BUCKETS[low[i : i + 3]] for i in range(len(low) - 2)) if len(low) > 2 else Counter({0: 1})


def similarity(a: dict, b: dict, b_squared: float | None = None) -> float:
    """Cosine; b_squared is the square of b's norm, where it is known."""
    both = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()) if b_squared is None else b_squared)
    return sum(v * b.get(k, 0) for k, v in a.items()) / both if both else 0.0


def blocks_of(line: str) -> list[tuple[str | None, str, str, str]]:
    """(request_id, role, block_type, text) of a transcript's line; nothing of one that is malformed or no message. A call's
    text is its name and its input as JSON with sorted keys."""
    try:
        entry = json.loads(line)
    except ValueError:
        return []
    message = entry.get("message") if isinstance(entry, dict) else None
    if not isinstance(message, dict) or message.get("role") not in ("user", "assistant"):
        return []
    content, out = message.get("content"), []
    for block in [{"type": "text", "text": content}] if isinstance(content, str) else content if isinstance(content, list) else []:
        if not isinstance(block, dict):
            continue
        kind = block.get("type", "text")
        if kind == "tool_use":
            text = f"{block.get('name', '')} {json.dumps(block.get('input', {}), sort_keys=True)}"
        elif kind == "tool_result":
            told = block.get("content", "")
            text = told if isinstance(told, str) else json.dumps(told)
        else:
            text = block.get("text", "")
        if isinstance(text, str) and text:
            out.append((message.get("requestId") or message.get("request_id"), message["role"], str(kind), text))
    return out


def lines_of(raw: DataFrame) -> DataFrame:
    """Transcripts' lines (session, offset, raw) as the rolling state takes them."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [c.split()[0] for c in LINE.split(", ")], [pa.string(), pa.int64(), *[pa.string()] * 4]
        for batch in it:
            found = [(s, at, *b) for s, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True) for b in blocks_of(line)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [[]] * len(names), kinds, strict=True)], names)

    ship_package(raw.sparkSession)
    return raw.select("session", "offset", "raw").mapInArrow(batches, LINE)


def drift_of(values: list[float]) -> tuple[float, str]:
    """As drift() has it, of a session's latest values."""
    last = values[-WINDOW:]
    n = len(last)
    if n < 2:
        return 0.0, "stable"
    mean, middle = sum(last) / n, (n - 1) / 2
    amount = round(sum((i - middle) * (v - mean) for i, v in enumerate(last)) / sum((i - middle) ** 2 for i in range(n)) * n, 6) + 0.0
    return amount, "stable" if abs(amount) < DRIFT else "improving" if amount > 0 else "degrading"


class RollingState(StatefulProcessor):
    """One session's running state: tokens by phase, the latest values, the intent's trigram counts (they add up, so no
    text is kept), and requests seen, which may be forgotten after ``remember_ms``."""

    def __init__(self, remember_ms: int | None = None) -> None:
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{p}_n long, {p}_a long" for p in PHASES) + ", tail string, recent array<double>")
        self.intent = handle.getMapState("intent", "bucket int", "n long")
        self.seen = handle.getMapState("seen", "request string", "n int", *([self.remember_ms] if self.remember_ms else []))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows)).sort_values("msg_seq", kind="stable")
        held = self.sums.get() if self.sums.exists() else (*[0] * 6, "", [])
        n, good = {p: held[2 * i] for i, p in enumerate(PHASES)}, {p: held[2 * i + 1] for i, p in enumerate(PHASES)}
        tail, recent = held[6], list(held[7])
        intent, changed = {k[0]: v[0] for k, v in self.intent.iterator()}, set()
        squared = sum(v * v for v in intent.values())
        out = []
        for seq, message in got.groupby("msg_seq", sort=True):
            first = message.iloc[0]
            if first.role == "assistant" and isinstance(first.request_id, str) and first.request_id:
                if self.seen.containsKey((first.request_id,)):
                    continue
                self.seen.updateValue((first.request_id,), (1,))
            tokens = 0
            for block in message.itertuples():
                if not block.text:
                    continue
                if block.role == "user":
                    if block.block_type == "text":
                        text = (tail + " " if intent else "") + block.text
                        for b, k in counts_of(text).items():
                            had = intent.get(b, 0)
                            intent[b] = had + k
                            squared += k * (2 * had + k)
                            changed.add(b)
                        tail = block.text.lower()[-2:]
                    continue
                k, phase = max(1, len(block.text) // 4), PHASE_OF.get(block.block_type, "generation")
                tokens += k
                n[phase] += k
                if not intent or similarity(counts_of(block.text), intent, squared) >= THRESHOLD:
                    good[phase] += k
            if tokens:
                total, aligned = sum(n.values()), sum(good.values())
                ter = round(sum(PHASE_WEIGHTS[p] * (good[p] / n[p] if n[p] else 1.0) for p in PHASES), 4)
                recent = [*recent, ter][-RING:]
                out.append((key[0], seq, total, aligned, ter, round(aligned / total, 4), *drift_of(recent)))
        self.sums.update((*(x for p in PHASES for x in (n[p], good[p])), tail, recent))
        for b in changed:
            self.intent.updateValue((b,), (intent[b],))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNAL.split(", ")])

    def close(self) -> None:
        pass


def live(lines: DataFrame, remember_ms: int | None = None) -> DataFrame:
    """A stream of signals, one for each assistant message with tokens; needs a checkpoint and the RocksDB state store.
    remember_ms: how long a request is known as seen; without it, always."""
    ship_package(lines.sparkSession)
    return lines.groupBy("session_id").transformWithStateInPandas(statefulProcessor=RollingState(remember_ms), outputStructType=SIGNAL, outputMode="Append", timeMode="ProcessingTime" if remember_ms else "None")


def signals_at(spark: SparkSession, path: str, form: str = "transcripts", remember_ms: int | None = None) -> DataFrame:
    """A stream of the signals of growing transcripts, or of a landing folder of another form."""
    lines = lines_of(tail(spark, path)) if form == "transcripts" else spark.readStream.schema(LINE).format(form).load(path)
    return live(lines, remember_ms)


def watch(spark: SparkSession, path: str, checkpoint: str, on_signal: Callable[[dict], None], interval: str | None = "2 seconds", form: str = "transcripts", remember_ms: int | None = None) -> StreamingQuery:
    """Call on_signal with each signal of the transcripts at path (or of a landing folder of another form), in turn, with its
    warning: at every interval, or, with None, of what there is now. A query with the same checkpoint goes on where the last
    one was; a batch in which a callback failed is told again as a whole. Requests can only be forgotten where the stream
    goes on."""
    if remember_ms and not interval:
        raise ValueError("remember_ms needs an interval")

    def each(batch: DataFrame, _: int) -> None:
        for row in warnings(batch).orderBy("session_id", "msg_seq").toLocalIterator():
            on_signal(row.asDict())

    writer = signals_at(spark, path, form, remember_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class LatestState(StatefulProcessor):
    """One session's latest signal. What it adds to the totals of all sessions is told as differences: the first signal, a
    later one in place of it, and, once no signal has come for ``idle_ms``, its withdrawal."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "msg_seq long, ter long, total long, aligned long, shown boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        got = pd.concat(list(rows))
        last = got.loc[got["msg_seq"].idxmax()]
        held = self.latest.get() if self.latest.exists() else (-1, 0, 0, 0, False)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        now = (int(last.msg_seq), round(last.ter * TER_UNITS), int(last.total_tokens), int(last.aligned_tokens), True)
        now = now if now[0] > held[0] else (*held[:4], True)
        self.latest.update(now)
        was = held[1:4] if held[4] else (0, 0, 0)
        yield pd.DataFrame([(key[0], int(not held[4]), *(a - b for a, b in zip(now[1:4], was, strict=True)))], columns=_names(DIFFERENCE))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        held = self.latest.get() if self.latest.exists() else None
        out = []
        if held and held[4]:
            self.latest.update((*held[:4], False))
            out.append((key[0], -1, *(-x for x in held[1:4])))
        yield pd.DataFrame(out, columns=_names(DIFFERENCE))

    def close(self) -> None:
        pass


#: Values are counted in ten-thousandths, so that sums of differences are exact.
TER_UNITS = 10_000
DIFFERENCE = "session_id string, sessions long, ter long, total_tokens long, aligned_tokens long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def differences(signals: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of what each session's signals change of the dashboard's totals."""
    ship_package(signals.sparkSession)
    return signals.groupBy("session_id").transformWithStateInPandas(statefulProcessor=LatestState(idle_ms), outputStructType=DIFFERENCE, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")


def watch_dashboard(spark: SparkSession, path: str, checkpoint: str, on_totals: Callable[[dict], None], interval: str | None = "2 seconds", form: str = "transcripts", idle_ms: int | None = None) -> StreamingQuery:
    """Call on_totals with the dashboard of all sessions at path after each batch, as dashboard() has it; sessions without a
    signal for idle_ms are no longer in it until they go on. Only a batch's differences are summed up: one row. Totals are kept
    beside the checkpoint by batches' numbers, so a batch that is repeated counts once."""
    totals = f"{checkpoint}-totals"

    def each(batch: DataFrame, number: int) -> None:
        before = Snapshots(spark, totals).read(upto=number - 1)
        columns = _names(DIFFERENCE)[1:]
        change = batch.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))
        held = change if before is None else change.unionByName(before).agg(*(F.sum(c).alias(c) for c in columns))
        r = Snapshots(spark, totals).write(held, number).first()
        mean = (Decimal(r.ter) / TER_UNITS / r.sessions).quantize(Decimal("0.0001"), ROUND_HALF_UP) if r.sessions else Decimal(0)
        on_totals({"sessions": r.sessions, "mean_ter": float(mean), "total_tokens": r.total_tokens, "waste_tokens": r.total_tokens - r.aligned_tokens})

    writer = differences(signals_at(spark, path, form), idle_ms).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dashboard(signals: DataFrame) -> DataFrame:
    """The latest signal of every session, and what it says of them all."""
    latest = signals.groupBy("session_id").agg(F.max_by(F.struct("total_tokens", "aligned_tokens", "ter"), "msg_seq").alias("s"))
    return latest.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("s.ter"), 4).alias("mean_ter"), F.sum("s.total_tokens").alias("total_tokens"), (F.sum("s.total_tokens") - F.sum("s.aligned_tokens")).alias("waste_tokens"))
