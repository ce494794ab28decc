"""Personal data by a semi-Markov conditional random field.

Base patterns find e-mail addresses, IPv4 addresses, card and telephone numbers; what they find stays. The random field
adds what they miss: other separators, spelt-out addresses. A segmentation's score is the sum of its segments' scores,
each of a whole span (its shape, digits, checksum, parts, the words before it) for its type, and of a weight for each
type and the one that follows, or nothing. A dynamic programme over token borders and types chooses boundaries and types
together. Entities are bounded: a segment has at most ``LONGEST`` tokens, and it holds ``DIGITS`` digits or more, or a
spelt-out at with a domain of two parts behind it. The field is trained here, by stochastic gradient on the conditional
likelihood of generated, labelled sentences.

Where no such segment can be, all tokens are outside, so only the tokens within a segment's reach of digits and
ats are worked on; the result is that of the whole text. The field works between base spans.

Positions are code points, ends exclusive. Defined results: a null text counts as empty; texts without spans give zero
counts and the digest of nothing; an added span never overlaps a base span; repeated rows are scanned alike; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import documents, through_python

KINDS = ("email", "ip", "card", "phone")
LONGEST, DIGITS = 32, 4
#: Words before a segment that its score looks at.
CUE_TOKENS = 6
#: An added span must be more likely than leaving it by this log-ratio.
MARGIN = 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+")
#: An at, as a sign or a word, with a host and one more part behind it. Each way begins with a plain character, which the
#: engine looks for first.
_TAIL = re.compile(r"(?:@|\(\s*[aA][tT]\s*[)\]]|\[\s*[aA][tT]\s*[)\]]|a(?<!\wa)[tT]\b|A(?<!\wA)[tT]\b)\s*[A-Za-z0-9-]+(?:\.|\s*[(\[]\s*[dD][oO][tT]\s*[)\]]\s*|\s+[dD][oO][tT]\s+)[A-Za-z0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_AT = re.compile(r"@|\bat\b|[(\[]at[)\]]", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9._%+-]+\s*(?:@|[(\[]\s*at\s*[)\]]|\s+at\s+)\s*[a-z0-9-]+(?:\s*(?:\.|[(\[]\s*dot\s*[)\]]|\s+dot\s+)\s*[a-z0-9-]+)+", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # the local part is the run before an at-sign, back to the last match
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, lo, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# The random field.

_CUES = (("mail", "email", "e-mail", "contact"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "mastercard"), ("phone", "tel", "call", "mobile", "fax", "cell"))
_SHAPES = ("d", "w", " ", ".", "-", "(", ")", "+", "@", "/", ":", ",", "#", "$", "%", "_")
N_FEATURES = 44


def segment_features(tokens: list[str], i: int, j: int, before: list[str]) -> np.ndarray:
    """Of tokens[i:j] as a whole; before: the words to its left."""
    s = "".join(tokens[i:j])
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    x = np.zeros(N_FEATURES)
    x[0] = 1
    n = len(d)
    x[1 + min(n, 20) // 2] = 1  # 1 to 11: digits, in pairs
    x[12] = 10 <= n <= 11
    x[13] = 13 <= n <= 19 and luhn(d)
    x[14] = 13 <= n <= 19
    x[15] = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    x[16] = len(groups) == 4 and all(len(g) == 4 for g in groups)
    x[17] = len(groups) == 3 and [len(g) for g in groups] == [3, 3, 4]
    x[18] = bool(_NAME.fullmatch(s))
    x[19] = bool(_AT.search(s))
    x[20] = s[:1] == "+" or s[:2] == "00"
    x[21] = s[:1] == "("
    separators = re.sub("[0-9]", "", s)
    kinds = set(separators)
    x[22] = len(kinds) == 1
    x[23] = len(kinds) > 2
    for k, c in enumerate((" ", ".", "-", "/", ":", ",")):
        x[24 + k] = c in kinds
    x[30] = any(c.isalpha() for c in separators)
    x[31] = len(kinds) == 0
    x[32] = s[:1].isspace() or s[-1:].isspace()
    x[33] = not (s[-1:].isalnum())
    x[34] = len(groups) > 1 and len({len(g) for g in groups[:-1]}) == 1
    neighbours = (tokens[i - 1] if i else " ") + (tokens[j] if j < len(tokens) else " ")
    x[35] = neighbours[0].isdigit() or neighbours[-1].isdigit()
    x[36] = neighbours[0] in ".-/:$#_" or (neighbours[-1] in "-/:%_")
    x[37] = bool(re.fullmatch(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}).*", s))
    x[38] = any(len(g) > 5 for g in groups) and len(groups) > 1
    x[39] = len(groups) > 5
    for k, cues in enumerate(_CUES):
        x[40 + k] = any(w in cues for w in before)
    return x


def candidates(tokens: list[str]) -> list[tuple[int, int]]:
    """Segments of bounded length that hold enough digits or an at with a domain."""
    n = len(tokens)
    digits = np.cumsum([0, *(len(t) if t[0] in "0123456789" else 0 for t in tokens)]).tolist()
    starts = np.cumsum([0, *map(len, tokens)]).tolist()
    text = "".join(tokens)
    # For each place, the least end of a segment from there that holds an at with its domain.
    reach, ends = [n + 1] * (n + 1), []
    for m in _TAIL.finditer(text):
        ends.append((bisect(starts, m.start()) - 1, bisect(starts, m.end() - 1)))
    for first, end in reversed(ends):
        reach[first] = min(reach[first], end)
    for i in range(n - 1, -1, -1):
        reach[i] = min(reach[i], reach[i + 1])
    out = []
    for i, t in enumerate(tokens):
        if t.isspace() or t in ".,;:)]\"'!?" or digits[min(n, i + LONGEST)] - digits[i] < DIGITS and reach[i] > i + LONGEST:
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            last = tokens[j - 1]
            if "\n" in last:
                break
            if (digits[j] - digits[i] >= DIGITS or reach[i] <= j) and not last.isspace() and last not in ".,;:(+[\"'!?":
                out.append((i, j))
    return out


def lattice(tokens: list[str]) -> tuple[list[tuple[int, int]], np.ndarray]:
    segments = candidates(tokens)
    rows = []
    before, at = [], -1
    for i, j in segments:
        if i != at:
            before, at = [t.lower() for t in tokens[max(0, i - CUE_TOKENS) : i] if t.isalpha()], i
        rows.append(segment_features(tokens, i, j, before))
    return segments, np.array(rows).reshape(len(rows), N_FEATURES)


@dataclass
class Field:
    """segment: weights, features by kinds; follows: weights of a kind (rows) and the next (columns); the last column is
    for an outside token or the end. What follows an outside token or the start weighs nothing."""

    segment: np.ndarray
    follows: np.ndarray


OUTSIDE = len(KINDS)


def best(n: int, segments: list[tuple[int, int]], scores: np.ndarray, follows: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, i, j, score) of the best segmentation; a token outside has score 0."""
    into: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(segments):
        into.setdefault(j, []).append(s)
    tr, sc = follows.tolist(), scores.tolist()
    none = float("-inf")
    value = [[none] * OUTSIDE + [0.0]]
    back: list[list] = [[None] * (OUTSIDE + 1)]
    kinds = range(OUTSIDE)
    for j in range(1, n + 1):
        before = value[j - 1]
        top, source = before[OUTSIDE], OUTSIDE
        for y in kinds:
            if before[y] + tr[y][OUTSIDE] > top:
                top, source = before[y] + tr[y][OUTSIDE], y
        now, come = [none] * OUTSIDE + [top], [None] * OUTSIDE + [(j - 1, source, None)]
        for s in into.get(j, ()):
            i, here = segments[s][0], sc[s]
            left = value[i]
            for k in kinds:
                entered, y0 = left[OUTSIDE], OUTSIDE
                for y in kinds:
                    if left[y] + tr[y][k] > entered:
                        entered, y0 = left[y] + tr[y][k], y
                if entered + here[k] > now[k]:
                    now[k], come[k] = entered + here[k], (i, y0, s)
        value.append(now)
        back.append(come)
    state, top = OUTSIDE, value[n][OUTSIDE]
    for y in kinds:
        if value[n][y] + tr[y][OUTSIDE] > top:
            state, top = y, value[n][y] + tr[y][OUTSIDE]
    out, j = [], n
    while j:
        i, before_state, s = back[j][state]
        if s is not None:
            out.append((state, i, j, sc[s][state]))
        j, state = i, before_state
    return out[::-1]


def _expected(n: int, segments: list[tuple[int, int]], scores: np.ndarray, follows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log of the partition sum, each segment's and kind's probability, and how often each kind and next are expected."""
    m, o = len(segments), OUTSIDE
    i, j = (np.array(x, int) for x in zip(*segments, strict=True)) if m else (np.zeros(0, int),) * 2
    by_end, by_start = np.argsort(j, kind="stable"), np.argsort(i, kind="stable")
    end_at, start_at = np.searchsorted(j[by_end], np.arange(n + 2)), np.searchsorted(i[by_start], np.arange(n + 2))
    lse = lambda x: np.logaddexp.reduce(x, axis=0)
    a, enter = np.full((n + 1, o + 1), -np.inf), np.full((n + 1, o), -np.inf)
    a[0, o] = 0.0
    enter[0] = 0.0
    for t in range(1, n + 1):
        a[t, o] = lse(np.r_[a[t - 1, o], a[t - 1, :o] + follows[:, o]])
        own = by_end[end_at[t] : end_at[t + 1]]
        if len(own):
            a[t, :o] = lse(scores[own] + enter[i[own]])
        enter[t] = np.logaddexp(a[t, o], lse(a[t, :o, None] + follows[:, :o]))
    total = lse(np.r_[a[n, o], a[n, :o] + follows[:, o]])
    b = np.zeros((n + 2, o + 1))
    b[n, :o] = follows[:, o]
    for t in range(n - 1, -1, -1):
        own = by_start[start_at[t] : start_at[t + 1]]
        ahead = lse(scores[own] + b[j[own], :o]) if len(own) else np.full(o, -np.inf)
        b[t, o] = np.logaddexp(b[t + 1, o], lse(ahead))
        b[t, :o] = np.logaddexp(follows[:, o] + b[t + 1, o], lse((follows[:, :o] + ahead).T))
    p = np.exp(enter[i] + scores + b[j, :o] - total) if m else np.zeros((0, o))
    q = np.zeros_like(follows)
    if m:
        q[:, :o] = np.exp(a[i][:, :o, None] + follows[None, :, :o] + (scores + b[j, :o])[:, None, :] - total).sum(0)
    q[:, o] = np.exp(a[: n + 1, :o] + follows[:, o] + np.r_[b[1 : n + 1, o], 0.0][:, None] - total).sum(0)
    return float(total), p, q


def training_sentences(n: int, seed: int = 3) -> list[list[tuple[str, int | None]]]:
    """Generated sentences: pieces of text, each with its kind or None."""
    r = random.Random(seed)
    words = "the order was sent to our office last week please note that this item costs more and we will reply soon about report page section total amount number version release see also".split()
    names, hosts, ends = ("anna", "john.smith", "k_miller", "info", "sales99", "b.lee"), ("example", "mail-box", "corp", "univ", "shop24"), ("com", "org", "net", "de", "co")
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + dig(r.choice((14, 14, 14, 13, 12)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def piece(kind: int) -> str:
        if kind == 0:
            at, dot = r.choice((" at ", "(at)", "[at]", " [at] ", " (at) ", " @ ")), r.choice((" dot ", "(dot)", "[dot]", " [dot] ", "."))
            return r.choice(names) + at + r.choice(hosts) + dot + r.choice(ends)
        if kind == 1:
            sep = r.choice((" . ", "[.]", "(.)", "-"))
            return sep.join(str(r.randint(1, 254)) for _ in range(4))
        if kind == 2:
            c, sep = card(), r.choice((".", "/", "_", " - "))
            return sep.join(c[i : i + 4] for i in range(0, len(c), 4))
        f = r.choice(("({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "1-{}-{}-{}", "({}){}-{}"))
        return f.format(str(r.randint(201, 989)), str(r.randint(201, 989)), dig(4))

    def other() -> str:
        return r.choice((
            lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
            lambda: f"${r.randint(1, 999)},{dig(3)}.{dig(2)}", lambda: dig(r.randint(1, 12)), lambda: dig(16), lambda: f"{dig(4)}-{dig(4)}", lambda: f"{r.randint(1, 12)}:{dig(2)}:{dig(2)}", lambda: hashlib.md5(dig(9).encode()).hexdigest(),
            lambda: f"{r.randint(1, 9)} {r.randint(10, 99)} {r.randint(100, 999)}", lambda: f"{dig(3)}.{dig(3)}.{dig(3)}.{dig(3)}", lambda: f"no. {dig(5)}", lambda: f"{r.randint(1, 99)}%", lambda: f"met at {r.choice(hosts)} in", lambda: f"at {r.choice(words)} {dig(2)}", lambda: f"@{r.choice(names)}", lambda: f"{dig(2)}-{dig(2)}-{dig(2)}", lambda: f"{dig(4)} {dig(4)} {dig(4)} {dig(4)}", lambda: "pp. {}-{}".format(dig(3), dig(3)), lambda: f"{dig(3)}-{dig(2)}-{dig(4)}",
        ))()

    out = []
    for _ in range(n):
        sentence: list[tuple[str, int | None]] = []
        for _ in range(r.randint(1, 3)):
            sentence.append((" ".join(r.choice(words) for _ in range(r.randint(1, 4))) + " ", None))
            if r.random() < 0.5:
                kind = r.randrange(4)
                if r.random() < 0.4:
                    sentence.append((r.choice(_CUES[kind]) + r.choice((" ", ": ")), None))
                sentence.append((piece(kind), kind))
            else:
                sentence.append((other(), None))
            sentence.append((r.choice((" ", ". ", ", ", " and ")), None))
        out.append(sentence)
    return out


def train(n: int = 700, epochs: int = 4, seed: int = 3) -> Field:
    data = []
    for sentence in training_sentences(n, seed):
        tokens = _TOKEN.findall("".join(s for s, _ in sentence))
        starts = np.cumsum([0, *map(len, tokens)]).tolist()
        at, gold = 0, {}
        for s, kind in sentence:
            if kind is not None:
                gold[starts.index(at), starts.index(at + len(s))] = kind
            at += len(s)
        segments, x = lattice(tokens)
        assert gold.keys() <= set(segments), "a generated entity is no candidate segment"
        if segments:
            y = np.zeros((len(segments), len(KINDS)))
            for s, ij in enumerate(segments):
                if ij in gold:
                    y[s, gold[ij]] = 1
            follows = np.zeros((len(KINDS), len(KINDS) + 1))
            begins = {i: k for (i, _), k in gold.items()}
            for (_, j), k in gold.items():
                follows[k, begins.get(j, OUTSIDE)] += 1
            data.append((len(tokens), segments, x, y, follows))
    field = Field(np.zeros((N_FEATURES, len(KINDS))), np.zeros((len(KINDS), len(KINDS) + 1)))
    field.segment[0] = -2
    squares = [np.full_like(w, 1e-6) for w in (field.segment, field.follows)]
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for size, segments, x, y, follows in data:
            _, p, q = _expected(size, segments, x @ field.segment, field.follows)
            for w, square, g in zip((field.segment, field.follows), squares, (x.T @ (p - y), q - follows), strict=True):
                g = g + 2e-4 * w
                square += g * g
                w -= 0.4 * g / np.sqrt(square)
    return field


@lru_cache(1)
def trained() -> Field:
    return train()


def _edge(text: str, at: int, stop: int, n: int, step: int) -> int:
    """Where n tokens from ``at`` on end, or before it begin (step -1), but no further than stop."""
    width = 128
    while True:
        far = min(stop, at + width) if step > 0 else max(stop, at - width)
        tokens = _TOKEN.findall(text[at:far] if step > 0 else text[far:at])
        if step < 0:
            tokens.reverse()
        if far == stop or len(tokens) > n:  # the last one may be cut off
            return at + step * sum(map(len, tokens[:n])) if len(tokens) > n else far
        width *= 2


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of the text that hold every segment with what its score looks at; there is nothing else to find elsewhere."""
    runs = [m.span() for m in _TRIGGER.finditer(text)]
    if sum(b - a for a, b in runs) < DIGITS:
        runs = []
    runs += [m.span() for m in _TAIL.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and b <= out[-1][2]:
            continue
        lo = out[-1][0] if out and a <= out[-1][1] else _edge(text, a, out[-1][1] if out else 0, LONGEST + CUE_TOKENS, -1)
        hi = _edge(text, b, len(text), LONGEST, 1)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi, b)
        else:
            out.append((lo, hi, b))
    return [(lo, hi) for lo, hi, _ in out]


def decoded(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation of a text, all of which is worked on at once."""
    tokens = _TOKEN.findall(text)
    segments, x = lattice(tokens)
    if not segments:
        return []
    starts = np.cumsum([0, *map(len, tokens)]).tolist()
    return [(k, starts[i], starts[j]) for k, i, j, _ in best(len(tokens), segments, x @ field.segment - MARGIN, field.follows)]


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """What the random field finds apart from the base spans."""
    out, at = [], 0
    for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:  # the field works between base spans
        if a - at > DIGITS:
            part = text[at:a]
            for lo, hi in regions(part):
                out += [(k, at + lo + s, at + lo + e) for k, s, e in decoded(part[lo:hi], field)]
        at = max(at, b)
    return out


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end)."""
    held = docs.sparkSession.sparkContext.broadcast(trained() if field is None else field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda found: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found]
        for batch in it:
            base, added = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append(named(found))
                added.append(named(added_spans(text, found, held.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(added, span)], ["doc_id", "base", "added"])

    kind = docs.schema[id_col].dataType.simpleString()
    one = "array<struct<kind: string, start: bigint, end: bigint>>"
    return through_python(docs.select(id_col, text_col), batches, f"doc_id {kind}, base {one}, added {one}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    order = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, range(len(KINDS)))))
    listed = lambda a: F.array_join(F.transform(F.array_sort(F.transform(a, lambda s: F.struct(F.element_at(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
