"""Packing documents into training sequences by lexical retrieval.

Documents' ids are made once and kept. Token frequencies and the mean length are those of all documents. Documents are
then dealt by the tokens that they share with the fewest others: in the order of their ``RAREST`` rarest shared tokens,
those that share them stand together, whatever file they come from. That order is worked off in shards of about
``shard_tokens`` tokens. A shard has a BM25 inverted index over its documents' tokens; a seed document asks it for unused
neighbours, which fill the seed's window in order of their score by all of the seed's terms. The last neighbour is cut where the window ends and its
rest seeds the next window, so windows are full; what a partition has left at its end is cut into windows of powers of
two, which need no padding. Documents longer than a window first give whole windows of their own. A lost task is repeated
with the same result.

Ids are those of the tokenizer file, whose added tokens are known in texts (``added_tokens``). Where all characters of a
text are plain Latin ones, the tokenizer's own pieces are found for many texts at once, as arrays, and looked up by two
64-bit hashes; other texts are cut into runs that begin with white space. Each worker keeps the ids of pieces it has seen
(at most ``CACHE`` of them; then it starts anew).

Defined results: a null text counts as empty and gives the end id alone; rows that repeat an id are packed as often as
they occur; without ``added_tokens``, strings of added tokens are ordinary text; ties go by an order of ids and texts; other columns
are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import cut, documents, through_python
from spanforge.llm.hashing import BASE, SPREAD, Grown, Table, U, mix

WINDOW, END_ID, SHARD_TOKENS = 2048, 1, 1 << 20
VOCABULARY = "byte_bpe_50k.json"
CACHE = 1_500_000
#: Characters that are worked on at once, if no word is longer.
BLOCK = 1 << 19
#: Shared tokens by which documents are dealt; counters of token frequencies that travel together; tokens of a partition.
RAREST, CHUNK, PARTITION_TOKENS = 8, 1 << 12, 1 << 21
K1, B = 1.2, 0.75
_CHUNK = re.compile("[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+")
# White space beyond ASCII and separators on which regex engines differ: such texts go to the tokenizer whole.
_UNUSUAL = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: Up to here, character classes are as old as the tokenizers; what lies beyond goes to the slower one, which defines the ids.
_PLAIN = re.compile("[\\x00-\\u024f]*")


_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\\t-\\r {_L}{_N}]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")


_BETWEEN = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_ODD, _LETTER, _NUMBER, _OTHER, _SPACE = range(5)


def _kinds() -> np.ndarray:
    """The kind of each plain character; the last entry is for all others."""
    out = np.full(0x251, _OTHER, np.uint8)
    for pattern, kind in ((f"[{_L}]", _LETTER), (f"[{_N}]", _NUMBER), ("[\\t-\\r ]", _SPACE), (_UNUSUAL.pattern, _ODD)):
        found = re.compile(pattern)
        out[[c for c in range(0x250) if found.match(chr(c))]] = kind
    out[-1] = _ODD
    return out


_KINDS = _kinds()
_RANDOM = [r * U(2) + U(1) for r in np.random.default_rng(20240301).integers(0, 1 << 63, (2, len(_KINDS)), np.int64).astype(U)]
_BASES = (BASE, SPREAD)


def _powers_of(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base, U)]))


_POWERS = [_powers_of(b, 64) for b in _BASES]


def piece_starts(points: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pieces begin, of texts that stand one after the other: what _PIECE finds in each of them."""
    n = len(points)
    text_start = np.zeros(n + 1, bool)
    text_start[np.r_[0, ends]] = True
    new_kind = np.r_[True, kind[1:] != kind[:-1], True] | text_start
    starts = new_kind[:-1].copy()
    # The last of a run of white space that something follows: a blank goes with that, another one is a piece.
    last = np.flatnonzero(new_kind[1:n] & (kind[:-1] == _SPACE) & ~text_start[1:n]) if n > 1 else np.zeros(0, np.int64)
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    # An apostrophe that stands alone, with one of some endings, is a piece; what follows is another.
    alone = np.flatnonzero((points == 39) & starts & new_kind[1:])
    alone = alone[alone < n - 1]
    alone = alone[~text_start[alone + 1]]
    if len(alone):
        padded = np.r_[points, 0, 0]
        one, two = padded[alone + 1], padded[alone + 2]
        two = np.where(text_start[np.minimum(alone + 2, n)], 0, two)
        pair = one.astype(np.int64) << 8 | np.where(two < 256, two, 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]), 2, 0))
        alone, size = alone[size > 0], size[size > 0]
        starts[alone + 1] = False
        after = alone + 1 + size
        starts[after[after < n]] = True
    return starts


def sections(text: str) -> Iterator[str]:
    """Parts of a long text, cut before blanks between letters, where a piece begins in any case."""
    at = 0
    while len(text) - at > 2 * BLOCK and (cut_ := _BETWEEN.search(text, at + BLOCK)):
        yield text[at : cut_.start()]
        at = cut_.start()
    if at < len(text):
        yield text[at:]


class Ids:
    """Token ids of texts, by the tokenizer file at path; strings of its added tokens are those tokens, or ordinary text."""

    def __init__(self, path: str, added_tokens: bool = True) -> None:
        import json

        import tiktoken

        self.path, self.added_tokens = path, added_tokens
        # Byte-level vocabularies name each byte by a character: printable ones by themselves, the rest from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["content"]: x["id"] for x in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in added and all(c in byte_of for c in word)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added if added_tokens else {}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.clear()

    @cached_property
    def slow(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True  # added tokens are cut out before
        return out

    def clear(self) -> None:
        """Forget all pieces."""
        self.by_chunk: dict[str, list[int]] = {}
        self.keys, self.checks, self.starts, self.flat = Grown(U), Grown(U), Grown(np.int64), Grown(np.uint32)
        self.starts.add(np.zeros(1, np.int64))
        self.old = self.young = Table(self.keys.all, np.zeros((0, 1), np.int8))

    def _encode(self, chunk: str) -> list[int]:
        return self.fast.encode_ordinary(chunk) if _PLAIN.fullmatch(chunk) else self.slow.encode(chunk, add_special_tokens=False).ids

    def _by_chunks(self, text: str) -> np.ndarray:
        """Ids of a text with other than plain characters."""
        out: list[int] = []
        for chunk in [text] if _UNUSUAL.search(text) else _CHUNK.findall(text):
            if (ids := self.by_chunk.get(chunk)) is None:
                ids = self.by_chunk[chunk] = self._encode(chunk)
            out += ids
        return np.array(out, np.uint32)

    def _learn(self, pieces: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        fresh = list(map(self.fast.encode_ordinary, pieces))
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.starts.add(len(self.flat) + np.cumsum(lengths))
        self.flat.add(np.fromiter(chain.from_iterable(fresh), np.uint32, int(lengths.sum())))
        self.keys.add(keys)
        self.checks.add(checks)
        young = len(self.keys) - len(self.old)
        if young > max(1 << 14, len(self.old) // 4):
            self.old = Table(self.keys.all, np.zeros((len(self.keys), 1), np.int8))
            young = 0
        self.young = Table(self.keys.all[len(self.keys) - young :], np.zeros((young, 1), np.int8))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = self.old.find(keys).astype(np.int64)
        left = np.flatnonzero(at < 0)
        if len(left) and len(self.young):
            later = self.young.find(keys[left])
            at[left] = np.where(later >= 0, later + len(self.old), -1)
        return at

    def _plain(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where some character isn't plain."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        kind = _KINDS[np.minimum(points, len(_KINDS) - 1)]
        odd = np.flatnonzero(kind == _ODD)
        starts = piece_starts(points, kind, ends)
        begins = np.flatnonzero(starts)
        sizes = np.diff(np.r_[begins, len(points)])
        inside = np.arange(len(points)) - np.repeat(begins, sizes)
        most = int(sizes.max(initial=0))
        if len(_POWERS[0]) < most:
            _POWERS[:] = [_powers_of(b, 2 * most) for b in _BASES]
        low = np.minimum(points, len(_KINDS) - 1)
        keys, checks = (mix(np.add.reduceat(r[low] * p[inside], begins)) if len(begins) else np.zeros(0, U) for r, p in zip(_RANDOM, _POWERS, strict=True))
        at = self._find(keys)
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(ends, odd, "right")] = False
        piece_ends = np.searchsorted(begins, ends)
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, piece_ends]))
        unknown = np.flatnonzero((at < 0) & plain[text_of])
        if len(unknown):
            _, first = np.unique(keys[unknown], return_index=True)
            new = unknown[first]
            self._learn([joined[b : b + n] for b, n in zip(begins[new].tolist(), sizes[new].tolist(), strict=True)], keys[new], checks[new])
            at[unknown] = self._find(keys[unknown])
        known = plain[text_of]
        if (self.checks.all[at[known]] != checks[known]).any():  # two pieces of one key: never seen
            return [np.array([i for p in _PIECE.findall(t) for i in self._encode(p)], np.uint32) if ok else None for t, ok in zip(texts, plain.tolist(), strict=True)]
        at = np.where(known, at, 0)
        starts_ = self.starts.all
        length = np.where(known, starts_[at + 1] - starts_[at], 0)
        upto = np.r_[0, np.cumsum(length)]
        flat = self.flat.all[np.arange(upto[-1]) + np.repeat(starts_[at] - upto[:-1], length)]
        bounds = upto[np.r_[0, piece_ends]].tolist()
        return [flat[a:b] if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], plain.tolist(), strict=True)]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.keys) + len(self.by_chunk) > CACHE:
            self.clear()
        parts: list[str] = []
        made: list[list] = []  # of each text: parts' numbers, and added tokens as arrays
        for t in texts:
            own: list = []
            for i, part in enumerate(self.added_pattern.split(t)) if self.added_pattern and self.added_pattern.search(t) else ((0, t),):
                if i % 2:
                    own.append(np.array([self.added[part]], np.uint32))
                else:
                    for piece in sections(part):
                        own.append(len(parts))
                        parts.append(piece)
            made.append(own)
        found: list[np.ndarray | None] = []
        while len(found) < len(parts):
            begin = end = len(found)
            size = 0
            while end < len(parts) and (end == begin or size + len(parts[end]) <= BLOCK):
                size += len(parts[end])
                end += 1
            found += [self._by_chunks(p) if ids is None else ids for p, ids in zip(parts[begin:end], self._plain(parts[begin:end]), strict=True)]
        end = np.array([END_ID], np.uint32)
        return [np.concatenate([*(found[x] if isinstance(x, int) else x for x in own), end]) for own in made]


@lru_cache(1)
def ids_by(path: str, added_tokens: bool) -> Ids:
    """One for each worker process, which keeps it from task to task."""
    return Ids(path, added_tokens)


class Index:
    """BM25 over the documents of a shard, by the frequencies (n, mean length, df of each token) of all documents or else
    of the shard alone."""

    def __init__(self, docs: list[np.ndarray], overall: tuple[int, float, np.ndarray] | None = None) -> None:
        self.n = len(docs)
        lengths = np.fromiter(map(len, docs), np.float64, self.n)
        owner = np.repeat(np.arange(self.n), lengths.astype(np.int64))
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) << 32 | owner, return_counts=True)
        token, self.doc = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        self.start = np.r_[first, len(token)]
        df = np.diff(self.start)
        n, mean, all_df = overall or (self.n, lengths.mean(), None)
        among = df if all_df is None else all_df[token[first]]
        idf = np.log1p((n - among + 0.5) / (among + 0.5))
        term = np.repeat(np.arange(len(df)), df)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / mean))
        # A document's query: all its terms that occur in other documents of the shard too; others score nothing.
        useful = df[term] > 1
        order = np.argsort(self.doc[useful], kind="stable")
        self.terms = term[useful][order]
        self.of = np.searchsorted(self.doc[useful][order], np.arange(self.n + 1))

    def scores(self, seed: int, terms: int | None = None) -> np.ndarray:
        """By all terms of the seed, or by its most telling ones."""
        query = self.terms[self.of[seed] : self.of[seed + 1]]
        if not len(query):
            return np.zeros(self.n)
        begin, size = self.start[query], self.start[query + 1] - self.start[query]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        if terms is not None and terms < len(query):
            own = self.weight[at[self.doc[at] == seed]]
            keep = np.zeros(len(query), bool)
            keep[np.lexsort((query, -own))[:terms]] = True
            at = at[np.repeat(keep, size)]
        return np.bincount(self.doc[at], self.weight[at], self.n)


class Packer:
    def __init__(self, window: int, query_terms: int | None, first_sequence: int, overall: tuple[int, float, np.ndarray] | None = None) -> None:
        self.window, self.query_terms, self.sequence, self.overall = window, query_terms, first_sequence, overall
        self.room, self.open = window, []  # the window that is being filled: (row, ids, start)
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, ids, start, length in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), self.sequence, at))
            at += length
        self.sequence += 1

    def put(self, doc_id: object, ids: np.ndarray, start: int) -> int:
        """Fill the open window from the document; where the rest of it starts."""
        length = min(self.room, len(ids) - start)
        self.open.append((doc_id, ids, start, length))
        self.room -= length
        if not self.room:
            self.emit(self.open)
            self.open, self.room = [], self.window
        return start + length

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        rest = []
        for doc_id, ids in zip(doc_ids, docs, strict=True):
            whole = len(ids) // self.window * self.window
            for at in range(0, whole, self.window):
                self.emit([(doc_id, ids, at, self.window)])
            rest.append(whole)
        index, unused = Index(docs, self.overall), np.array([len(d) > r for d, r in zip(docs, rest, strict=True)])
        for seed in range(len(docs)):
            if not unused[seed]:
                continue
            at, now = seed, rest[seed]
            while at is not None:  # a window's last document, where it was cut, seeds the next window
                unused[at] = False
                while now < len(docs[at]):
                    now = self.put(doc_ids[at], docs[at], now)
                if not self.open:
                    break
                score = index.scores(at, self.query_terms)
                score[~unused] = 0
                near = np.flatnonzero(score > 0)
                near = near[np.lexsort((near, -score[near]))]
                cut = None
                for neighbour in near:
                    unused[neighbour] = False
                    before = self.sequence
                    if (upto := self.put(doc_ids[neighbour], docs[neighbour], rest[neighbour])) < len(docs[neighbour]):
                        cut, now = int(neighbour), upto
                    if self.sequence != before:
                        break
                at = cut

    def finish(self) -> None:
        """Cut what is open into windows of powers of two."""
        pieces, self.open = self.open, []
        left = sum(p[3] for p in pieces)
        while left:
            room, part = 1 << left.bit_length() - 1, []
            left -= room
            while room:
                doc_id, ids, start, length = pieces.pop(0)
                take = min(room, length)
                part.append((doc_id, ids, start, take))
                room -= take
                if take < length:
                    pieces.insert(0, (doc_id, ids, start + take, length - take))
            self.emit(part)
        self.room = self.window


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, added_tokens: bool = True) -> DataFrame:
    """(doc_id, n, ids) of each document and, with n null, (chunk, counts): parts of tokens' document frequencies."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids_of = ids_by(tokenizer or public_tokenizers.path(VOCABULARY), added_tokens)
        df, kind = np.zeros(CHUNK, np.int64), None
        names = ["doc_id", "n", "ids", "chunk", "counts"]
        for batch in it:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = ids_of.many([t or "" for t in part.column(1).to_pylist()])
                for ids in found:
                    own = np.unique(ids)
                    if own[-1] >= len(df):
                        df = np.r_[df, np.zeros((int(own[-1]) // CHUNK + 1) * CHUNK - len(df), np.int64)]
                    df[own] += 1
                raw = [ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes() for ids in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array(raw, pa.binary()), pa.nulls(len(raw), pa.int64()), pa.nulls(len(raw), pa.binary())], names)
        if kind is not None:
            chunks = [(c, x.tobytes()) for c, x in enumerate(df.reshape(-1, CHUNK)) if x.any()]
            k = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([c for c, _ in chunks], pa.int64()), pa.array([x for _, x in chunks], pa.binary())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return through_python(docs.select(id_col, text_col), batches, f"doc_id {kind}, n long, ids binary, chunk long, counts binary")


def frequencies(held: DataFrame) -> np.ndarray:
    """In how many of all documents each token is; one number for each entry of the vocabulary."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.int64)
                sums[c] = sums[c] + part if c in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = held.where("n IS NULL").select("chunk", "counts")
    found = through_python(through_python(parts, add, "chunk long, counts binary").repartition("chunk"), add, "chunk long, counts binary").collect()
    out = np.zeros(max((r.chunk + 1 for r in found), default=0) * CHUNK, np.int64)
    for r in found:
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
    return out


def _ids(raw: list[bytes], n: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype(np.uint32) for x, k in zip(raw, n, strict=True)]


def rare_first(ids: np.ndarray, rank: np.ndarray) -> bytes:
    """The document's rarest shared tokens, as their places in the order of frequency."""
    own = np.unique(rank[ids])
    return own[own >= 0][:RAREST].astype(">u4").tobytes()


def ranks(df: np.ndarray) -> np.ndarray:
    """Each token's place in the order of frequency, -1 for a token that no two documents share."""
    order = np.argsort(df, kind="stable")
    out = np.empty(len(df), np.int64)
    out[order] = np.arange(len(df))
    out[df < 2] = -1
    return out


def dealt(held: DataFrame, df: np.ndarray, tokens: int) -> DataFrame:
    """(doc_id, n, ids) in the order of rare shared tokens; equal ones in an order that doesn't hang on files."""
    rank = held.sparkSession.sparkContext.broadcast(ranks(df))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = [rare_first(ids, rank.value) for ids in _ids(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], ["doc_id", "n", "ids", "rare"])

    kind = held.schema["doc_id"].dataType.simpleString()
    keyed = through_python(held.where("n IS NOT NULL").select("doc_id", "n", "ids"), batches, f"doc_id {kind}, n long, ids binary, rare binary").withColumn("tie", F.xxhash64("ids", "doc_id"))
    return keyed.repartitionByRange(max(1, -(-tokens // PARTITION_TOKENS)), "rare", "tie").sortWithinPartitions("rare", "tie").select("doc_id", "n", "ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, query_terms: int | None = None, added_tokens: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens_of = cut(tokenized(docs, id_col, text_col, tokenizer, added_tokens))
    n, total = tokens_of.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = frequencies(tokens_of)
    overall = docs.sparkSession.sparkContext.broadcast((n, total / max(n, 1), df))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, query_terms, TaskContext.get().partitionId() << 40, overall.value)
        held_ids, held, tokens = [], [], 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(cols)], names)

        kind = pa.int64()
        for batch in it:
            kind = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(2).to_pylist(), batch.column(1).to_pylist()), strict=True):
                held_ids.append(doc_id)
                held.append(ids)
                tokens += len(ids)
                if tokens >= shard_tokens:
                    packer.shard(held_ids, held)
                    held_ids, held, tokens = [], [], 0
                    yield out()
        if held:
            packer.shard(held_ids, held)
        packer.finish()
        yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    return through_python(dealt(tokens_of, df, total), batches, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
