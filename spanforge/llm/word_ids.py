"""Token ids by a lower-casing BPE vocabulary with word ends, for many texts at once.

Such a tokenizer drops white space and never joins what white space parts, so that texts are cut into pieces (letters,
numerals, other signs, English endings after an apostrophe) which have ids of their own. Texts of plain Latin characters are
cut as arrays and their pieces looked up by hashes; pieces seen for the first time are merged by a table over bytes, in
which a word's last byte has a code of its own. Texts with other characters, or with the vocabulary's added tokens, go to
the tokenizer itself, run by run between ASCII white space.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np

from spanforge.llm.packing import BLOCK, CACHE, Ids, sections

_RUN = re.compile("[^ \\t-\\r]+")
_SPACES = " \t\n\x0b\x0c\r"
#: Bytes that merged pieces may have: lower-case letters, signs, and those of UTF-8 up to U+024F; lead bytes end no word.
_INNER = [*range(0x61, 0x7B), *range(0x80, 0xC0), *(c for c in range(0x21, 0x7F) if not chr(c).isalnum())]
_LEAD = [*range(0xC2, 0xCA)]
#: Longer pieces go to the tokenizer.
LONGEST = 500


class Merges:
    """The merges of single pieces, by a table over bytes; other pieces by the tokenizer."""

    def __init__(self, path: str, otherwise) -> None:  # noqa: ANN001
        import tiktoken

        self.otherwise = otherwise
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        codes = iter(range(256))
        inner = {b: next(codes) for b in [*_INNER, *_LEAD]}
        last = {b: next(codes) for b in _INNER}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks: dict[bytes, int] = {}
        self.digit: dict[str, int] = {}
        for word, i in vocabulary.items():
            ends = word.endswith("</w>") and len(word) > 4
            raw = [byte_of.get(c, -1) for c in (word[:-4] if ends else word)]
            if ends and len(raw) == 1 and 48 <= raw[0] < 58:
                self.digit[chr(raw[0])] = i
            if all(b in inner for b in raw[:-1]) and raw[-1] in (last if ends else inner):
                ranks[bytes([*(inner[b] for b in raw[:-1]), (last if ends else inner)[raw[-1]]])] = i
        self.inner, self.last = (bytes(t.get(b, 0) for b in range(256)) for t in (inner, last))
        self.known = bytes(inner)
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode_ordinary(self, piece: str) -> list[int]:
        """Ids of letters, or of numerals, or of other signs, with white space around them or not."""
        word = piece.strip(_SPACES)
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > LONGEST or raw.translate(None, self.known) or not word.isascii() and any(map(str.isnumeric, word)):
            return [self.digit[c] for c in word] if word.isascii() and word.isdigit() else self.otherwise(word)
        return self.merge(raw[:-1].translate(self.inner) + raw[-1:].translate(self.last)) if raw else []


class WordIds(Ids):
    """Ids by the tokenizer file at path, which knows its added tokens in texts; without any end id."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.fast = Merges(path, self._encode)
        self.clear()

    @cached_property
    def slow(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encode(self, chunk: str) -> list[int]:
        return self.slow.encode(chunk, add_special_tokens=False).ids

    def _by_runs(self, text: str) -> np.ndarray:
        out: list[int] = []
        for run in _RUN.findall(text):
            if (ids := self.by_chunk.get(run)) is None:
                ids = self.by_chunk[run] = self._encode(run)
            out += ids
        return np.array(out, np.uint32)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.keys) + len(self.by_chunk) > CACHE:
            self.clear()
        parts, owner = [], []
        for i, t in enumerate(texts):
            if "<|" not in t:
                # Else a blank would go with the apostrophe after it, which then isn't the first of its piece.
                for part in sections(t.lower().replace(" '", "\n'")):
                    parts.append(part)
                    owner.append(i)
        found: list[list[np.ndarray | None]] = [[None] if "<|" in t else [] for t in texts]
        begin = 0
        while begin < len(parts):
            end, size = begin, 0
            while end < len(parts) and (end == begin or size + len(parts[end]) <= BLOCK):
                size += len(parts[end])
                end += 1
            for i, ids in zip(owner[begin:end], self._plain(parts[begin:end]), strict=True):
                found[i].append(ids)
            begin = end
        none = np.zeros(0, np.uint32)
        return [self._by_runs(t) if any(x is None for x in own) else np.concatenate([none, *own]) for t, own in zip(texts, found, strict=True)]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for each worker process, which keeps it from task to task."""
    return WordIds(path)
