"""Best-fit packing by sums of squares against a naive packer and the tokenizer."""

from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from spanforge.llm import sum_of_squares, word_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(sum_of_squares.VOCABULARY)


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_by_tokenizer(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize(
    "text",
    ["it's 'the 'S don''t 's's 're'll", "“curly” ’s İstanbul ǰ J̌ Å", "x" * 3000, "12 34²½ 5a6b7", "<|endoftext|>hi<|startoftext|>", "<|ENDOFTEXT|> <|", "a\x00b\x1cc\x85d\xa0e\x7f", "ß ẞ ÄÖÜ straße's Ångström", "中文 text", "", "  \n ", " '", "''s", "a'b'c 'd 'll", "!!!...,,,'s 't", "ŉ ſ 's", "  's  't\t'm \n'd", "\x0b\x0ca", "12's 12 ''t a 'b"],
)
def test_ids_equal_the_tokenizer(text):
    ids = word_ids.word_ids(vocabulary())
    want = ids_by_tokenizer(text)[:-1]
    assert [x.tolist() for x in ids.many([text, "between", text])] == [want, ids_by_tokenizer("between")[:-1], want]


def test_ids_of_a_long_text(monkeypatch):
    monkeypatch.setattr(word_ids, "BLOCK", 64)
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefgé'.,1") for _ in range(r.randint(1, 12))) for _ in range(20_000))
    assert word_ids.WordIds(vocabulary()).many([text])[0].tolist() == ids_by_tokenizer(text)[:-1]


def naive(sizes, window):
    """Sequences as lists of sizes; the sum of squares is computed anew for every possible place."""
    sequences, placed = [], []
    for size in sizes:
        best = None
        gaps = sorted({window - sum(s) for s in sequences if size <= window - sum(s) < window})
        for gap in gaps:
            counts = defaultdict(int)
            for s in sequences:
                counts[window - sum(s)] += 1
            counts[gap] -= 1
            counts[gap - size] += 1
            total = sum(n * n for g, n in counts.items() if 0 < g < window)
            if best is None or total < best[0]:
                best = total, gap
        if best is None:
            sequences.append([size])
        else:
            next(s for s in sequences if window - sum(s) == best[1]).append(size)
        placed.append(best[1] if best else window)
    return sequences, placed


@pytest.mark.parametrize("seed", range(6))
def test_places_equal_a_naive_packer(seed):
    r = random.Random(seed)
    window = r.choice([8, 20, 64])
    sizes = [r.randint(1, window) for _ in range(150)]
    if seed % 2:
        sizes.sort(reverse=True)
    packed = sum_of_squares.Sequences(window)
    places = [packed.place(s) for s in sizes]
    sequences, gaps = naive(sizes, window)
    assert [window - at for _, at in places] == gaps
    assert packed.next == len(sequences)


def assert_packed(rows, docs, window, text_ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= window
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = text_ids(text)
        for k, at in enumerate(range(0, len(ids), window)):
            part = ids[at : at + window]
            want[doc_id].append((k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) for d, own in by_doc.items()}
    assert got == {d: sorted(x) for d, x in want.items()}
    return len(by_sequence)


def test_awkward_rows(spark, stored):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "same text", "en", "a", 9), (3, "same text", "en", "a", 9), (None, "no id here", "en", "b", 10), (8, "Ünï çödé 😀 text", "fr", "b", 15), (9, "word " * 5000, "en", "a", 25000)]
    docs = stored([(*r, 1, 2, 3) for r in rows], DOCS + ", piece int, row long, sequence_id long", 3)
    got = sum_of_squares.pack(docs, window=64).collect()
    assert_packed(got, [r[:2] for r in rows], 64, ids_by_tokenizer)
    assert sum_of_squares.pack(stored([], DOCS, 1)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("partition_tokens", [1 << 24, 1 << 15])
def test_few_sequences(spark, partition_tokens):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sum_of_squares.pack(docs, partition_tokens=partition_tokens).collect()
    used = assert_packed(got, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2048, ids_by_tokenizer)
    tokens = sum(r.length for r in got)
    parts = len({r.sequence_id >> 40 for r in got})
    assert used <= -(-tokens // 2048) + parts


def test_a_very_long_text(spark, stored):
    rows = [(1, "some words, and 12 more. " * 200_000, "en", "a", 0)]
    got = sum_of_squares.pack(stored(rows, DOCS, 1)).collect()
    assert sum(r.length for r in got) == sum(r.length for r in got if r.length == 2048) + min(r.length for r in got)
    assert len(got) == max(r.piece for r in got) + 1
