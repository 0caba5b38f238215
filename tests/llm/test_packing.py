"""Packing: ids against the whole-text tokenizer, places against sequential best fit."""

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequential(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        opened += at >= len(gaps) + (gap != capacity) and gap == capacity
        insort(gaps, gap - n)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_supersteps_equal_sequential_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 90))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 400)))
    if seed % 2:
        lengths = np.minimum(lengths, rng.integers(1, 6, len(lengths)))
    counts = Counter(lengths.tolist())
    plan = packing.supersteps(counts, capacity)
    used = Counter()
    for i, (length, rank, first, fit, _) in enumerate(plan):
        after = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for r in range(after - rank):
            used[first + r // fit] += length
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= capacity
    assert sorted(capacity - u for u in used.values()) == sequential(lengths.tolist(), capacity)


def test_documents(spark):
    texts = [None, "", "Hello  wörld, it's A test!", "x" * 9000, "Ünï code 　space a\x1cb Σας İ", "é ́x <|endoftext|> end", "word " * 9000, "5 12 ab1c", "same", "same", "ẛ̣ ﬁ"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, "again", "y", 2), (None, "no id", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, length int")
    got = packing.place_documents(docs, PATH).collect()
    tok, capacity = Tokenizer.from_file(PATH), 4096
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(at) == len(sequential([w[3] for w in want], capacity))
    seqs = packing.sequences(docs, PATH).collect()
    assert sum(len(s.ids) for s in seqs) == sum(w[3] for w in want) and len(seqs) == len(at)
    assert packing.place_documents(docs.limit(0), PATH).collect() == []


def test_chunks_of_letters_and_marks():
    rng = np.random.default_rng(2)
    letters = list("abcdefgh'ÀÖ×ß÷ÿéÉÜñSs.,!µ0")
    texts = [" ".join("".join(rng.choice(letters, int(rng.integers(1, 9)))) for _ in range(40)) for _ in range(200)]
    tok = Tokenizer.from_file(PATH)
    texts += ["it's we'll x-y_z ''' 's", "<|ENDOFTEXT|> <|endoftext|>x", "İ ſ ǅ K K", "a\x1cb\x85c d", "ﬁ́ 日本 語"]
    coder = packing.WordCoder(PATH)
    assert coder.direct
    coder.known.update({f"filler {i}": b"" for i in range(packing.CACHED_WORDS - 50)})  # the cache starts afresh on the way
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at : at + 50], coder.encode(pa.array(texts[at : at + 50]), 1), strict=True):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids + [1], t
    coder.direct = False  # any other tokeniser sees whole chunks
    assert [x.tolist() for x in coder.encode(pa.array(texts), 1)] == [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    with pytest.raises(ValueError, match="cross white space"):
        packing.WordCoder(public_tokenizers.path("byte_bpe_50k.json"))
