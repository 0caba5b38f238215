"""Curve packing: ids against the whole-text tokenizer, places, padding and neighbourhood."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanloom.llm import curve_packing as cp

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, row int, key int, x string"


def test_chunks_as_whole_texts():
    rng = np.random.default_rng(1)
    letters = list("abcdefgh'ÀÖß éÉ  \n\t .,!0 日  \x1c\x85​")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice(letters, int(rng.integers(1, 7)))) for _ in range(20)) for _ in range(1000)]
    texts += [" ".join("".join(rng.choice(list("abé'.,-!5日\n"), int(rng.integers(1, 9)))) for _ in range(20)) for _ in range(1000)]
    texts += [None, "", " ", "  a", "a  ", "it's we'll 's <|endoftext|> x<|endoftext|> <|endoftext|>", "a ́b", "x \U0001f600 y", "word " * 5000, "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace")]
    tok, coder = Tokenizer.from_file(PATH), cp.ChunkCoder(PATH)
    for at in range(0, len(texts), 500):
        for t, ids in zip(texts[at : at + 500], coder.encode(pa.array(texts[at : at + 500], pa.string()), 0), strict=True):
            assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids + [0], repr(t)


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_hilbert_is_a_curve(bits):
    n = 1 << bits
    cells = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])
    key = cp.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(n**3))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()  # each step goes to a neighbouring cell


@pytest.mark.parametrize("seed", range(6))
def test_cut(seed):
    rng = np.random.default_rng(seed)
    capacity = 16
    docs = [(k, np.arange(int(rng.integers(1, 60)), dtype="<u4").tobytes()) for k in range(int(rng.integers(0, 30)))]
    got = list(cp.cut(iter(docs), capacity))
    for k, ids in docs:
        mine = [p for p in got if p[0] == k]
        assert b"".join(p[2] for p in mine) == ids and {p[3] for p in mine} == {len(ids) // 4}
        assert [p[1] for p in mine] == np.cumsum([0] + [len(p[2]) // 4 for p in mine])[:-1].tolist()
    at = {}
    for p in got:
        at.setdefault(p[4], []).append((p[5], len(p[2]) // 4))
    sizes = []
    for parts in at.values():
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        sizes.append(sum(n for _, n in parts))
    total = sum(len(i) // 4 for _, i in docs)
    assert sizes == [capacity] * (total // capacity) + cp.powers(total % capacity)


def test_documents(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", "Hello  wörld, it's A test!", "x" * 9000, "word " * 9000, "same", "same"] + [" ".join(f"w{x}" for x in rng.integers(0, 90, int(rng.integers(1, 400)))) for _ in range(200)]
    rows = [(i, t, "a", 1, 2, "b") for i, t in enumerate(texts)] + [(3, "again", "a", 1, 2, "b"), (None, "no id", "a", 1, 2, "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = cp.place_documents(docs, PATH).collect()
    tok, pieces, at = Tokenizer.from_file(PATH), {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows]
    assert set(pieces) == {(i, len(ids)) for i, ids in want}
    for i, ids in want:
        end = 0
        for start, n, crc in sorted(pieces[i, len(ids)]):
            assert start == end and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            end += n
        assert end == len(ids)
    for parts in at.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 1024 and not end & (end - 1)  # full or a power of two: no padding
    seqs = cp.sequences(docs, PATH, pad_id=9).collect()
    assert sum(len(s.ids) for s in seqs) == sum(len(ids) for _, ids in want)
    assert cp.place_documents(docs.limit(0), PATH).collect() == []


def test_neighbours_share_topics(spark):
    """Documents of one topic stand together along the curve, far more than by chance."""
    rng = np.random.default_rng(5)
    topic = rng.permutation(np.repeat(np.arange(8), 60))
    docs = spark.createDataFrame([(i, " ".join(f"t{t}x{x}" for x in rng.integers(0, 30, 60)), "", 0, 0, "") for i, t in enumerate(topic)], SCHEMA)
    placed = cp.keyed(cp.tokens(docs, PATH)).orderBy("key").collect()
    same = np.mean([topic[a.doc_id] == topic[b.doc_id] for a, b in zip(placed, placed[1:])])
    assert same > 0.5  # 1 in 8 by chance


def test_copies_part_over_ranges(spark):
    docs = spark.createDataFrame([(1, "one text of many copies", "", 0, 0, "")] * 400, SCHEMA)
    got = cp.place_documents(docs, PATH).collect()
    assert len({r.sequence_id >> 40 for r in got}) == 4 and sum(r.length for r in got) == 400 * got[0].doc_tokens
