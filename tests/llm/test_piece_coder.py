"""Piece coding against the sentencepiece library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from spanloom.llm import piece_coder

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "", " ", "  a  b\n c\t d ", "Hello\xa0wörld ﬁ ① 　x", "abc</s><s><unk>", "a\x00b", "é é", "﻿x", "▁x ▁▁y", "<0x41>", "\n", "日本語テキスト🙂🙂👩‍👩‍👧", " " * 50 + "x" + " " * 33,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "abababababab" * 300, "=" * 1000, "x" * 5000, "\r\n\x0b\x1c", "1234567890 12", "नमस्ते дом", "http://a.b/c?d=e&f", "-" * 77 + " " + "_" * 31, "the " * 3000,
]


def same(texts):
    m = piece_coder.model(PATH)
    for t, ids in zip(texts, m.encode([t.encode() for t in texts]), strict=True):
        want = SP.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t[:80])
        assert m.decode(ids) == SP.decode(want), repr(t[:80])


def test_texts():
    same(TEXTS)


@pytest.mark.parametrize("seed", range(6))
def test_random(seed):
    rng = np.random.default_rng(seed)
    alphabet = [list("ab "), list("aein tsr▁"), list("<>/=- \n."), list("éèçà ouí"), [chr(c) for c in range(32, 1200)], list("01x ﬁ日本🙂")][seed]
    same(["".join(rng.choice(alphabet, int(rng.integers(0, 200)))) for _ in range(300)])


def test_documents(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(TEXTS)] + [(99, None, "c", 1), (None, "x", "c", 1), (3, "again", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(e := SP.encode(t or "", add_bos=True, add_eos=True)), sha(np.array(e, "<u4").tobytes()), sha(SP.decode(e).encode())) for i, t, *_ in rows]
    assert sorted(map(tuple, piece_coder.digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    coded = piece_coder.encode_documents(docs, PATH)
    back = {r.doc_id: r.text for r in piece_coder.decode_documents(coded.filter("doc_id < 20"), PATH).collect() if r.doc_id != 3}
    assert all(back[i] == SP.decode(SP.encode(t)) for i, t, *_ in rows if i in back)
    assert piece_coder.digests(docs.limit(0), PATH).collect() == []
