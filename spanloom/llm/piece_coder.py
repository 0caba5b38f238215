"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of such a model spans a space that follows another character, so a text
falls into independent words: a run of spaces with the characters up to the next
space. Distinct words of a batch are merged together in flat numpy arrays:

- each symbol holds a piece id; the rank of every adjacent pair is looked up in
  a sorted table of all splits of all pieces;
- a segmented minimum gives each word its best pair, and the leftmost
  non-overlapping pairs of that rank merge at once;
- where a merge brings up a pair as good as itself or better, only the leftmost
  merge of that word is kept for the round, which is the library's order;
- the arrays are compacted and the rounds repeat until no pair remains.

Before the first round words are cut wherever two neighbouring characters stand
side by side in no piece: no merge can cross such a place, so long unbroken texts
(of scripts without spaces, say) fall into short segments that merge together.

Symbols that are no piece become their UTF-8 bytes. Decoding joins the pieces'
bytes by id, turns the space mark into a space and drops the one that encoding
put in front.

Defined results: null or empty text gives the begin and end ids alone and
decodes to the empty text; a very long text is encoded whole; rows with a null or repeated doc_id are encoded each;
an empty table gives an empty result; extra columns are not read; the mark
U+2581 in a text decodes to a space, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

MARK = "▁"
#: Cached words a worker process holds before it starts afresh.
CACHED_WORDS = 500_000
_BIG = np.int64(1) << 40
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """Tables of a BPE model with byte fallback, identity normalisation and a
    space put in front."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.known: dict[str, bytes] = {}
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        name = {i: sp.id_to_piece(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in name.values()):
            raise ValueError("a piece spans a space inside; words are not independent")
        byte = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([byte[f"<0x{b:02X}>"] for b in range(256)])
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = np.full(n, _BIG)
        self.rank[plain] = [order[sp.get_score(i)] for i in plain]
        # all splits of all pieces into two; a half may be a lone character that is no piece
        self.ids = {p: i for i, p in name.items()}
        self.symbols = dict(self.ids)
        pairs: dict[tuple[int, int], int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if all(len(x) == 1 or x in self.ids for x in (a, b)):
                    pairs[self.symbol(a), self.symbol(b)] = i
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[by], np.array(list(pairs.values()), np.int64)[by]
        self.pieces = n
        # characters that stand side by side in some piece
        self.bigrams = np.array(sorted({ord(a) << 32 | ord(b) for p in self.ids for a, b in zip(p, p[1:])}), np.int64)
        blank = {self.bos, self.eos}
        self.surface = [b"" if i in blank else bytes([int(np.flatnonzero(self.byte_ids == i)[0])]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.surface[sp.unk_id()] = " ⁇ ".encode()

    def symbol(self, char: str) -> int:
        """The id of a piece, or an own number beyond the pieces' for a character that is none."""
        return self.symbols[char] if char in self.symbols else (1 << 22) + ord(char)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; rank _BIG where it is no piece."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        piece = np.where(self.pair_keys[at] == keys, self.pair_ids[at], -1)
        return piece, np.where(piece >= 0, self.rank[piece], _BIG)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le"), "<u4").astype(np.int64)
        chars, inverse = np.unique(points, return_inverse=True)
        sym = np.array([self.symbol(chr(c)) for c in chars], np.int64)[inverse] if len(points) else points
        whole = np.repeat(np.arange(len(words)), [len(w) for w in words])
        beside = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.bigrams, beside), len(self.bigrams) - 1)
        cut = (self.bigrams[at] != beside) | (whole[:-1] != whole[1:])
        word = np.concatenate([[0], np.cumsum(cut)]) if len(points) else whole
        owner = whole[np.flatnonzero(np.diff(word, prepend=-1))]  # the word of each segment
        done_sym, done_word = [], []
        piece, rank = self._pairs(sym, word, np.full(len(sym), -1), np.full(len(sym), _BIG), np.ones(len(sym), bool))
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(starts, append=len(sym))
            live = np.repeat(best < _BIG, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, piece, rank = sym[live], word[live], piece[live], rank[live]
                size, best = size[best < _BIG], best[best < _BIG]
                if not len(sym):
                    break
            nth = np.repeat(np.arange(len(best)), size)
            hit = rank == best[nth]
            # leftmost in runs of overlapping pairs: every second one from the run's start
            index = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - begin) % 2 == 0
            new = self._apply(sym, word, piece, rank, hit)
            kept = nth[~np.append(False, hit[:-1])]
            worse = np.zeros(len(best), bool)
            worse[kept[new[4] & (new[3] <= best[kept])]] = True
            if worse.any():
                at = np.flatnonzero(hit)
                first = np.zeros(len(hit), bool)
                first[at[np.flatnonzero(np.diff(nth[at], prepend=-1))]] = True
                new = self._apply(sym, word, piece, rank, hit & (first | ~worse[nth]))
            sym, word, piece, rank = new[:4]
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return self._ids(sym[order], owner[word[order]], len(words))

    def _pairs(self, sym: np.ndarray, word: np.ndarray, piece: np.ndarray, rank: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """piece and rank of each symbol with the next of its word, renewed where asked."""
        at = np.flatnonzero(which[:-1])
        at, ends = at[word[at] == word[at + 1]], at[word[at] != word[at + 1]]
        piece[at], rank[at] = self.pair(sym[at], sym[at + 1])
        rank[ends], rank[-1:] = _BIG, _BIG
        return piece, rank

    def _apply(self, sym: np.ndarray, word: np.ndarray, piece: np.ndarray, rank: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Merge at hit: symbols, words, pairs and ranks, and which pairs are new."""
        keep = ~np.append(False, hit[:-1])
        merged = hit[keep]
        sym, word = np.where(hit, piece, sym)[keep], word[keep]
        new = merged | np.append(merged[1:], False)
        return sym, word, *self._pairs(sym, word, piece[keep], rank[keep], new), new

    def _ids(self, sym: np.ndarray, word: np.ndarray, count: int) -> list[bytes]:
        odd = np.flatnonzero(sym >= self.pieces)
        if len(odd):
            spelled = [self.byte_ids[list(chr(int(s) - (1 << 22)).encode())] for s in sym[odd]]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(x) for x in spelled]
            at = np.cumsum(width) - width
            sym, word = np.repeat(sym, width), np.repeat(word, width)
            for i, x in zip(at[odd], spelled, strict=True):
                sym[i : i + len(x)] = x
        data, ends = sym.astype("<u4").tobytes(), 4 * np.searchsorted(word, np.arange(count + 1))
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids with begin and end of each UTF-8 text."""
        split = [_WORDS.findall(MARK + t.decode().replace(" ", MARK)) if t else [] for t in texts]
        fresh = list({w for ws in split for w in ws} - self.known.keys())
        if len(self.known) + len(fresh) > CACHED_WORDS:
            self.known.clear()
            fresh = list({w for ws in split for w in ws})
        for at in range(0, len(fresh), 65536):
            part = fresh[at : at + 65536]
            self.known.update(zip(part, self.merge(part), strict=True))
        a, b = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        return [a + b"".join(map(self.known.__getitem__, ws)) + b for ws in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that encoding puts in front."""
        listed = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.surface.__getitem__, listed))
        lead = next((self.surface[i] for i in listed if i not in (self.bos, self.eos)), b"")
        return raw[lead.startswith(b" ") :].decode(errors="replace")


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers) and n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            ids = model(path).encode(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids, as encode_documents gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model(path).decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and the digests of both, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in blocks(batches, "text", 4 << 20):
            m = model(path)
            ids = m.encode(utf8(batch.column("text")))
            back = [sha(m.decode(x).encode()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
