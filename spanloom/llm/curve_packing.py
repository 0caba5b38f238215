"""Packing along a space-filling curve: neighbours in content share sequences.

1. Tokenise: texts are cut before a space and around a line feed that stand between
   two characters that are not white space, and between a letter and a mark; there
   the pre-tokeniser always starts a token, so each distinct chunk is tokenised
   once and the ids are those of the whole text.
2. Project: token ids are hashed into buckets, square roots of their counts make a
   document's vector of length one, and fixed random signs bring it to three
   dimensions. Mean and deviation over all documents spread each dimension over
   the curve's cells (through the logistic curve, so that outliers stay apart).
3. Sort by range of (Hilbert key, doc_id, row): the row's own number parts a group
   of copies over as many ranges as its size asks for.
4. Each range is packed as it streams by: documents follow each other and are cut
   at every full sequence. What is left at the end of a range is cut into powers
   of two, which need no padding: ten short sequences a range at most, and no
   padding at all. Only the open sequence is held.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; rows with a null doc_id are packed too; a document of any length is
cut over as many sequences as it takes; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, partitions, stage
from .packing import gather

#: Distinct chunks in each of the two generations that a worker process holds: when
#: one is full it becomes the older, and what is met again moves to the newer.
CACHED_CHUNKS = 400_000
#: Text bytes that are tokenised at once (or one document).
BLOCK_BYTES = 4 << 20
#: Dimensions and bits of the curve, and buckets that token ids are hashed into.
DIMS, BITS, BUCKETS = 3, 16, 1024
#: The pre-tokeniser's white space.
_WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What stands where a text is cut. A text that has it, an added token, or a space
#: or line feed at an end or beside other white space, is tokenised whole.
_CUT = "\0"
_UNEVEN = f"\\x00|^[ \\n]|[ \\n]$|{_WHITE}[ \\n]|[ \\n]{_WHITE}"
#: A letter of Latin-1 and a mark or digit of ASCII behind it.
_PAIR = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~0-9])"
#: A chunk with one space, in front, and no control or other white space.
_WORD = re.compile(r" [^\s\x00-\x20\x7f-\xa0]+\Z")
#: Chunks that are tokenised as one text.
TOGETHER = 1000
_ODD = "It's  3.14 (Ünï-cødé)\n ABC##x 日本語 a b  c é! \t x"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def chunks_of(texts: pa.Array) -> pa.Array:
    """Lists of chunks of texts that are not uneven."""
    for a, b in ((" ", _CUT + " "), ("\n", _CUT + "\n" + _CUT)):
        texts = pc.replace_substring(texts, a, b)
    return pc.split_pattern(pc.replace_substring_regex(texts, _PAIR, rf"\1{_CUT}\2"), _CUT)


class ChunkCoder:
    """Ids of whole texts, each distinct chunk tokenised once. A tokeniser that
    reads chunks otherwise than the whole text is refused. Ids are held in two
    bytes where the vocabulary allows it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        #: which tokens begin with a space, as the byte-level vocabulary writes it
        self.begins = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.uneven = "|".join([_UNEVEN, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        if self._whole([_ODD])[0] != b"".join(self._whole(chunks_of(pa.array([_ODD]))[0].as_py())):
            raise ValueError("this tokeniser lets tokens cross from word to word")

    def _whole(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of chunks that have one space, in front: many are tokenised as one
        text, and parted again where a token begins with a space."""
        texts = ["".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        ids = np.frombuffer(b"".join(self._whole(texts)), f"<u{self.width}")
        starts = np.append(np.flatnonzero(self.begins[ids]), len(ids)).tolist()
        if len(starts) != len(words) + 1:
            raise ValueError("this tokeniser does not start a token at every space")
        whole, w = ids.tobytes(), self.width
        return [whole[a * w : b * w] for a, b in zip(starts, starts[1:])]

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        parts = chunks_of(texts)
        coded = parts.flatten().dictionary_encode()
        listed = coded.dictionary.to_pylist()
        if len(self.known) + len(listed) > CACHED_CHUNKS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        again = [c for c in listed if c not in known and c in before]
        known.update(zip(again, map(before.__getitem__, again), strict=True))
        fresh = [c for c in listed if c not in known]
        words = [c for c in fresh if _WORD.match(c)]
        known.update(zip(words, self._words(words), strict=True))
        others = [c for c in fresh if c not in known]
        known.update(zip(others, self._whole(others), strict=True))
        ids = list(map(known.__getitem__, listed))
        size, table = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width, np.frombuffer(b"".join(ids), f"<u{self.width}")
        units = coded.indices.to_numpy(zero_copy_only=False)
        stream, ends = gather(table, size, units), np.concatenate([[0], np.cumsum(size[units])])
        cuts = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return [stream[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id. Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        uneven = pc.match_substring_regex(texts, self.uneven)
        even, whole = self._even(texts.filter(pc.invert(uneven))), self._whole(texts.filter(uneven).to_pylist())
        end, sides = np.array([end_id], f"<u{self.width}"), {False: iter(even), True: (np.frombuffer(x, f"<u{self.width}") for x in whole)}
        return [np.concatenate([next(sides[u]), end]) for u in uneven.to_pylist()]


@cache
def _coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


@cache
def _signs() -> np.ndarray:
    return np.random.default_rng(20).choice([-1.0, 1.0], (BUCKETS, DIMS))


def project(coded: list[np.ndarray]) -> np.ndarray:
    """A point for each document, from the hashed counts of its ids."""
    out = np.empty((len(coded), DIMS))
    for k, ids in enumerate(coded):
        bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BUCKETS - 1).bit_length())
        weight = np.sqrt(np.bincount(bucket.astype(np.int64), minlength=BUCKETS))
        out[k] = weight @ _signs() / np.sqrt(len(ids))
    return out


def tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (bytes, `width` each) and the point x, y, z of each document, staged, with row, a number of its own."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            coded = _coder(tokenizer).encode(batch.column("text"), end_id)
            points = project(coded)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.tobytes() for c in coded], pa.binary()), *[pa.array(points[:, d]) for d in range(DIMS)]], ["doc_id", "ids", "x", "y", "z"])

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stage(chosen.mapInArrow(code, "doc_id long, ids binary, x double, y double, z double").withColumn("row", F.monotonically_increasing_id()), "tokens")


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points with integer coordinates (a row each)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):  # undo the turns of the sub-cubes, largest first
        for i in range(n):
            high, low = (x[i] & q) != 0, (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(high, q - 1, low)
            x[i] ^= np.where(high, 0, low)
    for i in range(1, n):  # Gray code over the dimensions
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keyed(coded: DataFrame) -> DataFrame:
    """doc_id, ids, row and key, the place of the document along the curve."""
    got = coded.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.avg, "mean"), (F.stddev_pop, "off"))]).first()  # one row
    middle, off = (np.array([got[f"{c}_{n}"] or 0.0 for c in "xyz"]) for n in ("mean", "off"))

    @F.pandas_udf("long")
    def key(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        spread = 1 / (1 + np.exp(-1.7 * (np.stack([x, y, z], axis=1) - middle) / np.where(off > 0, off, 1)))
        return pd.Series(hilbert(np.minimum((spread * 2**BITS).astype(np.int64), 2**BITS - 1)))

    return coded.select("doc_id", "ids", "row", key("x", "y", "z").alias("key"))


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut(stream: Iterator[tuple[int | None, bytes]], capacity: int, width: int = 4) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of documents (doc_id,
    ids of `width` bytes each) in a row."""
    sequence, used, held = 0, 0, []
    for doc_id, ids in stream:
        n, at = len(ids) // width, 0
        while at < n:
            take = min(n - at, capacity - used)
            held.append((doc_id, at, ids[at * width : (at + take) * width], n, sequence, used))
            at, used = at + take, used + take
            if used == capacity:
                yield from held
                sequence, used, held = sequence + 1, 0, []
    edges, end = [], 0
    for size in powers(used):  # the open sequence, parted anew
        edges.append((end, end + size))
        end += size
    for doc_id, at, ids, n, _, offset in held:
        length = len(ids) // width
        for k, (a, b) in enumerate(edges):
            low, high = max(a, offset), min(b, offset + length)
            if low < high:
                yield doc_id, at + low - offset, ids[(low - offset) * width : (high - offset) * width], n, sequence + k, low - a


def pack(placed: DataFrame, width: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row a piece of keyed() documents, staged: ranges are drawn once, so that
    every reader sees the same sequences."""
    by = ["key", "doc_id", "row"]
    ordered = placed.repartitionByRange(partitions(placed.sparkSession), *by).sortWithinPartitions(*by).select("doc_id", "ids")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rows = TaskContext.get().partitionId() << 40, []
        stream = ((d, i.as_py()) for b in batches for d, i in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True))
        for doc_id, at, ids, n, sequence, offset in cut(stream, capacity, width):
            wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
            rows.append((doc_id, at, len(wide) // 4, zlib.crc32(wide), n, base + sequence, offset, *[wide] * with_ids))
            if len(rows) == 4096:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    names = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * with_ids
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)
    return stage(ordered.mapInArrow(lay, _PIECE + ", ids binary" * with_ids), "along")


def place_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return pack(keyed(tokens(docs, tokenizer, end_id)), _coder(tokenizer).width, capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, pad_id: int | None = None) -> DataFrame:
    """sequence_id, ids (array of int) and doc_ids: the packed training rows. With
    pad_id, a sequence whose length is no power of two would be padded to the
    capacity; none made here needs it."""
    pieces = pack(keyed(tokens(docs, tokenizer, end_id)), _coder(tokenizer).width, capacity, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # a sequence holds at most `capacity` tokens

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs_in = [], []
            for ps in batch.column("parts").to_pylist():
                row = np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype(np.int32)
                short = capacity - len(row) if pad_id is not None and len(row) & (len(row) - 1) else 0
                ids.append(np.append(row, np.full(short, pad_id, np.int32)) if short else row)
                docs_in.append([p["doc_id"] for p in ps])
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(docs_in, pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>")
