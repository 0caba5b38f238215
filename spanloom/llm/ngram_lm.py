"""Interpolated modified Kneser-Ney bigram model, counted and queried in Spark.

Blocks of documents (some MB of text) are the unit of work:

1. A block numbers its distinct words in the order of their 64-bit hashes and
   keeps its tokens as word numbers. Blocks are staged once, bucketed, so that
   answers are joined to them without moving them.
2. Blocks send their sorted distinct pair hashes with training counts to the
   shards of the hash space: packed, and once a block, not once an occurrence.
   A shard merges them into sorted hash arrays, kept in a memory map (memfd: on
   a cluster no machine-local folder may be used), and answers each block with
   the counts of its pairs; one block a pair is told that it speaks for it.
   Shards grow in number with the input, so one shard's arrays stay bounded; no
   process holds the whole model and nothing that grows is broadcast.
3. For the pairs it speaks for, a block adds up context statistics (per first
   word: total and types seen once, twice, more) and continuation counts (per
   second word), and sends them with its word counts to the word shards, which
   merge, map and answer in the same way. A frequent word is one entry a block.
4. Counts of counts, eight numbers, give the discounts.
5. Each block scores its documents from its tokens and the answers.

P(w|h) = max(c(hw) - D(c), 0)/c(h) + g(h) P(w) with three discounts from
n1..n4; P(w) likewise over continuation counts, interpolated with 1/(V+1),
which is also what unseen words draw on. An unseen h leaves P(w). Texts begin
after the context <begin> and end with one end token.

Defined results: a null or empty text is its end token alone; held out is
crc32(doc_id as text) mod folds = 0, and a null doc_id counts as the empty text;
repeated rows count and score each; without training rows N and V are 0 and
every probability is the uniform 1/(V+1); an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import mmap
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bucketed, partitions, stage, utf8

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Text bytes a block holds at most (or one document).
BLOCK_BYTES = 6 << 20
#: Keys that one shard should receive.
SHARD_KEYS = 2_000_000
_END, _BEGIN = b"\n", b"\n\n"  # no word holds white space
_BLOCKS = "block long, tokens long, words long, hashes binary, stream binary, docs binary"
_MESSAGES = "shard int, block long, n long, keys binary, data binary"
_ANSWERS = "block long, shard int, n long, data binary, sums array<long>"


def planes(a: np.ndarray) -> bytes:
    """32-bit integers, byte plane by byte plane, deflated."""
    return zlib.compress(np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit hashes: gaps in as few whole bytes as the widest needs."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, :width] = raw
    return np.cumsum(gaps.view(np.uint64).ravel(), dtype=np.uint64)


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a word pair from the hashes of its words."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split() + [_END]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in blocks(batches, "text", BLOCK_BYTES):
        known = {_BEGIN: 0}
        parts = [np.fromiter((known.setdefault(w, len(known)) for w in _tokens(t)), np.int64) for t in utf8(batch.column("text"))]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in known), np.uint64, len(known))
        sorted_hashes, at = np.unique(hashes, return_inverse=True)
        stream = at[np.concatenate(parts)]
        sink = pa.BufferOutputStream()
        docs = pa.record_batch({"doc_id": batch.column("doc_id"), "length": pa.array([len(p) for p in parts], pa.int64())})
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_batch(docs)
        row = [(part << 32) | number, len(stream), len(sorted_hashes), pack_keys(sorted_hashes), planes(stream), sink.getvalue().to_pybytes()]
        number += 1
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [x.split()[0] for x in _BLOCKS.split(", ")])


class _Block:
    """A staged block, unpacked."""

    def __init__(self, row: dict, folds: int) -> None:
        self.block, self.hashes, self.stream = row["block"], unpack_keys(row["hashes"]), unplanes(row["stream"])
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        self.ids, self.lengths = docs.column("doc_id"), docs.column("length").to_numpy()
        self.held = np.array([zlib.crc32(str("" if i is None else i).encode()) % folds == 0 for i in self.ids.to_pylist()], bool)
        self.train = np.repeat(~self.held, self.lengths).astype(np.int64)
        begin = np.searchsorted(self.hashes, np.uint64(xxhash.xxh64_intdigest(_BEGIN, 7)))
        left = np.concatenate([[begin], self.stream[:-1]])
        left[np.cumsum(self.lengths) - self.lengths] = begin
        codes, inverse = np.unique(left << 32 | self.stream, return_inverse=True)
        # sorted distinct pair hashes, the words of each, and which of them each token is
        self.pairs, first, at = np.unique(mix(self.hashes[codes >> 32], self.hashes[codes & 0xFFFFFFFF]), return_index=True, return_inverse=True)
        self.left, self.right, self.pair_of = codes[first] >> 32, codes[first] & 0xFFFFFFFF, at[inverse]


def _shares(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """Each shard's share of sorted hashes: shard, from, to."""
    limits = (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)
    cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
    return ((s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b)


def _message_batch(block: int, keys: np.ndarray, data: np.ndarray, shards: int) -> pa.RecordBatch:
    rows = [(s, block, b - a, pack_keys(keys[a:b]), planes(data[..., a:b])) for s, a, b in _shares(keys, shards)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _MESSAGES.split(", ")])


def _send_pairs(shards: int, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, folds)
                seen = np.bincount(b.pair_of, weights=b.train, minlength=len(b.pairs)).astype(np.int64)
                yield _message_batch(b.block, b.pairs, seen, shards)

    return run


def _mapped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hash array and its values in a memory-mapped file without a name."""
    fd = os.memfd_create("hash-arrays")
    os.truncate(fd, max(1, keys.nbytes + values.nbytes))
    view = mmap.mmap(fd, max(1, keys.nbytes + values.nbytes))
    os.close(fd)
    view[: keys.nbytes], view[keys.nbytes : keys.nbytes + values.nbytes] = keys.tobytes(), values.tobytes()
    return np.frombuffer(view, np.uint64, len(keys)), np.frombuffer(view, np.int64, values.size, keys.nbytes).reshape(values.shape)


def _merge(messages: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Sum the messages of a shard: mapped keys and values (width x keys), each
    message's keys, and where each key came first."""
    lists = [unpack_keys(k) for k in messages["keys"]]
    every = np.concatenate(lists)
    data = np.concatenate([unplanes(d).reshape(width, -1) for d in messages["data"]], axis=1)
    keys, first, at = np.unique(every, return_index=True, return_inverse=True)
    total = np.stack([np.bincount(at, weights=row, minlength=len(keys)).astype(np.int64) for row in data])
    speaks = np.zeros(len(every), bool)
    speaks[first] = True
    return *_mapped(keys, total), lists, speaks


def _count_pairs(messages: pd.DataFrame) -> pd.DataFrame:
    """A pair shard: counts of each block's pairs, twice the count plus one for
    the block that speaks for the pair; sums holds n1..n4, on the first row."""
    keys, (total,), lists, speaks = _merge(messages, 1)
    sums, at, out = [int((total == k).sum()) for k in (1, 2, 3, 4)], 0, []
    for x in lists:
        out.append(planes(2 * total[np.searchsorted(keys, x)] + speaks[at : at + len(x)]))
        at += len(x)
    return messages[["block", "shard", "n"]].assign(data=out, sums=[sums] + [None] * (len(lists) - 1))


def _gather(answers: list[dict], width: int) -> np.ndarray:
    """A block's answers, put together in the order of its sorted hashes."""
    ordered = sorted(answers, key=lambda a: a["shard"])
    return np.concatenate([unplanes(a["data"]).reshape(width, -1) for a in ordered], axis=1)


def _send_words(shards: int, folds: int):
    """Per word: occurrences, context total, types after it seen once, twice and
    more, continuations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, n = _Block(row, folds), row["words"]
                (told,) = _gather(row["pair_answers"], 1)
                mine = (told & 1 == 1) & (told > 1)
                c, left, right = told[mine] >> 1, b.left[mine], b.right[mine]
                kinds = [np.bincount(left[k], minlength=n) for k in (c == 1, c == 2, c > 2)]
                data = [np.bincount(b.stream, weights=b.train, minlength=n), np.bincount(left, weights=c, minlength=n), *kinds, np.bincount(right, minlength=n)]
                yield _message_batch(b.block, b.hashes, np.stack(data).astype(np.int64), shards)

    return run


def _count_words(messages: pd.DataFrame) -> pd.DataFrame:
    """A word shard: the summed statistics of each block's words; sums holds N, V,
    the continuations in all, the words that have any, and n1..n4, on the first row."""
    keys, total, lists, _ = _merge(messages, 6)
    seen, cont = total[0], total[5]
    sums = [int(seen.sum()), int((seen > 0).sum()), int(cont.sum()), int((cont > 0).sum()), *(int((cont == k).sum()) for k in (1, 2, 3, 4))]
    out = [planes(total[:, np.searchsorted(keys, x)]) for x in lists]
    return messages[["block", "shard", "n"]].assign(data=out, sums=[sums] + [None] * (len(lists) - 1))


def discounts(n: list[int]) -> np.ndarray:
    """D0..D3 of modified Kneser-Ney from n1..n4, each within 0 and its count;
    half the count where a count of counts is zero."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2 for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))])


def _score(pair_n: list[int], totals: list[int], folds: int):
    big_n, big_v, continuations, types, *word_n = totals
    d_pair, d_word = discounts(pair_n), discounts(word_n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, folds)
                (told,) = _gather(row["pair_answers"], 1)
                seen, total, one, two, more, cont = _gather(row["word_answers"], 6)
                left_over = d_word[1] * word_n[0] + d_word[2] * word_n[1] + d_word[3] * (types - word_n[0] - word_n[1])
                uniform = 1.0 / (big_v + 1)
                lower = (np.maximum(cont - d_word[np.minimum(cont, 3)], 0) + left_over * uniform) / continuations if continuations else np.full(len(cont), uniform)
                weight = np.where(total > 0, (d_pair[1] * one + d_pair[2] * two + d_pair[3] * more) / np.maximum(total, 1), 1.0)
                c = told >> 1
                p = np.maximum(c - d_pair[np.minimum(c, 3)], 0) / np.maximum(total[b.left], 1) + weight[b.left] * lower[b.right]
                base = np.log10((seen + 0.1) / (big_n + 0.1 * (big_v + 1)))
                starts, fields = np.cumsum(b.lengths) - b.lengths, [base[b.stream], np.log10(p)[b.pair_of], (seen > 0).astype(np.int64)[b.stream]]
                base_score, score, known = (np.add.reduceat(x, starts) for x in fields)
                arrays = [b.ids.combine_chunks(), pa.array(b.held), pa.array(b.lengths), pa.array(known), pa.array(np.full(len(known), big_n)), pa.array(base_score), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _SCORES.split(", ")])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 10) -> DataFrame:
    """One row per input row: learn from the documents not held out, score all.
    perplexity of a text is 10 ** (-score / n_tokens)."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    staged = bucketed(chosen.mapInArrow(_blocks, _BLOCKS), "lm", "block")
    size = staged.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    pair_shards = max(partitions(spark), size["tokens"] // SHARD_KEYS + 1)
    word_shards = max(partitions(spark), 3 * size["words"] // SHARD_KEYS + 1)

    def answered(messages: DataFrame, answer, label: str) -> tuple[DataFrame, list[list[int]]]:
        rows = stage(messages.groupBy("shard").applyInPandas(answer, _ANSWERS), label)
        width = len(rows.filter("sums is not null").select("sums").limit(1).collect()[0][0]) if size["tokens"] else 8
        sums = rows.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(width)]).first()
        per_block = rows.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias(f"{label}_answers"))
        return per_block.hint("shuffle_hash"), list(sums)

    pairs, pair_n = answered(staged.mapInArrow(_send_pairs(pair_shards, folds), _MESSAGES), _count_pairs, "pair")
    with_pairs = staged.join(pairs, "block")
    words, totals = answered(with_pairs.mapInArrow(_send_words(word_shards, folds), _MESSAGES), _count_words, "word")
    return with_pairs.join(words, "block").mapInArrow(_score(pair_n, totals, folds), _SCORES)
