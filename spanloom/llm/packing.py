"""Best-fit packing of tokenised documents in supersteps over runs of equal length.

Spark tokenises, ranks and places; the supersteps themselves, which see lengths and
counts alone (at most `capacity` of them), run one after the other on the driver.

1. Tokenise: each task cuts its texts at ASCII white space, tokenises each
   distinct chunk once and gathers the cached ids; the pre-tokeniser never lets a
   token cross white space, so the ids are those of the whole text. Documents
   above the capacity are cut into full pieces and a rest.
2. Sort: lengths are integers up to the capacity, so sorted documents are runs
   of equal lengths. Rank within a run comes from counts per (task, length) and
   their prefix sums; no window ever holds the rows of a hot length.
3. Supersteps, longest run first: all documents of one length are matched at
   once to their successors, the smallest gaps that hold them; rank decides
   which document gets which gap, and a gap takes as many of the run as fit.
   The gaps are updated and the next run follows; where no gap is left, new
   sequences open. Documents and gaps take part as runs (first rank, count), so
   the state of the sweep is bounded by the capacity, whatever the input: it
   opens at most 3 runs of gaps a superstep, and each use of a run more than
   halves its gap. The result is that of sequential best-fit decreasing.
4. The matched rank ranges (bounded as above) are broadcast, and each piece
   looks up its sequence and offset.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; rows with a null doc_id are packed too; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, stage

#: Cached words a worker process holds before it starts afresh.
CACHED_WORDS = 300_000
#: Text bytes that are tokenised at once (or one document).
BLOCK_BYTES = 4 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"
#: Letters of Latin-1 and marks of ASCII but the apostrophe: in a chunk of the one
#: and then the other the pre-tokeniser parts the two, and normalising only
#: lower-cases the letters.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
_ODD = "Straße, l'été… 3.14 (Ünï-cødé) ABC##x 日本語 it's e\u0301!"


@cache
def _byte_letters() -> dict[int, str]:
    """The characters that byte-level models write for bytes, by the public rule:
    printable Latin-1 stands for itself, the rest counts up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordCoder:
    """Ids of white-space separated chunks. Words of letters, the bulk, go to the
    model itself and marks after them to a small cache; every other chunk takes
    the whole tokeniser. A tokeniser that treats words otherwise is told at the
    start and then sees every chunk whole; one that lets tokens cross white space
    is refused."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        probe = _ODD.split()
        if self._whole([_ODD])[0] != b"".join(self._whole(probe)):
            raise ValueError("this tokeniser lets tokens cross white space")
        self.direct = all(self._letters(w) == self._whole([w])[0] and self._whole([w + "##."])[0] == self._whole([w])[0] + self._whole(["##."])[0] for w in ("packing", "straße", "été"))

    def _whole(self, chunks: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in coded]

    def _letters(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(_byte_letters().__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _table(self, units: pa.Array, code) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has; code makes those not known."""
        listed, known = units.to_pylist(), self.known
        if len(known) + len(listed) > CACHED_WORDS:
            known.clear()
            known[""] = b""
        fresh = [u for u in listed if u not in known]
        known.update(zip(fresh, code(fresh), strict=True))
        ids = list(map(known.__getitem__, listed))
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int32, len(ids)) >> 2

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks in a row, and how many each has."""
        marks, words = pc.utf8_ltrim(chunks, _LETTERS), pc.utf8_rtrim(chunks, _MARKS)
        whole, after, before = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (chunks, marks, words))
        plain = (after + before == whole) & (before > 0) & self.direct
        words = pc.utf8_lower(words.filter(pa.array(plain))).dictionary_encode()
        marks = marks.filter(pa.array(plain)).dictionary_encode()
        parts = [self._table(words.dictionary, lambda x: map(self._letters, x)), self._table(marks.dictionary, self._whole), self._table(chunks.filter(pa.array(~plain)), self._whole)]
        # two units a chunk: a word or an odd chunk, then its marks or nothing (the unit after all others)
        n_words, n_marks, n_odd = (len(size) for _, size in parts)
        table, size = (np.concatenate([*x, y]) for x, y in zip(zip(*parts, strict=True), (np.empty(0, "<u4"), [0]), strict=True))
        unit = np.full((len(chunks), 2), len(size) - 1)
        unit[plain, 0], unit[plain, 1] = words.indices.to_numpy(), n_words + marks.indices.to_numpy()
        unit[~plain, 0] = n_words + n_marks + np.arange(n_odd)
        return gather(table, size, unit.ravel()), size[unit].sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id. Null counts as empty."""
        chunks = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = chunks.flatten().dictionary_encode()
        table, size = self._distinct(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        stream, ends = gather(table, size, word), np.concatenate([[0], np.cumsum(size[word])])
        cuts = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        return [np.append(stream[a:b], np.uint32(end_id)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def gather(table: np.ndarray, size: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The stretches of the table that the units have, in their order; sizes are
    those of the stretches, which stand one after another."""
    starts, taken = np.cumsum(size) - size, size[units]
    ends = np.cumsum(taken)
    return table[np.arange(ends[-1]) + np.repeat(starts[units] - ends + taken, taken)] if len(units) else table[:0]


@cache
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece, staged: its place in the document, its checksum, the
    task (chunk) it came from and how many of its length that task had before
    (nth); with_ids adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            rows: list[tuple] = []
            coded = _coder(tokenizer).encode(batch.column("text"), end_id)
            for key, ids in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].tobytes()
                    n = len(part) // 4
                    rows.append((key, k, at, n, zlib.crc32(part), chunk, int(seen[n]), *[part] * with_ids))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return stage(chosen.mapInArrow(cut, _PIECES + ", ids binary" * with_ids), "pieces")


def supersteps(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit over runs. counts: documents by length. Returns rows of
    (length, first rank, first sequence, documents a gap, tokens in it before)."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, count)
    sizes: list[int] = []
    opened, plan = 0, []

    def leave(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, count = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                size, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            fit = size // length
            full = min(count, left // fit)
            some = min(left - full * fit, fit - 1) if full < count else 0
            plan.append((length, rank, first, fit, capacity - size))
            leave(size - fit * length, first, full)
            if some:
                leave(size - some * length, first + full, 1)
            leave(size, first + full + bool(some), count - full - bool(some))
            rank += full * fit + some
            left -= full * fit + some
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to the rows of pieces()."""
    spark = parts.sparkSession
    by_task = parts.groupBy("chunk", "length").count()
    lengths = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(supersteps(lengths, capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("chunk", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    ranked = parts.join(offsets, ["chunk", "length"]).withColumn("rank", F.col("nth") + F.col("ahead")).drop("nth", "ahead", "chunk")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, first, fit, used = plan.value.T
        order = np.lexsort((rank, length))
        keys = (length[order] << 48) | rank[order]
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = order[np.searchsorted(keys, (n << 48) | r, side="right") - 1] if len(n) else np.empty(0, np.int64)
            nth = r - rank[row]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["rank"]).columns, pa.array(first[row] + nth // fit[row]), pa.array(used[row] + nth % fit[row] * n)], [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def place_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece with its sequence and offset."""
    placed = pack(pieces(docs, tokenizer, capacity, end_id), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """sequence_id, ids (array of int) and doc_ids: the packed training rows."""
    placed = pack(pieces(docs, tokenizer, capacity, end_id, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))  # a sequence holds at most `capacity` tokens

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").astype(np.int32) for ps in batch.column("parts").to_pylist()]
            docs_in = [[p["doc_id"] for p in ps] for ps in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(docs_in, pa.list_(pa.int64()))], ["sequence_id", "ids", "doc_ids"])

    return placed.groupBy("sequence_id").agg(parts.alias("parts")).mapInArrow(join, "sequence_id long, ids array<int>, doc_ids array<long>")
