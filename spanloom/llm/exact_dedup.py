"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every row's text, without white space, gets a SHA-256; its first 48 bits are
   the fingerprint. The rows are staged once, bucketed by the partition (chunk)
   that read them, so the texts never move again unless they are suspects.
2. Chunks form units of about a million rows. A unit sends its distinct
   fingerprints, sorted and Golomb-Rice coded, to the owners of the fingerprint
   ranges: one message an owner. A fingerprint that a hot text repeats costs one
   entry a unit, however many copies the unit holds.
3. Owners decode, find the fingerprints that more than one unit sent, and reply
   with one bitmap a message. A unit puts its replies together to one bitmap a
   chunk and batch, joined to the staged rows on the bucketing column: of the
   rows themselves only fingerprints and places are shuffled.
4. Rows whose bit is set, or which repeat within their unit, are suspects. Only
   suspects are shuffled, grouped by the bytes of the normalised text; partial
   aggregation leaves one row a task for a hot text, and rows of hot texts meet
   their group by broadcast.

Defined results: null text is empty; all empty texts are one group; a very long
text is one row, hashed whole; of equal rows (same text and doc_id) exactly one
stays, the first staged; a null doc_id comes after all others in ties; an empty
table gives an empty result; columns beyond text and doc_id pass through
untouched whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, blocks, bucketed, hot_limit, join_hot, pack, partitions, stage, utf8

FP_BITS = 48
#: Distinct fingerprints that one owner should hold: 16 bytes each while it works.
FPS_PER_OWNER = 2_000_000
#: Rows that one unit should hold: 20 bytes each while it works.
UNIT_ROWS = 1_000_000


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers as Golomb-Rice codes of their gaps:
    one byte k, then the unary quotients, then the k-bit remainders."""
    gaps = np.diff(values, prepend=values.dtype.type(0)).astype(np.int64)
    k = max(0, int(np.log2(max(1.0, gaps.mean()))))
    unary = np.zeros(int((gaps >> k).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(data: bytes, n: int) -> np.ndarray:
    k, raw = data[0], np.frombuffer(data, np.uint8, offset=1)
    tail = (n * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << k
    if k:
        rest = np.unpackbits(raw[len(raw) - tail :])[: n * k].reshape(n, k).astype(np.int64)
        gaps += rest @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps)


def _sign(text_field: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        for run, batch in enumerate(batches):
            text = batch.column("row").field(text_field)
            slices = blocks(iter([pa.record_batch({"text": text})]), "text", 8 << 20)
            digests = [hashlib.sha256(x.translate(None, WHITE.encode())).digest() for part in slices for x in utf8(part.column("text"))]
            fp = np.frombuffer(b"".join(d[:6] + b"\0\0" for d in digests), "<u8").astype(np.int64)
            n = len(fp)
            chars = pc.fill_null(pc.utf8_length(text.cast(pa.large_string())), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.full(n, chunk, np.int32)), pa.array(np.full(n, run, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(fp), chars.cast(pa.int64()), pa.array([d.hex() for d in digests])],
                ["row", "chunk", "run", "pos", "fp", "chars", "sha"],
            )

    return sign


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    return (keys.astype(np.float64) * (owners / 2.0**FP_BITS)).astype(np.int64)


def _send(owners: int):
    """The distinct fingerprints of a unit, one message an owner."""

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(rows["fp"].to_numpy())
        whose = _owner(keys, owners)
        cuts = [0, *(np.flatnonzero(np.diff(whose)) + 1), len(keys)]
        shares = [keys[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"owner": [int(whose[a]) for a in cuts[:-1]], "unit": rows["unit"].iloc[0], "n": [len(x) for x in shares], "codes": [rice_encode(x) for x in shares]})

    return send


def _reply(messages: pd.DataFrame) -> pd.DataFrame:
    """One owner: a bit for each received fingerprint that another unit sent too."""
    lists = [rice_decode(c, n) for c, n in zip(messages["codes"], messages["n"], strict=True)]
    _, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    again, ends = (count > 1)[inverse], np.cumsum(messages["n"])
    return messages[["owner", "unit", "n"]].assign(bits=[np.packbits(again[b - n : b]).tobytes() for b, n in zip(ends, messages["n"], strict=True)])


def _flags(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """One unit: its replies, in the order of their ranges, as a bit a fingerprint;
    then for each chunk a bitmap a run, least significant bit first."""
    _, slot, count = np.unique(rows["fp"].to_numpy(), return_inverse=True, return_counts=True)
    ordered = replies.sort_values("owner")
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(ordered["bits"], ordered["n"], strict=True)])
    hits = rows[((count > 1) | (bits == 1))[slot]]
    out = []
    for chunk, held in hits.groupby("chunk"):
        maps: list[bytes] = [b""] * (int(held["run"].max()) + 1)
        for run, at in held.groupby("run")["pos"]:
            marks = np.zeros(int(at.max()) + 1, np.uint8)
            marks[at.to_numpy()] = 1
            maps[run] = np.packbits(marks, bitorder="little").tobytes()
        out.append((chunk, maps))
    return pd.DataFrame(out, columns=["chunk", "maps"])


def _flagged(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """The staged rows with `suspect` (another row may have the same text), and how
    many they are."""
    spark, packed = docs.sparkSession, pack(docs)
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL("chunk int, run int, pos int, fp long, chars long, sha string").fields])
    staged = bucketed(packed.mapInArrow(_sign(docs.columns.index(text)), schema), "dedup", "chunk", "run", "pos")
    total = staged.count()
    owners, units = (max(partitions(spark), total // n + 1) for n in (FPS_PER_OWNER, UNIT_ROWS))
    places = staged.select(F.pmod(F.xxhash64("chunk"), F.lit(units)).alias("unit"), "chunk", "run", "pos", "fp")
    replies = places.groupBy("unit").applyInPandas(_send(owners), "owner long, unit long, n int, codes binary").groupBy("owner").applyInPandas(_reply, "owner long, unit long, n int, bits binary")
    flags = stage(places.groupBy("unit").cogroup(replies.groupBy("unit")).applyInPandas(_flags, "chunk int, maps array<binary>"), "dedup-flags")
    byte = F.expr("try_cast(conv(hex(substring(try_element_at(maps, run + 1), cast(pos div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, pos % 8)")) != 0, F.lit(False))
    return staged.join(flags.hint("shuffle_hash"), "chunk", "left").withColumn("suspect", bit).drop("maps"), total


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: row (the input row), sha, keep_id, group_size, kept."""
    flagged, total = _flagged(docs, text)
    key = F.col(f"row.`{doc_id}`")
    single = flagged.filter(~F.col("suspect")).select("row", "sha", key.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    suspects = stage(flagged.filter("suspect").drop("suspect", "fp"), "suspects")
    # equal bytes are one group here; two texts of one SHA-256 would be two groups and stop the job
    body = F.translate(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), WHITE, "")
    best = F.min(F.struct(-F.col("chars"), key.isNull(), key.alias("id"), "chunk", "run", "pos")).alias("best")
    groups = (
        suspects.groupBy("sha", body.alias("body")).agg(best, F.count("*").alias("group_size"))
        .groupBy("sha").agg(F.min("best").alias("best"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long")))
    )
    told = stage(groups.withColumn("rows", F.col("group_size")), "groups")
    grouped = join_hot(suspects, told, "sha", "pos", "rows", hot_limit(total)).select(
        "row", "sha", F.col("best.id").alias("keep_id"), "group_size",
        ((F.col("chunk") == F.col("best.chunk")) & (F.col("run") == F.col("best.run")) & (F.col("pos") == F.col("best.pos"))).alias("kept"),
    )
    return single.unionByName(grouped)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    return duplicates(docs, text, doc_id).filter("kept").select("row.*")


def decisions(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents."""
    return duplicates(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
