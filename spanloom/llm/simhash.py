"""SimHash near-dedup over a byte-position inverted index with count filtering.

1. Fingerprints: 64 bits by majority vote over the XXH64 of all word shingles.
   Equal fingerprints collapse to one node before any pair is looked at.
2. Index: two fingerprints that differ in at most d = 4 bits share at least
   8 - 4 = 4 of their 8 positional bytes. A pair with 4 shared positions holds,
   among any family of position triples that meets every 4-set, at least one
   whole shared triple; the 20 triples of COVER are such a family (found by a
   rule, checked when the module loads). So each fingerprint is posted under 20
   keys of (triple, 3 bytes), and no pair within d bits can be missed.
3. Count filter and check, per posting list: the shared positional bytes of
   each pair are tallied, pairs below 4 go, the rest are verified by Hamming
   distance. A list hands on a spanning forest of its links, never its pairs.
4. Lists above LIST_MAX (a hot group of near copies) take another exact way,
   linear in the list: each fingerprint is posted under all values within d/2
   flips of the bytes outside the triple; two fingerprints within d bits meet at
   a common midpoint, and every pair that meets is within d. At an odd d the
   flips are rounded up, some that meet differ by d + 1 bits, and those at one
   midpoint are compared like a list.
5. Components: alternating large-star and small-star rounds over the links.

Defined results: null and wordless texts have fingerprint zero and are linked
like any other; texts with fewer words than a shingle hash their whole word
sequence; repeated rows share a component; a null doc_id is a row of its
fingerprint's component but never names it unless no other id is there; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hot_limit, join_hot, stage, utf8

#: A-Z to a-z, all else as it is.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Posting lists up to this length are compared pair by pair inside their task.
LIST_MAX = 8192


def position_cover() -> list[tuple[int, int, int]]:
    """20 triples of byte positions such that every 4 positions hold one of them:
    the positions in three classes, taken are the triples within a class and
    those with two in a class and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    taken = []
    for triple in combinations(range(8), 3):
        g = sorted(group[i] for i in triple)
        if len(set(g)) == 1 or len(set(g)) == 2 and (set(g) - {g[1]}).pop() == (g[1] + 1) % 3:
            taken.append(triple)
    return taken


COVER = position_cover()
assert all(any(set(t) <= set(four) for t in COVER) for four in combinations(range(8), 4))


def fingerprint_bits(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([h(line[a:b], 42) for a, b in spans], np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 8 << 20):
            fps = np.array([fingerprint_bits(shingle_hashes(t, size)) for t in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def _local_links(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within one posting list as a forest of stars on each group's smallest.

    Grows groups from the smallest fingerprint not reached yet; every member
    tallies the shared bytes with those not reached yet, so that each pair is
    looked at once at most."""
    links, left = [], np.sort(fp)
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            differ = left ^ front.pop()
            octets = differ.view(np.uint8).reshape(len(left), 8)
            near = np.flatnonzero((octets == 0).sum(axis=1) >= 8 - distance)  # the count filter
            near = near[np.bitwise_count(differ[near].view(np.uint64)) <= distance]
            if len(near):
                found = left[near]
                links += [(int(root), int(x)) for x in found]
                front += list(found)
                left = np.delete(left, near)
    return links


def _scan_lists(distance: int):
    """Rows come sorted by key; each run of equal keys is one posting list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, np.empty(0, np.int64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                if key[a] == held_key:
                    held = np.concatenate([held, fp[a:b]])
                else:
                    out += _local_links(held, distance)
                    held_key, held = key[a], fp[a:b].copy()
            yield _link_batch(out)
        yield _link_batch(_local_links(held, distance))

    return scan


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _midpoints(distance: int):
    """Post each fingerprint of a hot list under every value that lies within
    half the distance, rounded up, flipping only bits outside the list's triple."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for t, triple in enumerate(COVER):
            free = [i for i in range(64) if i // 8 not in triple]
            flips = [sum(1 << i for i in c) for k in range((distance + 1) // 2 + 1) for c in combinations(free, k)]
            masks[t] = np.array(flips, np.uint64).view(np.int64)
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(key), 256):
                k, f = key[at : at + 256], fp[at : at + 256]
                mids = [x ^ masks[int(t)] for t, x in zip(k >> 24, f, strict=True)]
                n = [len(m) for m in mids]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k >> 24, n)), pa.array(np.concatenate(mids)), pa.array(np.repeat(f, n))], ["triple", "mid", "fp"])

    return post


def links(fps: DataFrame, distance: int = 4, list_max: int = LIST_MAX) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are
    within the distance; fps has one row a distinct fingerprint. For a distance
    of at most 4, which leaves 4 shared bytes."""
    if not 0 <= distance <= 4:
        raise ValueError("the position cover serves distances of 0 to 4 bits")
    octet = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) for i in range(8)]
    keys = [sum((F.shiftleft(octet[p], 8 * n) for n, p in enumerate(triple)), F.lit(t << 24).cast("long")) for t, triple in enumerate(COVER)]
    posted = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    sizes = posted.groupBy("key").count().filter("count > 1")
    listed = posted.join(sizes.hint("shuffle_hash"), "key")
    short = listed.filter(F.col("count") <= list_max).select("key", "fp").repartition("key").sortWithinPartitions("key")
    found = short.mapInArrow(_scan_lists(distance), "a long, b long")
    hot = listed.filter(F.col("count") > list_max).select("key", "fp").mapInArrow(_midpoints(distance), "triple long, mid long, fp long")
    if distance % 2:
        mids = hot.select(F.xxhash64("triple", "mid").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        return found.unionByName(mids.mapInArrow(_scan_lists(distance), "a long, b long")).distinct()
    roots = hot.groupBy("triple", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    met = hot.join(roots, ["triple", "mid"]).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return found.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected to), for nodes with edges.

    Alternates large-star (bigger neighbours link to the smallest neighbour) and
    small-star (smaller neighbours link to it) until nothing changes; each round
    is staged, so the plan stays short and survives lost executors. Rows of a node
    with very many edges are not brought to one place (join_hot)."""
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), "links")
    before, size = None, edges.count()
    while True:
        limit = hot_limit(2 * size)
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, low, "a", "b", "n", limit).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "b", "a", "n", limit).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        edges = stage(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
        before, size = state, state[0]


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, distance: int = 4, list_max: int = LIST_MAX) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id."""
    rows = stage(fingerprints(docs, text, doc_id, size), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), distance, list_max))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    named = stage(rooted, "rooted")
    limit = hot_limit(rows.count())
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("of"))
    by_fp = stage(join_hot(named, ids, "root", "fp", "of", limit).select("fp", "n", "component_id"), "by-fp")
    return join_hot(rows, by_fp, "fp", "doc_id", "n", limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_others(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without those that are not the lowest of their component in found."""
    dropped = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low")).filter("doc_id <> low").select(F.col("doc_id").alias("dropped_id"))
    return docs.join(dropped, docs[doc_id] == F.col("dropped_id"), "left_anti")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, distance: int = 4) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the
    smallest id. Rows of one doc_id are one document and stay or go together, by
    the lowest group they are in; rows without an id stay."""
    return drop_others(docs, near_duplicates(docs, text, doc_id, size, distance), doc_id)
