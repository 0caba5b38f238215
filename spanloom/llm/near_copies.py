"""Near copies: SimHash links, and five-word Jaccard similarity of at least 0.8.

The pipeline's near-dedup, keep_one_linked(). Documents are linked by SimHash as in
op8 (64 bits of four-word shingles, at most 4 of them different, over its
byte-position index); and, since 64 bits of a majority vote tell nothing sure at
0.8 (such pairs differ by 5 to 12 bits), by five-word Jaccard too, which takes the
same way over a wider fingerprint. A group is what links of either kind connect;
near_copies() alone has those of Jaccard:

1. Fingerprints: 125 bytes; byte i is the low byte of the least of the XXH64 of
   all shingles under the i-th permutation, so that two texts share a byte with
   a chance equal to their similarity. Equal shingle sets collapse to one node.
2. Index: each fingerprint is posted under 25 keys of (place, 5 bytes). A pair
   of similarity s misses all lists with chance (1 - s^5)^25: 0.00005 at 0.8 and
   1e-10 at 0.95.
3. Count filter, per posting list: pairs that share fewer than 72 bytes go (100
   are expected at 0.8, 72 is six standard deviations below). A list hands on a
   spanning forest of the rest, never its pairs; components of these follow.
4. Check: the shingle sets are made again from the texts of the components'
   documents alone. One pair a node, to the smallest that it was found with, is
   compared by exact Jaccard; a node that very many are found with is replicated
   and its pairs spread. Where these pairs hold a component together, as in a
   group of near copies however large, it is done. Of other components, the sets
   outside the largest part are compared with all others on a grid of cells, each
   of a bounded number of sets on both sides; a cell hands on a spanning forest of
   the links between parts. So each pair of at least 0.8 that passed the count filter
   lies in one group, and documents below it are left alone.

Defined results are those of op8: wordless texts are equal; up to five words are
one shingle; a null doc_id never names a group, links others and stays itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hot_limit, join_hot, stage, utf8
from .simhash import components, drop_others, fingerprint_bits, links, shingle_hashes

WORDS, BANDS, WIDTH, SHARED = 5, 25, 5, 72
#: SimHash: words of a shingle and bits that may differ, as in op8.
SIM_WORDS, SIM_BITS = 4, 4
#: The least similarity as a fraction.
PART, WHOLE = 4, 5
_FACTORS = np.random.default_rng(8).integers(0, 2**64, (BANDS * WIDTH, 1), np.uint64) | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (_FACTORS * shingles[at : at + 512]).min(axis=1), out=least)
    return least.astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets reach the similarity; two empty ones do."""
    if min(len(a), len(b)) * WHOLE < max(len(a), len(b)) * PART:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * WHOLE >= (len(a) + len(b) - both) * PART


def _prints(by_simhash: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 8 << 20):
            texts = utf8(batch.column(1))
            sets = [shingle_set(t) for t in texts]
            fps = [wide_fingerprint(s).tobytes() for s in sets]
            sims = np.array([fingerprint_bits(shingle_hashes(t, SIM_WORDS)) if by_simhash else 0 for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(node_of, sets), pa.int64()), pa.array(fps, pa.binary()), pa.array(sims)], ["doc_id", "node", "fp", "sim"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text", 8 << 20):
        sets = [shingle_set(t) for t in utf8(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = np.arange(BANDS, dtype=np.int64) << (8 * WIDTH)
    power = np.int64(1) << (8 * np.arange(WIDTH, dtype=np.int64))
    for batch in batches:
        fps = _matrix(batch.column(1).to_pylist()).reshape(-1, BANDS, WIDTH)
        keys = fps.astype(np.int64) @ power + place
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])


def _matrix(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), BANDS * WIDTH)


def _pairs(nodes: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one list that pass the count filter: each
    node with the one it was found with. Every member of a group looks at those not
    reached yet alone, so a group of near copies costs one look a member."""
    out, left = [], np.argsort(nodes)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.count_nonzero(fps[left] == fps[one], axis=1) >= SHARED
            out += [(int(nodes[one]), int(x)) for x in nodes[left[near]]]
            front += list(left[near])
            left = left[~near]
    return out


def _by_key(close):
    """close() over the rows of each run of equal keys; rows come sorted by key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != last:
                    out += close(held)
                    last, held = key, []
                held.append(row)
            yield _linked(out)
        yield _linked(close(held))

    return scan


def _list(held: list[tuple]) -> list[tuple[int, int]]:
    if len(held) < 2:
        return []
    nodes, fps = zip(*held, strict=True)
    return _pairs(np.array(nodes, np.int64), _matrix(fps))


def _cell(held: list[tuple]) -> list[tuple[int, int]]:
    """Rows of node, part, whether it stands outside the largest part (asks), fp and
    shingles: links from asking sets to others, only where they join parts that
    nothing in this cell has joined yet, so at most one link a part."""
    others, asking = [r for r in held if not r[2]], [r for r in held if r[2]]
    if not others or not asking:
        return []
    over = {r[1]: r[1] for r in held}

    def top(part: int) -> int:
        while over[part] != part:
            over[part] = part = over[over[part]]
        return part

    fps, out = _matrix([r[3] for r in others]), []
    for node, part, _, fp, shingles in asking:
        own = np.frombuffer(shingles, np.uint64)
        for i in np.flatnonzero(np.count_nonzero(fps == np.frombuffer(fp, np.uint8), axis=1) >= SHARED):
            ours, theirs = top(part), top(others[i][1])
            if ours != theirs and similar(own, np.frombuffer(others[i][4], np.uint64)):
                over[ours] = theirs
                out.append((node, others[i][0]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets, those that are similar."""
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
        yield _linked([(v, u) for v, u, a, b in rows if similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))])


def _similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs (u, v), one a node u, that exact Jaccard confirms."""
    tree = stage(pairs.groupBy("u").agg(F.min("v").alias("v")), "tree")
    limit = hot_limit(tree.count())
    fan = stage(tree.groupBy("v").agg(F.count("*").alias("n"), F.ceil(F.count("*") / limit).cast("long").alias("salts")), "fan")
    spread = join_hot(tree, fan, "v", "u", "n", limit).withColumn("salt", F.pmod(F.xxhash64("u"), "salts")).drop("salts")
    ours = spread.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    theirs = fan.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v").select("v", "sv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    return ours.join(theirs, ["v", "salt"]).select("v", "u", "sv", "su").mapInArrow(_compare, "a long, b long")


def _alike(rows: DataFrame) -> DataFrame:
    """(a, b): the nodes of each group of SimHash fingerprints, linked to its smallest.
    rows: node and sim, the fingerprint. Fingerprints are linked before any node is
    looked at, and one that very many nodes have is spread."""
    held = stage(rows.select("sim", "node").distinct(), "sims")
    sims = stage(held.groupBy("sim").agg(F.min("node").alias("low"), F.count("*").alias("n")), "sim-nodes")
    roots = components(links(sims.select(F.col("sim").alias("fp")), SIM_BITS))
    rooted = sims.join(roots, sims["sim"] == roots["node"], "left").select("sim", "low", "n", F.coalesce("root", "sim").alias("root"))
    named, limit = stage(rooted, "sim-roots"), hot_limit(held.count())
    tops = named.groupBy("root").agg(F.min("low").alias("a"), F.count("*").alias("of"))
    by_sim = stage(join_hot(named, tops, "root", "sim", "of", limit).select("sim", "n", "a"), "by-sim")
    return join_hot(held, by_sim, "sim", "node", "n", limit).select("a", F.col("node").alias("b")).filter("a <> b")


def _with_roots(found: DataFrame, name: str) -> DataFrame:
    """node and its component's smallest node, the smallest itself included."""
    root = F.col("root")
    return found.select("node", root.alias(name)).unionByName(found.select(root.alias("node"), root.alias(name)).distinct())


def _linked(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", by_simhash: bool = False) -> DataFrame:
    """doc_id and component_id (the least doc_id of its group), a row a row.
    by_simhash: groups are linked by SimHash fingerprints, too."""
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = stage(chosen.mapInArrow(_prints(by_simhash), "doc_id long, node long, fp binary, sim long"), "prints")
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("fp").alias("fp")), "nodes")
    posted = stage(nodes.select("node", "fp").mapInArrow(_keys, "key long, node long"), "posted")
    listed = posted.join(posted.groupBy("key").count().filter("count > 1").select("key"), "key").join(nodes.select("node", "fp"), "node")
    lists = listed.select("key", "node", "fp").repartition("key").sortWithinPartitions("key")
    pairs = stage(lists.mapInArrow(_by_key(_list), "a long, b long").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    wide = stage(_with_roots(components(pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))), "wide"), "wide")
    ids = rows.join(wide, "node").select("doc_id").filter("doc_id is not null").distinct()
    texts = chosen.join(ids, "doc_id", "left_semi").select("text").unionByName(chosen.filter("doc_id is null").select("text"))
    sets = stage(texts.mapInArrow(_sets, "node long, shingles binary").join(wide.select("node"), "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")
    sure = stage(_similar_pairs(pairs, sets), "sure")
    held = _with_roots(components(sure), "part")
    parts = stage(wide.join(held, "node", "left").select("node", "wide", F.coalesce("part", "node").alias("part")), "parts")
    limit = hot_limit(parts.count())
    by_part = parts.groupBy("wide", "part").agg(F.count("*").alias("of"))
    kinds = by_part.groupBy("wide").agg(F.max_by("part", F.struct("of", "part")).alias("main"), F.sum("of").alias("n"), F.max("of").alias("most"))
    blocks_of = lambda c: F.ceil(c / limit).cast("long")
    kinds = kinds.select("wide", "main", "n", blocks_of(F.col("n")).alias("down"), blocks_of(F.col("n") - F.col("most")).alias("across"))
    told = stage(join_hot(parts, kinds, "wide", "node", "n", limit).filter("across > 0"), "told")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    answers = told.select("wide", "node", "part", F.lit(False).alias("asks"), place("down").alias("i"), each("across").alias("j"))
    asks = told.filter("part <> main").select("wide", "node", "part", F.lit(True).alias("asks"), each("down").alias("i"), place("across").alias("j"))
    cells = answers.unionByName(asks).select(F.xxhash64("wide", "i", "j").alias("key"), "node", "part", "asks")
    whole = cells.join(nodes.select("node", "fp"), "node").join(sets, "node").select("key", "node", "part", "asks", "fp", "shingles")
    more = whole.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(_cell), "a long, b long")
    joined = sure.unionByName(more)
    found = stage(_with_roots(components(joined.unionByName(_alike(rows)) if by_simhash else joined), "a").withColumnRenamed("node", "b"), "groups")
    named = stage(nodes.join(found, nodes["node"] == found["b"], "left").select("node", "low", F.coalesce("a", "node").alias("root")), "rooted")
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lows, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each group, as simhash.keep_one does it."""
    return drop_others(docs, near_copies(docs, text, doc_id), doc_id)


def keep_one_linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each group that links by SimHash and by Jaccard connect."""
    return drop_others(docs, near_copies(docs, text, doc_id, by_simhash=True), doc_id)
