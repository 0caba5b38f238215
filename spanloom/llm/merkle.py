"""Merkle manifest of a dataset by nested-interval labels.

1. Each row becomes a leaf: SHA-256 over its fields, each with its length. Rows
   are sorted by range within the sorted order of (tree, key); ranks come from
   counts per (tree, range) and their prefix sums, so no window ever holds the
   rows of a tree, and a tree with most of the rows is spread like any other.
2. Every node is labelled by the interval [lo, hi) of leaf ranks that it covers.
   A level groups the nodes below by (tree, lo div width): runs of `fanout`. The
   levels are staged; each has an eighth of the rows of the one below.
3. Ancestors are attached from the root down: a run of nodes meets the node of
   the level above that contains its interval, bucketed by that level's width.
   Within the parent, what lies outside a node's own interval are its siblings:
   left of `lo` and right of `hi`. A step holds one run, `fanout` nodes at most.
4. The roots of the trees are the leaves of one more tree, built the same way.

Defined results: null fields count as `-`; a null doc_id comes first in its tree
and is never tampered with; rows of one doc_id stand in the order of their leaf
digests, equal rows have equal leaves at neighbouring places and each its own
proof; a null lang is a tree of its own, before all others; texts are hashed
whole, however long; an empty table gives an empty result; extra columns are not
read and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage

#: Consecutive nodes that become one.
FANOUT = 8
#: The columns of documents that a leaf covers, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Forest:
    """levels[k]: tree, n (leaves of the tree), lo, hi and digest of the nodes that
    cover up to fanout**k leaves; levels[0] also has `row`, what a leaf carries."""

    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """tree and digest of each tree's last node."""
        every = [level.filter("lo = 0 and hi = n").select("tree", "digest") for level in self.levels]
        whole = every[0]
        for more in every[1:]:
            whole = whole.unionByName(more)
        return whole


@dataclass(frozen=True)
class Manifest:
    """below: the trees of rows; above: the tree of their roots."""

    below: Forest
    above: Forest

    def nodes(self) -> DataFrame:
        """part (`tree` or `root`), tree, level, lo, hi, digest: the whole manifest, to be kept."""
        whole = None
        for part, forest in (("tree", self.below), ("root", self.above)):
            for k, level in enumerate(forest.levels):
                rows = level.select(F.lit(part).alias("part"), "tree", F.lit(k).alias("level"), "lo", "hi", "digest")
                whole = rows if whole is None else whole.unionByName(rows)
        return whole


def framed(value: Column) -> Column:
    """A field with its length in bytes; null is told apart from every text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def tree_of(value: Column) -> Column:
    """Names of trees sort bytewise, null first."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with tree and digest) with lo, their rank in the tree by `order`, and n,
    the rows of the tree. Staged once sorted, so ranks and rows see the same places."""
    by = ["tree", *order, "digest"]
    sorted_rows = rows.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    placed = stage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    ranges = Window.partitionBy("tree")  # as many rows as there are ranges
    before = ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("tree", "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_ahead"), F.sum("_rows").over(ranges).alias("n"))
    return placed.join(ahead, ["tree", "_range"]).withColumn("lo", F.col("_at") + F.col("_ahead")).drop("_at", "_range", "_ahead")


def forest(leaves: DataFrame, *order: str, row: Column, fanout: int = FANOUT) -> Forest:
    """The trees over leaves (tree, digest and the columns of `order`)."""
    level = stage(ranked(leaves, *order).select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest", row.alias("row")), "leaves")
    levels, width = [level], 1
    most = level.agg(F.max("n")).first()[0] or 0
    while width < most:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "digest"))), lambda x: x["digest"]), "")
        grouped = level.filter(F.col("n") > width).groupBy("tree", "n", F.expr(f"lo div {width * fanout}").alias("_bucket"))
        level = stage(grouped.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(joined, 256).alias("digest")).drop("_bucket"), "level")
        levels.append(level)
        width *= fanout
    return Forest(levels, fanout)


def leaf_paths(trees: Forest, starts: DataFrame) -> DataFrame:
    """The leaves' rows with `path`, the siblings left and right of each node from
    the leaf up. starts: tree, path (above its root) and what else its leaves shall
    carry."""
    carried = [c for c in starts.columns if c != "tree"]
    known = None
    for k in range(len(trees.levels) - 1, -1, -1):
        level, width = trees.levels[k], trees.fanout ** (k + 1)
        here = [c for c in level.columns if c not in ("tree", "n")]
        roots = level.filter("lo = 0 and hi = n").select("tree", *here).join(starts, "tree")
        if known is None:
            known = roots
            continue
        runs = level.groupBy("tree", F.expr(f"lo div {width}").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(*here))).alias("run"), F.min("lo").alias("first"), F.max("hi").alias("last"))
        above = known.select("tree", F.expr(f"lo div {width}").alias("bucket"), "lo", "hi", *carried)
        within = runs.join(above, ["tree", "bucket"]).filter("first >= lo and last <= hi").drop("first", "last", "lo", "hi")
        each = within.withColumn("own", F.explode("run"))
        text = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["digest"]), "")
        left, right = text(lambda x: x["hi"] <= F.col("own.lo")), text(lambda x: x["lo"] >= F.col("own.hi"))
        longer = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("path"))
        known = each.select("tree", "own.*", *[longer.alias("path") if c == "path" else c for c in carried]).unionByName(roots)
    return known


def leaves_of(docs: DataFrame, tree: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """tree, key, digest and tampered: the digest of the row after tampering, which
    lower-cases A-Z of the text where 3 divides the CRC-32 of the key."""
    c = lambda n: F.col(f"`{n}`")
    hit = F.coalesce(F.crc32(c(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate(c(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = digest(*[framed(c(f)) for f in fields])
    changed = digest(*[framed(lowered if f == text else c(f)) for f in fields])
    return docs.select(tree_of(c(tree)).alias("tree"), c(key).alias("key"), own.alias("digest"), F.when(hit, changed).alias("tampered"))


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    below = forest(stage(leaves, "digests"), "key", row=F.struct("key", "tampered"), fanout=fanout)
    tops = below.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return Manifest(below, forest(tops, "name", row=F.col("name"), fanout=fanout))


def proofs(m: Manifest) -> DataFrame:
    """One row a leaf: key, digest, tampered, subroot, root and path."""
    root = m.above.roots().select("tree", F.col("digest").alias("root"), F.array().cast(_STEP).alias("path"))
    tops = leaf_paths(m.above, root).select(F.col("row").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return leaf_paths(m.below, tops).select("row.key", "digest", "row.tampered", "subroot", "root", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda got, step: digest(step["left"], got, step["right"]))


def verified(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    told = proofs(manifest(leaves_of(docs))).select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows by recursion over numbered nodes: each round makes one level of
#: every tree that still has several nodes, and hands on each leaf's siblings.
ORACLE = """
WITH RECURSIVE
crc(t) AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) FROM range(256) r(i)),
rows AS (
  SELECT lang, doc_id,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 3 = 0 AS hit
  FROM documents, crc),
leaves AS (
  SELECT row_number() OVER () AS id, lang, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM rows),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
up AS (
  SELECT 0 AS level, lang, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY level, lang, n, pos // 8),
subroots AS MATERIALIZED (SELECT lang, digest, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, pos, digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM over WHERE n > 1 GROUP BY level, n, pos // 8),
nodes AS MATERIALIZED (
  SELECT false AS top, level, coalesce('=' || lang, '') AS tree, pos, digest, n FROM up UNION ALL SELECT true, level, '', pos, digest, n FROM over),
runs AS MATERIALIZED (SELECT top, level, tree, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT id, false AS top, 0 AS level, coalesce('=' || lang, '') AS tree, pos, '' AS proof, coalesce(tampered, leaf) AS got, (SELECT pos FROM subroots s WHERE s.lang IS NOT DISTINCT FROM p.lang) AS next, true AS going FROM placed p
  UNION ALL
  SELECT w.id, CASE WHEN r.run IS NULL THEN true ELSE w.top END, CASE WHEN r.run IS NULL THEN 0 ELSE w.level + 1 END, CASE WHEN r.run IS NULL THEN '' ELSE w.tree END,
    CASE WHEN r.run IS NULL THEN w.next ELSE w.pos // 8 END,
    CASE WHEN r.run IS NULL THEN w.proof ELSE w.proof || array_to_string(r.digests[1:w.pos % 8] || r.digests[w.pos % 8 + 2:], '') END,
    CASE WHEN r.run IS NULL THEN w.got ELSE sha256(array_to_string(r.digests[1:w.pos % 8], '') || w.got || array_to_string(r.digests[w.pos % 8 + 2:], '')) END,
    w.next, NOT (w.top AND r.run IS NULL)
  FROM walk w LEFT JOIN runs r ON r.top = w.top AND r.level = w.level AND r.tree = w.tree AND r.run = w.pos // 8 WHERE w.going),
root AS (SELECT digest FROM over WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(w.proof) AS proof_sha256, w.got AS folded_root, w.got = root.digest AS verified
FROM placed p JOIN (SELECT id, proof, got FROM walk WHERE NOT going) w USING (id) JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, root
"""
