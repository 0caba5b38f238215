r"""License scans by diagonal voting, in DataFrame functions only.

1. Words of each text (A-Z lower-cased), as one array.
2. A k-gram of a template votes unless it has common words alone. A text that
   holds none of the templates' anchor words (one word of every voting k-gram)
   can hold no such k-gram; only the others are scanned further. That loses
   nothing.
3. Every rolling word k-gram of these texts is hashed and joined to the hashes
   of the templates' k-grams; the words are compared, so equal hashes of other
   words do not count. A hit votes for its diagonal: place in the text less
   place in the template.
4. Votes are added per (text, template, diagonal) as bits by place, diagonals at most `drift`
   apart are merged (words put in or left out), and a merged span is verified:
   the share of the template's voting k-grams that it covers must reach `coverage`
   and the span must not be longer than twice the template. Wordings that differ in
   a deciding word or two (versions, Lesser, Affero) are rivals: of the k-grams that
   a template has and a rival of another label lacks, the span must cover the same
   share, or the text is the rival's.
5. Base phrases are found word by word in the texts that hold all their words.

Votes are partially aggregated; a text's spans meet in one small group, whose
size its own length bounds. Templates are a parameter and known on the driver:
broadcasting them is safe. A very long text is one row of words.

Defined results: null counts as empty, with 0 words and no labels; repeated rows
and null ids are scanned each; equal spans of several templates give all their
labels, a wording that is part of another one too; an empty table gives an empty result; extra columns are not read.
Score: 1 where a base phrase stands, else the best coverage of a verified span,
else 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .license_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases and labels every scan reports.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words that mark no licence; k-grams of these alone do not vote.
COMMON = frozenset("a all an and any are as at be been but by can do for from has have if in into is it its may more no nor not of on one or other shall so such that the their them these this those to was which will with you your".split())


def words_of(text: Column) -> Column:
    """The words of a text; lower() also folds letters beyond A-Z, which changes
    neither where words begin and end nor any word of phrases and templates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(f"({WORD})"), 1)


def _split(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_grams(k: int, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, int, int, str, str]]:
    """(template, its voting k-grams in number, place, k-gram, label)."""
    out = []
    for n, (label, text) in enumerate(templates):
        words = _split(text)
        grams = [(i, words[i : i + k]) for i in range(len(words) - k + 1)]
        voting = [(i, " ".join(g)) for i, g in grams if not COMMON.issuperset(g)]
        out += [(n, len(voting), i, g, label) for i, g in voting]
    return out


def anchors(k: int, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    """A small set of words that meets every voting k-gram, rarest-looking (longest) first."""
    left, taken = {g for *_, g, _ in template_grams(k, templates)}, []
    while left:
        count: dict[str, int] = {}
        for g in left:
            for w in set(g.split()) - COMMON:
                count[w] = count.get(w, 0) + 1
        best = max(count, key=lambda w: (len(w) > 4, count[w], w))
        taken.append(best)
        left = {g for g in left if best not in g.split()}
    return taken


def rivals(k: int, coverage: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, list[list[tuple[int, int]]], list[float]]]:
    """(template, a mask a rival, how many of its k-grams must be covered). Rivals
    have another label and share at least half of the template's voting k-grams;
    masks are bits by place, as (64-bit word, bits) in signed numbers."""
    grams: dict[int, list[tuple[int, str]]] = {}
    for n, _, i, g, _ in template_grams(k, templates):
        grams.setdefault(n, []).append((i, g))
    out = []
    for n, mine in grams.items():
        masks: dict[tuple, int] = {}
        for m, other in grams.items():
            theirs = {g for _, g in other}
            apart = [i for i, g in mine if g not in theirs]
            if templates[m][0] != templates[n][0] and apart and len(apart) * 2 <= len(mine):
                words: dict[int, int] = {}
                for i in apart:
                    words[i // 64] = words.get(i // 64, 0) | 1 << i % 64
                masks[tuple(sorted((w, b - (b >> 63 << 64)) for w, b in words.items()))] = len(apart)
        if masks:
            out.append((n, [list(x) for x in masks], [coverage * c for c in masks.values()]))
    return out


def _places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively, from 0."""
    parts = phrase.split()
    held = F.array_contains(words, parts[0])
    for w in parts[1:]:
        held &= F.array_contains(words, w)

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for n, w in enumerate(parts[1:], 1):
            hit &= F.get(words, i + n) == w
        return F.coalesce(hit, F.lit(False))

    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, drift: int = 2, coverage: float = 0.75, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: one row per input row with its uid, base
    places and words; spans: verified spans with uid, label, first and last word,
    coverage. Both start from one staged table."""
    if not template_grams(k, templates):
        raise ValueError("no template has a k-gram that can vote")
    spark = docs.sparkSession
    words = F.col("words")
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("words"))
    found = base.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.size("words").cast("long").alias("n_words"),
        *[_places(words, p).alias(f"base_{n}") for n, p in enumerate(PHRASES)],
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, anchors(k, templates)))), words).alias("words"),
    )
    staged = stage(found, "license-words")
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.concat_ws(" ", F.slice("words", i, k)))
    exploded = staged.filter(F.size("words") >= k).select("uid", F.posexplode(grams).alias("at", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = spark.createDataFrame(template_grams(k, templates), "template int, grams int, place int, wanted string, label string").withColumn("hash", F.xxhash64("wanted"))
    hits = exploded.join(F.broadcast(known), "hash").filter("gram = wanted")
    # places as bits of 64-bit words, `word` by word: templates may have any length
    votes = hits.groupBy("uid", "template", "grams", "label", (F.col("at") - F.col("place")).alias("diagonal"), F.expr("place div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("covered"), F.min("at").alias("first"), F.max("at").alias("last"))
    along = Window.partitionBy("uid", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > drift, F.lit(True)).cast("int")  # equal ones of other words are no step
    merged = (
        votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(along))
        .groupBy("uid", "template", "grams", "label", "span", "word")
        .agg(F.bit_or("covered").alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("uid", "template", "grams", "label", "span")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "covered"))).alias("bits"), F.sum(F.bit_count("covered")).alias("covered"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
        .withColumn("coverage", F.col("covered") / F.col("grams"))
    )
    spans = merged.filter((F.col("coverage") >= coverage) & (F.col("last") - F.col("first") < 2 * (F.col("grams") + k)))
    against = spark.createDataFrame(rivals(k, coverage, templates), "template int, masks array<array<struct<word:bigint,mask:bigint>>>, needed array<double>")  # as many rows as templates
    hit = lambda mask: F.aggregate(mask, F.lit(0), lambda n, m: n + F.bit_count(F.coalesce(F.col("bits")[m["word"]], F.lit(0).cast("long")).bitwiseAND(m["mask"])))
    told = F.forall(F.zip_with("masks", "needed", lambda mask, n: hit(mask) >= n), lambda fine: fine)
    own = spans.join(F.broadcast(against), "template", "left").filter(F.coalesce(told, F.lit(True)))
    return staged, own.select("uid", "label", "first", "last", "coverage")


def decisions(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents."""
    staged, spans = scan(docs)
    labelled = spans.groupBy("uid").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("best"))
    joined = staged.drop("words").join(labelled, "uid", "left")
    places = F.concat(*[F.col(f"base_{n}") for n in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"base_{n}") > 0, label) for n, label in enumerate(PHRASES.values())]))
    every = F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
