"""Document fingerprints (operator 5), in DataFrame functions only.

A text is cut at blank lines into sections and at line ends into paragraphs. A
paragraph's hash is that of its text, a section's that of its paragraphs'
hashes, the root's that of its sections' hashes: equal roots mean equal texts,
and where roots differ, only differing branches need a look. Below each
paragraph stand short tags of its sentences (pieces of at most ``LEAF``
characters), so that an edit inside a paragraph is located too, and the
likeness of two texts can be told from their fingerprints alone.

A fingerprint is ``root|section|section...``; a section is ``hash.length``, then
``{paragraph;paragraph...}``; a paragraph is ``hash.length:`` and its leaves
``tag.length`` joined by commas. Hashes of inner nodes are whole SHA-256 values,
lengths are in characters.

Two fingerprints are compared from the top: equal roots end the comparison;
sections that both have are passed over whole; of the others, paragraphs that
both have; and only of paragraphs that differ the leaves are looked at. Nodes
are matched by hash wherever they stand, so that a text moved by an insertion
still matches, and a node that a side has twice counts once.

Defined results: null and empty texts are the empty text, whose fingerprint has
one section with one empty paragraph; two texts without a character in common
have likeness 0; texts are read whole; equal rows get
equal fingerprints. In the query the rows are ordered by descending id, then
text hash, null ids last; a single row is its own successor.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import text_or_empty

LEAF = 120
#: Rows of a bucket of neighbours, the most buckets there are, and the rows sampled for each bucket's bound.
BUCKET_ROWS, BUCKETS, SAMPLED = 512, 16_384, 16
#: Bytes of text that one task reads.
TASK_BYTES = 64 << 20
LEAVES = rf"[^.!?]{{0,{LEAF}}}+[.!?]++\s*+|[^.!?]{{1,{LEAF}}}+"


def _sha(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` evaluated once."""
    return F.transform(F.array(x), use)[0]


def _total(nodes: Column) -> Column:
    """Characters under some inner nodes."""
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda n, x: n + F.regexp_extract(x, r"\.([0-9]+)", 1).cast("long"))


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text, as a string."""

    def leaf(s: Column) -> Column:
        return F.concat(F.lower(F.right(F.lpad(F.hex(F.xxhash64(s)), 16, "0"), F.lit(10))), F.lit("."), F.length(s).cast("string"))

    def paragraph(p: Column) -> Column:
        return F.concat(_sha(p), F.lit("."), F.length(p).cast("string"), F.lit(":"), F.array_join(F.transform(F.regexp_extract_all(p, F.lit(LEAVES), 0), leaf), ","))

    def over(nodes: Column) -> Column:
        return _sha(F.array_join(F.transform(nodes, root), ""))

    def section(s: Column) -> Column:
        size = F.length(F.replace(s, F.lit("\n"), F.lit("")))
        return _bound(F.transform(F.split(s, "\n", -1), paragraph), lambda x: F.concat(over(x), F.lit("."), size.cast("string"), F.lit("{"), F.array_join(x, ";"), F.lit("}")))

    return _bound(F.transform(F.split(text, "\n\n", -1), section), lambda x: F.concat(over(x), F.lit("|"), F.array_join(x, "|")))


def root(print_: Column) -> Column:
    """The hash that a fingerprint, a section or a paragraph begins with."""
    return F.left(print_, F.lit(64))


def sections(print_: Column) -> Column:
    return F.slice(F.split(print_, r"\|", -1), 2, 1 << 30)


def paragraphs(section: Column) -> Column:
    return F.split(F.regexp_extract(section, r"\{(.*)\}", 1), ";", -1)


def leaves(paragraph: Column) -> Column:
    return F.filter(F.split(F.substring_index(paragraph, ":", -1), ",", -1), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """Share of characters that both trees hold, 0 to 1, by a walk down the branches that differ; 1 where the roots are equal."""

    def level(x: Column, y: Column, below: Callable[[Column, Column], Column]) -> Column:
        """Characters (held by both, by one) under nodes that both sides have, and under the others by ``below``."""
        both, ours, theirs = F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)
        return _bound(F.struct(_total(both).alias("both"), below(ours, theirs).alias("rest")), lambda s: F.struct((s["both"] + s["rest"]["both"]).alias("both"), s["rest"]["one"].alias("one")))

    def inside(nodes: Column, parts: Callable[[Column], Column]) -> Column:
        return F.array_distinct(F.flatten(F.transform(nodes, parts)))

    def of_leaves(x: Column, y: Column) -> Column:
        return F.struct(_total(F.array_intersect(x, y)).alias("both"), (_total(F.array_except(x, y)) + _total(F.array_except(y, x))).alias("one"))

    def of_paragraphs(x: Column, y: Column) -> Column:
        return level(x, y, lambda p, q: of_leaves(inside(p, leaves), inside(q, leaves)))

    walked = level(sections(a), sections(b), lambda s, t: of_paragraphs(inside(s, paragraphs), inside(t, paragraphs)))
    share = _bound(walked, lambda w: F.coalesce(F.try_divide(2.0 * w["both"], 2 * w["both"] + w["one"]), F.lit(0.0)))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(share)


def differing(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: (section, paragraph) numbers, from 0, of paragraphs of ``a`` whose branch isn't the same in ``b``.

    Sections with equal hashes are passed over without a look at their paragraphs.
    """

    def of(section: Column, i: Column) -> Column:
        there = F.coalesce(F.get(sections(b), i), F.lit(""))
        numbered = F.transform(paragraphs(section), lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), (root(p) == root(F.coalesce(F.get(paragraphs(there), j), F.lit("")))).alias("same")))
        changed = F.transform(F.filter(numbered, lambda x: ~x["same"]), lambda x: F.struct(x["section"], x["paragraph"]))
        return F.when(root(section) == root(there), F.filter(changed, lambda x: F.lit(False))).otherwise(changed)

    return F.flatten(F.transform(sections(a), of))


def add_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with one more column; other columns stay."""
    return docs.withColumn(name, fingerprint(F.coalesce(F.col(text_col), F.lit(""))))


def bucket_of(rows: DataFrame, n: int, bucket_rows: int) -> Column:
    """The number of a row's bucket: how many bounds aren't above its (id, tie). Bounds cut a sample into equal parts, whatever gaps ids have.

    The sample only says where buckets end; every row is dealt to one, and the result doesn't depend on the bounds.
    """
    buckets = min(BUCKETS, math.ceil(n / bucket_rows))
    if buckets < 2:
        return F.lit(0)
    draw = F.pmod(F.xxhash64("doc_id", "tie", F.lit(23)), F.lit(max(1, n // (SAMPLED * buckets))))
    sample = rows.where(draw == 0).select(*KEY)
    # about SAMPLED * BUCKETS rows at most, whose order makes the bounds
    parts = sample.distinct().withColumn("part", F.ntile(buckets).over(Window.orderBy(*KEY)))
    bounds = [r["low"] for r in parts.groupBy("part").agg(F.min(F.struct(*KEY)).alias("low")).orderBy("part").collect()][1:]
    # constant arrays, read by binary search
    known, id_, tie = (F.split(F.lit(",".join(str(int(x[i])) for x in bounds)), ",").cast("array<bigint>") for i in range(3))
    size = len(bounds)
    if not size:
        return F.lit(0)

    def step(at: Column, jump: Column) -> Column:
        k = at + jump
        there = F.struct(F.get(known, k - 1).alias("known"), F.get(id_, k - 1).alias("id"), F.get(tie, k - 1).alias("tie"))
        return F.when((k <= size) & (there <= F.struct(F.col("known").cast("long").alias("known"), F.col("at").alias("id"), F.col("tie").alias("tie"))), k).otherwise(at)

    return F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(size.bit_length())))), F.lit(0), step)


#: The order of rows, ascending: null ids first, then ids, then hashes of texts.
KEY = ("known", "at", "tie")


def compare_with_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The query: every document's fingerprint, that of its edited text, and two likenesses.

    Neighbours in descending id order are found without a global sort of rows:
    rows are dealt to buckets of neighbouring (id, text hash), a window inside
    each bucket finds the next row, and each bucket gets the head of the bucket
    below as one more row to look at. Only bucket numbers, ``BUCKETS`` at most,
    are ordered in one task. The texts are shuffled once; a window spills.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumns({"known": F.col("doc_id").isNotNull(), "at": F.coalesce("doc_id", F.lit(0).cast("long")), "tie": F.xxhash64("text")})
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((seen["bytes"] or 0) / TASK_BYTES))
    bucket = bucket_of(rows, seen["n"], bucket_rows)
    dealt = rows.withColumn("bucket", bucket).repartition(tasks, "bucket")

    # a bucket's head: its greatest key, from narrow rows, then the text of that key, BUCKETS texts at most
    tops = rows.select(bucket.alias("bucket"), F.struct(*KEY).alias("key")).groupBy("bucket").agg(F.max("key").alias("key")).select("bucket", "key.*")
    heads = rows.join(F.broadcast(tops), list(KEY)).groupBy("bucket").agg(F.first("text").alias("head_text"))
    below = heads.select("bucket").withColumn("above", F.lead("bucket").over(Window.orderBy("bucket")))
    # the lowest bucket's last row is followed by the first of all
    above = F.coalesce("above", F.min("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.join(below.select("bucket", above.alias("above")), "bucket").select(F.col("above").alias("bucket"), "head_text")

    order = Window.partitionBy("bucket").orderBy(*(F.desc(k) for k in KEY))
    beside = dealt.withColumn("next_text", F.lead("text").over(order)).join(guests, "bucket", "left")
    n_chars = F.length("text")
    made = (
        beside.select("doc_id", "text", F.coalesce("next_text", "head_text").alias("next_text"))
        .withColumn("n_chars", n_chars.cast("long"))
        .withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
        .withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("half")), F.left("next_text", F.col("half"))))
        .select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"))
    )
    a, b, c = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", a, b, likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
