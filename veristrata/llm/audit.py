"""Filter interaction audit with sort-based duplicates (operator 11).

Five filters judge every whole text: A (under 200 words), B (fewer than half of
the words are different), C (over 3 % capitals), D (a symbol of markup) and E (a
copy of a text with a smaller id). Copies are found by sorting: rows are dealt to
ranges of (fingerprint, doc_id) and sorted by fingerprint, full text and doc_id,
so that each row is compared with the one before it. A text that a third of all
rows hold is split over ranges by its ids.

Boundaries: a range can't see the rows before its first. Of every different text
under its first and its last fingerprint it hands on the smallest id it holds,
and rows under its first fingerprint that have no smaller id inside the range are
settled by the smallest id handed on for their text. Since all ranges between
hold that fingerprint alone, nothing else can lie outside.

A row's failures are five bits. Counts of documents by part and bits add up, and
the outcome of every step of all 120 orders follows from 32 counters a part.

Defined results: null texts are empty (they fail A), null languages are the part
''. Rows of null id are never copies and have no copies; rows that share id and
text are copies of neither. Repeated rows count each. A document has a label if
any row of ``labels`` says so; other columns play no part. Parts are those that
occur: an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import stored, text_or_empty

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DIFFERENT, MOST_CAPITALS = 200, 50, 3
CAPITALS, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
COPY = 1 << LETTERS.index("E")
#: Kinds of rows that leave a range.
SETTLED, OPEN, HANDED = 0, 1, 2
MARKED = "doc_id long, part string, failures int, kind int, fingerprint long, text binary, least long"
#: Texts that are held as Python objects at a time.
SLICE = 256


def failures(text: bytes, points: int) -> int:
    """Bits of A to D. Words are runs without ASCII white space, which is what bytes are split at."""
    words = text.split()
    bits = len(words) < LEAST_WORDS
    bits |= (100 * len(set(words)) < LEAST_DIFFERENT * len(words)) << 1
    bits |= (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points) << 2
    bits |= (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    return int(bits)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, in order: doc_id, part, text, fingerprint."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failures", pa.int32()), ("kind", pa.int32()), ("fingerprint", pa.int64()), ("text", pa.binary()), ("least", pa.int64())])
    first = fingerprint = text = least = None
    runs: list[tuple[bytes, int | None]] = []  # smallest id of each text under the fingerprint at hand, but the current text's

    def handed() -> list[tuple]:
        return [(None, None, None, HANDED, fingerprint, t, i) for t, i in [*runs, (text, least)] if i is not None]

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            out = []
            part = batch.slice(at, SLICE)
            ids, parts, texts, prints = part.columns
            for i, lang, t, points, f in zip(ids.to_pylist(), parts.to_pylist(), texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist(), prints.to_pylist(), strict=True):
                if f != fingerprint:
                    if fingerprint is not None and fingerprint == first:
                        out += handed()
                    first = f if first is None else first
                    fingerprint, text, least, runs = f, t, i, []
                    copy = False
                elif t != text:
                    runs.append((text, least))
                    text, least, copy = t, i, False
                else:
                    copy = i is not None and least is not None and least < i
                    least = i if least is None else least
                bits = failures(t, points) | (COPY if copy else 0)
                known = copy or f != first or i is None
                out.append((i, lang, bits, SETTLED if known else OPEN, None if known else f, None if known else t, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if fingerprint is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*handed(), strict=True), schema, strict=True)] if least is not None or any(i is not None for _, i in runs) else [pa.array([], k.type) for k in schema], schema=schema)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part`` and ``failures`` (bits, A is 1) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text")).withColumn("fingerprint", F.xxhash64("text"))
    in_order = rows.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    marked = stored(in_order.mapInArrow(_compare, MARKED), "judged")  # ranges are drawn once
    least = marked.where(F.col("kind") == HANDED).groupBy("fingerprint", "text").agg(F.min("least").alias("smallest"))
    open_ = marked.where(F.col("kind") == OPEN).drop("least").join(least, ["fingerprint", "text"], "left")
    settled = open_.select("doc_id", "part", (F.col("failures") + F.when(F.col("smallest") < F.col("doc_id"), COPY).otherwise(0)).alias("failures"))
    return marked.where(F.col("kind") == SETTLED).select("doc_id", "part", "failures").unionByName(settled)


def counters(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by ``part`` and ``failures``: ``n``, ``good`` (labelled of quality) and ``toxic``."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return found.join(marks, "doc_id", "left").groupBy("part", "failures").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def outcomes(counted: DataFrame) -> DataFrame:
    """Every step of every order, from the counters (32 a part at most)."""
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(LETTERS))), ",")
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("failures", "n", "good", "toxic")).alias("cells"))
    steps = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def bits(of: Column) -> Column:
        return sum((F.when(F.instr(of, c) > 0, 1 << k).otherwise(0) for k, c in enumerate(LETTERS)), F.lit(0))

    steps = steps.withColumn("own", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(of: str, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(where(c["failures"]), c[of]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails, passed = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) == 0)
    # of the orders, those in which a filter comes first of the ones that a document fails
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["failures"]), (F.lit(120) * c["n"] / F.bit_count(c["failures"])).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & passed(m)).alias("removed"),
        total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", lambda m: fails(m) & passed(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & passed(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: what the filter keeps, removes, and would have removed."""
    return outcomes(counters(judged(docs), labels))


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from d),
m as (select doc_id, part, (len(ws) < 200)::int a, (100 * len(list_distinct(ws)) < 50 * len(ws))::int b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int c,
  regexp_matches(t, '[#$%&*|]')::int d, coalesce(doc_id > min(doc_id) over (partition by t), false)::int e from w),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
f as (select part, [a, b, c, d, e] v, coalesce(good, 0) good, coalesce(toxic, 0) toxic, count(*) n from m left join l using (doc_id) group by all),
x as (select unnest([1, 2, 3, 4, 5]) i),
o as (select [p.i, q.i, r.i, s.i, u.i] o from x p, x q, x r, x s, x u where len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
st as (select o, x.i step, o[x.i] own from o, x),
j as (select part, st.o, step, own, n, good, toxic, v[own] = 1 fails, list_sum(list_transform(st.o[1:step-1], lambda k: v[k])) > 0 as gone, list_sum(v) all_fails from f, st),
r as (select part, o, step, own, sum(case when not fails and not coalesce(gone, false) then n else 0 end) kept, sum(case when fails and not coalesce(gone, false) then n else 0 end) removed, sum(case when fails and gone then n else 0 end) redundant,
  sum(case when fails and all_fails = 1 then n else 0 end) unique_fails, sum(case when fails and not coalesce(gone, false) then n * good else 0 end) good_lost, sum(case when fails and not coalesce(gone, false) then n * toxic else 0 end) toxic_lost from j group by all)
select part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, own))::bigint shapley from r"""
