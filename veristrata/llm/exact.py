"""Exact deduplication with a heavy-hitter split (operator 12).

Texts are equal when they are identical after each run of ASCII white space is
one space; they meet by the SHA-256 of that form, so that texts themselves
aren't shuffled. Frequent digests are found by Misra-Gries summaries, one a
task, which add up. Their winners (smallest id) and sizes are then counted
exactly, over all rows, and broadcast: rows of frequent digests get their result
where they lie. The remaining digests are grouped by an ordinary shuffle.

Bounds: with k = ``COUNTERS``, a task's summary is short of a digest's count by
rows / (k + 1) at most, and leaves out counters of as little again. A digest with
3 / (k + 1) of all rows or more is therefore found, digests whose counters add up
to less than 1 / (k + 1) of the rows aren't taken, and so k + 1 winners are
broadcast at most. No remaining digest has more than 3 / (k + 1) of the rows.

Defined results: null texts count as empty. Null ids are larger than any other:
a group of them alone has a null ``keep_id``, and its rows stay. Rows that share
id and text are one document: each gets the same result, and ``drop_copies``
keeps one. An empty table gives no rows. Other columns play no part and are kept
by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import cut, stored, text_or_empty

#: Counters of a summary.
COUNTERS = 2000


def digest(text: Column) -> Column:
    """SHA-256 of the normal form. The pattern leaves single spaces alone, which are what they become."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ").cast("binary"), 256))


def reduced(counts: dict, counters: int) -> dict:
    """A summary of ``counters`` at most: all are lowered by the largest one that has no place."""
    if len(counts) <= counters:
        return counts
    lowest = sorted(counts.values(), reverse=True)[counters]
    return {k: n - lowest for k, n in counts.items() if n > lowest}


def summaries(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Misra-Gries summaries of each task: ``key`` and ``n``, too small by a known share at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        total = 0
        for batch in batches:
            total += batch.num_rows
            found = pc.value_counts(batch.column(0))
            for k, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True):
                counts[k] = counts.get(k, 0) + n
            counts = reduced(counts, counters)
        kept = {k: n for k, n in counts.items() if k is not None and n * (counters + 1) > total}
        yield pa.RecordBatch.from_pydict({key: list(kept), "n": list(kept.values())}, pa.schema([(key, pa.binary()), ("n", pa.int64())]))

    return rows.select(key).mapInArrow(run, f"{key} binary, n long")


def frequent(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Keys that may hold a large share of the rows, ``counters`` + 1 at most; all that hold 3 / (counters + 1) are among them."""
    total = rows.count()
    return summaries(rows, key, counters).groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") * (counters + 1) >= total).select(key)


def winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest``, ``keep_id`` and ``group_size`` of frequent digests, counted over all rows. At most ``counters`` + 1."""
    return cut(rows.join(F.broadcast(frequent(rows, "digest", counters)), "digest").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))


def split(rows: DataFrame, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """Winners of frequent digests (to be broadcast) and groups of the remaining repeated ones. ``rows``: doc_id, digest."""
    heavy = winners(rows, counters)
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    return heavy, rest.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``digest`` of every row, stored: the texts are read once."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text_or_empty()).alias("digest")), "digests")


def groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Every document: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = digests(docs)
    heavy, repeated = split(rows, counters)
    common = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti").join(repeated, "digest", "left")
    alone = F.col("group_size").isNull()
    rest = rest.select("digest", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    return common.unionByName(rest).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs``, whole rows, without copies. Copies of frequent texts are removed where they are read; no text of theirs is shuffled but the winner's."""
    heavy, repeated = split(digests(docs), counters)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), digest(text_or_empty()).alias("digest"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    common = marked.join(F.broadcast(heavy), "digest").where(stays)
    rest = marked.join(F.broadcast(heavy), "digest", "left_anti").join(repeated, "digest", "left")
    single = rest.where("group_size is null")
    several = common.select("row", "doc_id", "digest").unionByName(rest.where(F.col("group_size").isNotNull() & stays).select("row", "doc_id", "digest"))
    one = several.where("doc_id is not null").dropDuplicates(["doc_id", "digest"]).unionByName(several.where("doc_id is null"))
    return single.select("row").unionByName(one.select("row")).select("row.*")


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') t from documents),
g as (select t, min(doc_id) keep_id, count(*) group_size from d group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) text_sha256 from d join g using (t)"""
