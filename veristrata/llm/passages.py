"""Repeated passages (operator 7): sliding spans of sentences.

A text is cut into sentences (up to ``.``, ``!``, ``?`` or a line end, with the
white space after it). Every run of ``RUN`` consecutive sentences is a span if
it has ``RUN_WORDS`` words or more. Where it has fewer (lists, verse, addresses),
it is extended to the shortest run that has them, forwards from its first and
backwards from its last sentence, so that of any stretch of ``RUN`` sentences and
``RUN_WORDS`` words each sentence with words is under some span inside it
(``extend``). So are two
sentences of ``PAIR_WORDS`` words and one of ``LONE_WORDS`` spans, for passages of
few long sentences. Spans are hashed
(128 bits over the sentences' trimmed texts), joined over all documents, and
the sentences under any span that isn't the first of its kind are removed. The
first is that of the smallest doc_id, then text hash, and of the earliest place in it.

Scale: a span is two hashes, an id and a place; copies inside a document are
settled where it is read. The first holder of each span comes from a
partially aggregated group-by, so a passage in a third of all documents is
combined before the shuffle; only spans with two holders or more join back,
one row a span, so that no pairs are made and a skewed side can be split.

Defined results: null texts stay null and empty ones empty; texts are read
whole; rows that share an id, or have none, are told apart by their texts (null
ids come last, and no id is given for one that keeps a passage); rows that share
both are taken for one document, whose spans don't count as repeats of each other;
columns other than the id and the text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import in_batches

RUN, RUN_WORDS, PAIR_WORDS, LONE_WORDS = 3, 12, 30, 50
#: A sentence with what follows it, or a text's unfinished end. The same pattern holds in Python, Java and RE2.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"
TRIM = " \t\r\n"
_SENTENCE = re.compile(SENTENCE)
#: The id under which rows of null id are ordered, after all others.
NO_ID = (1 << 63) - 1
SPANS = "id long, tie long, hash_a long, hash_b long, place int, size int, first boolean"


def runs(text: str, extend: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(place, sentences, digest) of every span of a text."""
    found = [s.strip(TRIM) for s in _SENTENCE.findall(text)]
    count = [len(s.split()) for s in found]
    digest = [xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in found]
    n = len(found)
    end, start = (reach(count), [n - e for e in reversed(reach(count[::-1]))]) if extend else ([0] * n, [-1] * n)
    for i in range(n):
        if count[i] >= LONE_WORDS:
            yield i, 1, b"1" + digest[i]
        if i + 2 <= n and count[i] + count[i + 1] >= PAIR_WORDS:
            yield i, 2, b"2" + digest[i] + digest[i + 1]
        if i + RUN <= n and sum(count[i : i + RUN]) >= RUN_WORDS:
            yield i, RUN, b"".join(digest[i : i + RUN])
        # runs with too few words, extended; a run is given once if it is the shortest from both ends
        elif count[i] and i + RUN < end[i] <= n:
            yield i, end[i] - i, b"".join(digest[i : end[i]])
        if count[i] and 0 <= start[i] < i + 1 - RUN and not (count[start[i]] and end[start[i]] == i + 1):
            yield start[i], i + 1 - start[i], b"".join(digest[start[i] : i + 1])


def reach(count: list[int]) -> list[int]:
    """Where the shortest run of ``RUN`` sentences and ``RUN_WORDS`` words from each sentence ends; beyond the text if there is none."""
    out, at, words = [], 0, 0
    for i, c in enumerate(count):
        while at < len(count) and (at < i + RUN or words < RUN_WORDS):
            words += count[at]
            at += 1
        out.append(at if at >= i + RUN and words >= RUN_WORDS else len(count) + 1)
        words -= c
    return out


def spans(docs: DataFrame, extend: bool = True) -> DataFrame:
    """Every span of every document. ``tie`` is a hash of the text; ``first`` tells a span's first place in its own text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[i : i + 512] for i in range(0, len(batch), 512)):
                ids, ties, places, sizes, firsts, digests = [], [], [], [], [], []
                for id_, tie, text in zip(part["id"].array, part["tie"].array, part["text"], strict=True):
                    seen: set[bytes] = set()
                    before = len(places)
                    for place, size, key in runs(text, extend):
                        d = xxhash.xxh3_128_digest(key)
                        places.append(place)
                        sizes.append(size)
                        firsts.append(d not in seen)
                        seen.add(d)
                        digests.append(d)
                    n = len(places) - before
                    ids += [id_] * n
                    ties += [tie] * n
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "tie": np.array(ties, dtype=np.int64), "hash_a": h[:, 0], "hash_b": h[:, 1], "place": np.array(places, dtype=np.int32), "size": np.array(sizes, dtype=np.int32), "first": np.array(firsts, dtype=bool)})

    known = in_batches(docs).where("text is not null and text <> ''").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tie"), "text")
    return known.mapInPandas(run, SPANS)


def repeated(docs: DataFrame, extend: bool = True) -> DataFrame:
    """Spans to remove: ``id``, ``tie``, ``place``, ``size`` and ``holder``, the id of the document that keeps the passage."""
    every = spans(docs, extend)
    row = F.struct("id", "tie")  # rows of one id, or of none, are told apart by their texts
    held = every.groupBy("hash_a", "hash_b").agg(F.min(row).alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = every.join(held, ["hash_a", "hash_b"]).where((row > F.col("holder")) | ~F.col("first"))
    return gone.select("id", "tie", "place", "size", F.nullif(F.col("holder.id"), F.lit(NO_ID)).alias("holder"))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def remove_repeated(docs: DataFrame, extend: bool = True) -> DataFrame:
    """``docs``, all columns, with ``text`` shortened, and ``n_sentences``, ``n_removed`` and ``copied_from`` (ids) more."""
    gone = repeated(docs, extend).groupBy("id", "tie").agg(F.collect_set(F.struct("place", "size")).alias("__spans"), F.sort_array(F.collect_set("holder")).alias("__holders"))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__tie", F.xxhash64("text"))
    both = keyed.join(gone, (F.col("__id") == gone["id"]) & (F.col("__tie") == gone["tie"]), "left").drop(gone["id"], gone["tie"])
    covered = F.flatten(F.transform("__spans", lambda s: F.sequence(s["place"], s["place"] + s["size"] - 1)))

    def shorten(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), covered)
        return F.struct(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "").alias("text"), F.size(parts).cast("long").alias("n"), (F.size(parts) - F.size(kept)).cast("long").alias("gone"))

    # the sentences are bound once; a text without removals is only counted
    whole = F.struct(F.col("text"), F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.regexp_count("text", F.lit(SENTENCE))).cast("long").alias("n"), F.lit(0).cast("long").alias("gone"))
    made = both.withColumn("__made", F.when(F.col("__spans").isNull(), whole).otherwise(F.transform(F.array(sentences(F.col("text"))), shorten)[0]))
    return made.select(*(F.col("__made.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.col("__made.n").alias("n_sentences"), F.col("__made.gone").alias("n_removed"), F.coalesce("__holders", F.array().cast("array<bigint>")).alias("copied_from"))


def oracle() -> str:
    """The same result as DuckDB SQL, on the sentences' texts in place of hashes."""
    trim = r"' ' || chr(9) || chr(13) || chr(10)"
    words = r"regexp_extract_all(s, '[^ \t\r\n\f\x0B\x1C-\x1F\x85\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+')"
    return rf"""
with d as (select doc_id, text, regexp_extract_all(text, '{SENTENCE}') parts from documents),
s as (select doc_id, i - 1 as place, trim(parts[i], {trim}) s from d, unnest(range(1, len(parts) + 1)) u(i)),
w as (select doc_id, place, s, len({words}) c from s),
r as (select doc_id, place, s, c, lead(s) over q s2, lead(c) over q c2, lead(s, 2) over q s3, lead(c, 2) over q c3 from w window q as (partition by doc_id order by place)),
summed as (select doc_id, place, c, sum(c) over (partition by doc_id order by place) upto, lead(c, 1, 0) over q + lead(c, 2, 0) over q + c ahead, lag(c, 1, 0) over q + lag(c, 2, 0) over q + c behind from w window q as (partition by doc_id order by place)),
lists as (select doc_id, list(s order by place) s from s group by doc_id),
extended as (
  select x.doc_id, x.place, (min(y.place) - x.place + 1)::int size from summed x join summed y on x.doc_id = y.doc_id and y.place >= x.place + {RUN} and y.upto - x.upto + x.c >= {RUN_WORDS}
    where x.c > 0 and x.ahead < {RUN_WORDS} group by x.doc_id, x.place
  union select x.doc_id, max(y.place), (x.place - max(y.place) + 1)::int from summed x join summed y on x.doc_id = y.doc_id and y.place <= x.place - {RUN} and x.upto - y.upto + y.c >= {RUN_WORDS}
    where x.c > 0 and x.behind < {RUN_WORDS} group by x.doc_id, x.place),
spans as (
  select doc_id, place, 1 size, [s] k from r where c >= {LONE_WORDS}
  union all select doc_id, place, 2, [s, s2] from r where s2 is not null and c + c2 >= {PAIR_WORDS}
  union all select doc_id, place, 3, [s, s2, s3] from r where s3 is not null and c + c2 + c3 >= {RUN_WORDS}
  union all select x.doc_id, x.place, x.size, a.s[x.place + 1 : x.place + x.size] from extended x join lists a using (doc_id)),
ranked as (select *, row_number() over (partition by k order by doc_id, place) n, first_value(doc_id) over (partition by k order by doc_id, place) holder from spans),
gone as (select distinct doc_id, place + j place, holder from ranked, unnest(range(0, size)) v(j) where n > 1),
gone_at as (select distinct doc_id, place from gone),
kept as (select w.doc_id, string_agg(d.parts[w.place + 1], '' order by w.place) text, count(*) n from w join d using (doc_id) where not exists (select 1 from gone_at g where g.doc_id = w.doc_id and g.place = w.place) group by w.doc_id),
lost as (select doc_id, count(*) n from gone_at group by doc_id),
holders as (select doc_id, list(distinct holder order by holder) copied_from from gone group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(kept.text, '') end as text, coalesce(len(d.parts), 0) as n_sentences, coalesce(lost.n, 0) as n_removed,
  coalesce(holders.copied_from, []) as copied_from
from d left join kept using (doc_id) left join lost using (doc_id) left join holders using (doc_id)"""
