"""Target-distribution importance resampling with position tables (operator 13).

A text becomes a position table, one row a word; following words come from
``lead()`` within the document, one for each further order, and each run is
hashed into a bucket. Counts of buckets over all documents and all target texts
give every bucket a gain, in thousandths of the log of the ratio of shares with
one added to each count. A document's weight is the mean of the gains of its
features, floored; Gumbel noise drawn from its id is added, and the highest
scores are drawn, which samples without replacement in proportion to the
exponential of the weight.

Scale: buckets are counted in each task first, and ``BUCKETS`` gains are
broadcast. For runs of one word the position table isn't shuffled at all; longer
ones need the words of a document together. Ranks come from running totals over
different scores, in ranges, so that no task orders all documents.

Defined results: null and empty texts have no feature, weight 0, and are never
drawn. Rows of repeated ids are judged one by one, on the same noise. A null id
stands for '' in the noise and comes last among equal scores. Without target
texts every count of theirs is 0. An empty table gives no rows. Texts are read
whole; other columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import cut, text_or_empty
from veristrata.operators.running import running

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: ASCII characters that part words: all but digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; plain words take the faster way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def features(rows: DataFrame, orders: int = ORDERS) -> DataFrame:
    """``rows`` (with ``text``) once for each feature: ``bucket`` and ``words``, how many words it has; a row without words once, with nulls."""
    kept = [c for c in rows.columns if c != "text"]
    cut_ = F.filter(F.split(text_or_empty(), BREAKS), lambda w: w != "")
    if orders == 1:
        words = rows.select(*kept, F.explode_outer(cut_).alias("word"))
        return words.select(*kept, F.pmod(F.crc32(lowered(F.col("word"))), F.lit(BUCKETS)).cast("int").alias("bucket"), F.when(F.col("word").isNotNull(), 1).alias("words"))
    table = rows.withColumn("__row", F.monotonically_increasing_id()).select(*kept, "__row", F.posexplode_outer(cut_).alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    following = Window.partitionBy("__row").orderBy("pos")
    table = table.withColumns({f"__next{k}": F.lead("word", k).over(following) for k in range(1, orders)})
    names = ["word", *(f"__next{k}" for k in range(1, orders))]
    runs = F.array(*(F.when(F.col(names[k]).isNotNull(), F.struct(F.concat_ws(" ", *names[: k + 1]).alias("run"), F.lit(k + 1).alias("words"))) for k in range(orders)))
    long = table.select(*kept, F.explode_outer(F.when(F.col("word").isNotNull(), F.filter(runs, lambda r: r.isNotNull()))).alias("r"))
    return long.select(*kept, F.pmod(F.crc32(F.col("r.run")), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("r.words").alias("words"))


def bucket_counts(texts: DataFrame, orders: int = ORDERS) -> DataFrame:
    """``bucket`` and ``n``, ``BUCKETS`` rows at most."""
    return cut(features(texts.select("text"), orders).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n")))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS) -> DataFrame:
    """``bucket`` and ``gain`` of all ``BUCKETS`` buckets."""
    source, wanted = bucket_counts(docs, orders), bucket_counts(target, orders)
    all_s, all_t = (int(c.agg(F.sum("n")).first()[0] or 0) for c in (source, wanted))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    up = (F.col("t") + 1).cast("double") * F.lit(float(all_s + BUCKETS))
    down = (F.col("s") + 1).cast("double") * F.lit(float(all_t + BUCKETS))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variate, floored, from the id."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), F.lit(8)), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scores(docs: DataFrame, target: DataFrame, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """Every row: ``doc_id``, ``n_features``, ``n_words``, ``weight`` and ``score``."""
    gains = F.broadcast(bucket_gains(docs, target, orders))  # BUCKETS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    n = F.count("gain")
    mean = F.when(n > 0, F.floor((F.sum("gain") - F.pmod(F.sum("gain"), n)) / n)).otherwise(0)
    found = features(rows, orders).join(gains, "bucket", "left").groupBy("row", "doc_id").agg(n.alias("n_features"), F.count_if(F.col("words") == 1).alias("n_words"), mean.cast("long").alias("weight"))
    return found.select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1 for the highest score among rows of ``least_words``, null beyond ``percent`` of them."""
    held = cut(scored)
    each = held.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n"))
    upto = running(each, ["score"], {"upto": ("sum", F.col("n"))}, backward=True)
    total = int(each.agg(F.sum("n")).first()[0] or 0)
    wanted = percent * total // 100
    reached = upto.select("score", (F.col("upto") - F.col("n")).alias("above")).where(F.col("above") < wanted)
    marked = held.join(reached.withColumn("enough", F.lit(True)), "score", "left").withColumn("near", F.coalesce(F.col("enough") & (F.col("n_words") >= least_words), F.lit(False)))
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    near = marked.where("near").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    far = marked.where("not near").withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(far).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document: ``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (null: not drawn)."""
    return draw(scores(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The documents that are drawn, whole rows, with ``rank``. Ids must be unique here."""
    chosen = resample(docs, target).where("rank is not null").select(F.col("doc_id").alias("__id"), "rank")
    return docs.drop("rank").join(chosen, F.col("doc_id").cast("long") == F.col("__id")).drop("__id")


def oracle() -> str:
    """The same rows in DuckDB SQL, CRC-32 included, which is worked out from its polynomial once for each different word."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    return f"""
with recursive bits as (select b, b::bigint x, 0 k from range(256) r(b) union all select b, {step}, k + 1 from bits where k < 8),
tab as (select list(x order by b) t from bits where k = 8),
d as (select doc_id, row_number() over () r, {words} w from documents), q as (select {words} w from benchmark),
dw as (select r, unnest(w) word from d), qw as (select unnest(w) word from q),
v as materialized (select word, hex(encode(word)) h from (select word from dw union select word from qw)),
crc as materialized (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h)::bigint, 2), lambda i: ('0x' || substr(h, i, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from v, tab),
s as (select bucket, count(*) s from dw join crc using (word) group by 1), t as (select bucket, count(*) t from qw join crc using (word) group by 1),
tot as (select (select coalesce(sum(s), 0)::bigint from s) cs, (select coalesce(sum(t), 0)::bigint from t) ct),
gain as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (cs + 10000)) / ((s + 1)::double * (ct + 10000))))::bigint g from s left join t using (bucket), tot),
f as (select r, sum(g)::bigint total, count(*) n from dw join crc using (word) join gain using (bucket) group by r),
sc as (select doc_id, coalesce(n, 0) n_features, case when n > 0 then (total - ((total % n) + n) % n) // n else 0 end::bigint weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint h from d left join f using (r)),
fin as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from sc),
rk as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id nulls last) k, count(*) filter (n_features >= 20) over () n from fin)
select doc_id, n_features, weight, score, case when n_features >= 20 and k <= 10 * n // 100 then k end as rank from rk"""
