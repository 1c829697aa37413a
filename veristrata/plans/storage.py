"""Registered queries of sources, sinks and the transactional log: tables are written in a format and what is read back is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.operators import ledger
from veristrata.operators.running import running
from veristrata.plans.chains import _EVENTS, sealed_events
from veristrata.plans.queries import query
from veristrata.sources import formats
from veristrata.sources.commits import Conflict, Log
from veristrata.sources.session import checkpoint_dir, table


def written(rows: DataFrame, name: str) -> str:
    """The folder of its own that ``rows`` are written into in a format."""
    spark = rows.sparkSession
    formats.register(spark)
    at = f"{checkpoint_dir(spark)}/veristrata-{name}-{uuid.uuid4().hex}"
    rows.write.format(name).mode("append").save(at)
    return at


def through(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written in a format into a folder of its own and read back."""
    return rows.sparkSession.read.format(name).load(written(rows, name))


def in_seq(rows: DataFrame) -> DataFrame:
    """Records dealt out by ranges of ``seq``, so that files follow its order."""
    return rows.repartitionByRange("seq").sortWithinPartitions("seq")


@query("S12_jsonl_ledger", f"with {_EVENTS} select i as pos, rec, null::varchar problem from e")
def jsonl_ledger(spark, sf_dir):
    read = through(in_seq(sealed_events(spark, sf_dir).select(F.col("i").alias("seq"), F.col("rec").cast("binary").alias("rec"))), "sealed_jsonl")
    numbered = running(read, ["file", "at"], {"upto": ("sum", F.lit(1).cast("long"))})
    return numbered.select((F.col("upto") - 1).alias("pos"), F.decode("rec", "UTF-8").alias("rec"), "problem")


@query("S11_sqlite_ledger", f"with {_EVENTS} select i as seq, kind as type, 'n' || i nonce, rec, sha256('\\x02'::blob || rec::blob) rec_hash from e")
def sqlite_ledger(spark, sf_dir):
    e = sealed_events(spark, sf_dir)
    rows = e.select(F.col("i").alias("seq"), F.col("kind").alias("type"), F.concat(F.lit("n"), F.col("i").cast("string")).alias("nonce"), F.unhex(ledger.link_hash(F.col("rec"))).alias("rec_hash"), F.col("rec").cast("binary").alias("rec"))
    return through(in_seq(rows), "sealed_sqlite").select("seq", "type", "nonce", F.decode("rec", "UTF-8").alias("rec"), F.lower(F.hex("rec_hash")).alias("rec_hash"))


@query("S14_payloads", "select distinct sha256(text) address, octet_length(encode(text))::int n_bytes, null::varchar problem from documents where text is not null")
def payloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2(F.col("text").cast("binary"), 256).alias("address"), F.col("text").cast("binary").alias("data"))
    one = d.groupBy("address").agg(F.any_value("data").alias("data"))
    return through(one.repartitionByRange("address"), "sealed_payloads").select("address", F.octet_length("data").alias("n_bytes"), "problem")


@query("S01_coco", "select (l_orderkey * 10 + l_linenumber)::varchar annotation_id, 'o' || l_orderkey || '.jpg' file_name, case l_returnflag when 'A' then 'accepted' when 'N' then 'new' else 'returned' end category, l_quantity x, l_discount y, l_tax w, l_linenumber + 0.5e0 h, l_linestatus = 'F' iscrowd, o_orderpriority source from lineitem join orders on o_orderkey = l_orderkey")
def coco(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    no = F.lit(None)
    key = F.col("l_orderkey")
    images = o.select(F.lit("image").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("name"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("o_orderpriority").alias("source"))
    number = F.when(F.col("l_returnflag") == "A", "11").when(F.col("l_returnflag") == "N", "7").otherwise("3")
    notes = l.select(F.lit("annotation").alias("kind"), (key * 10 + F.col("l_linenumber")).cast("string").alias("id"), key.cast("string").alias("image_id"), number.alias("category_id"), F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber") + 0.5).alias("bbox"), (F.col("l_linestatus") == "F").alias("iscrowd"))
    names = spark.createDataFrame([("category", "11", "accepted"), ("category", "7", "new"), ("category", "3", "returned")], "kind string, id string, name string")
    columns = [c.split()[0] for c in formats.Coco.columns.split(", ")][:-1]
    kinds = dict(c.split() for c in formats.Coco.columns.split(", "))
    every = images.unionByName(notes, allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    for c in columns:
        every = every.withColumn(c, (F.col(c) if c in every.columns else no).cast(kinds[c]))
    at = written(every.select(columns), "coco")
    i, a, c = (spark.read.format("coco").option("kind", k).load(at).alias(k[0]) for k in ("image", "annotation", "category"))
    both = a.join(i, F.col("a.image_id") == F.col("i.id")).join(c, F.col("a.category_id") == F.col("c.id"))
    box = F.col("a.bbox")
    return both.select(F.col("a.id").alias("annotation_id"), F.col("i.name").alias("file_name"), F.col("c.name").alias("category"), *(box[k].alias(n) for k, n in enumerate("xywh")), F.col("a.iscrowd").alias("iscrowd"), F.col("i.source").alias("source"))


@query("S03_yolo", "select 's' || l_suppkey stem, (row_number() over (partition by l_suppkey order by l_linenumber, l_quantity, l_discount, l_tax))::int line, l_linenumber::bigint class_id, l_discount xc, l_tax yc, l_quantity / 50 w, l_quantity / 64 h, null::varchar problem from lineitem")
def yolo(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("stem"), F.col("l_linenumber").cast("long").alias("class_id"), F.col("l_discount").alias("xc"), F.col("l_tax").alias("yc"), (F.col("l_quantity") / 50).alias("w"), (F.col("l_quantity") / 64).alias("h"))
    return through(rows.repartition("stem").sortWithinPartitions("stem", "class_id", "w", "xc", "yc"), "yolo")


@query("S05_voc", "select c_custkey::varchar sample_id, c_name as name, 640 width, 480 height, o_orderpriority object, (o_orderkey % 600)::double x, (o_orderkey % 400)::double y, (o_custkey % 40)::double w, 7.5e0 h from customer join orders on o_custkey = c_custkey")
def voc(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = F.struct(F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 600).cast("double").alias("x"), (F.col("o_orderkey") % 400).cast("double").alias("y"), (F.col("o_custkey") % 40).cast("double").alias("w"), F.lit(7.5).alias("h"))
    objects = o.groupBy("o_custkey").agg(F.collect_list(one).alias("objects"))  # a file an image: its boxes are one row
    c = table(spark, sf_dir, "customer").join(objects, F.col("c_custkey") == F.col("o_custkey"), "left")
    read = through(c.select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_name").alias("name"), F.lit(640).alias("width"), F.lit(480).alias("height"), "objects"), "voc")
    return read.select("sample_id", "name", "width", "height", F.explode("objects").alias("o")).select("sample_id", "name", "width", "height", F.col("o.name").alias("object"), "o.x", "o.y", "o.w", "o.h")


_PNG = "89504E470D0A1A0A0000000D49484452"


@query("S06_image_folder", f"with s as (select *, unhex('{_PNG}' || printf('%08x', s_suppkey % 500 + 1) || printf('%08x', s_nationkey + 1) || '0802') || s_name::blob b from supplier) select 'i' || s_suppkey sample_id, 'n' || s_nationkey category, octet_length(b)::bigint length, sha256(b) content_sha256, (s_suppkey % 500 + 1)::int width, (s_nationkey + 1)::int height, null::varchar problem from s")
def image_folder(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    size = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    content = F.concat(F.unhex(F.concat(F.lit(_PNG), size(F.col("s_suppkey") % 500 + 1), size(F.col("s_nationkey") + 1), F.lit("0802"))), F.col("s_name").cast("binary"))
    return through(s.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("category"), F.concat(F.lit("i"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("name"), content.alias("content")), "image_folder")


@query("L02_appended_log", "select row_number() over (order by event_id % 3, event_id) - 1 seq, event_id, event_type from events")
def appended_log(spark, sf_dir):
    """Three batches of ``events``; the second comes twice, and the third is wanted by a writer that knows an old end."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    log = Log(spark, f"{checkpoint_dir(spark)}/veristrata-log-{uuid.uuid4().hex}")
    part = lambda k: e.where(F.col("event_id") % 3 == k)
    first = log.append(part(0), ["event_id"], "b0", expected=-1)
    second = log.append(part(1), ["event_id"], "b1", expected=first.next - 1)
    log.append(part(1), ["event_id"], "b1", expected=first.next - 1)
    try:
        log.append(part(0), ["event_id"], "late", expected=first.next - 1)
    except Conflict:
        log.append(part(2), ["event_id"], "b2", expected=second.next - 1)
    return log.read("event_id long, event_type string").select("seq", "event_id", "event_type")
