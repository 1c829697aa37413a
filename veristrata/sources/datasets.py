"""Annotated image sets as DataFrames. Pixels aren't decoded; sizes come from the manifests or from image headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = "sample_id string, path string, width int, height int, contributor string, batch string, labels array<struct<category_id:int,x:double,y:double,w:double,h:double,iscrowd:boolean,label_id:string>>"
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".gif", ".tif", ".tiff")
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int,source:string,batch:string>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,iscrowd:int>>, categories array<struct<id:bigint,name:string>>"
)
#: Where a COCO manifest is looked for, at the root and in annotations/.
COCO_NAMES = ("instances.json", "annotations.json", "_annotations.coco.json")
VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
VOC_BYTES = 1 << 20


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, so any store will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def coco_manifest(spark: SparkSession, root: str) -> str | None:
    return next((p for d in (root, f"{root}/annotations") for n in COCO_NAMES if exists(spark, p := f"{d}/{n}")), None)


def dense_categories(categories: DataFrame) -> DataFrame:
    """Dense ids from 0: whole-number source ids in order, then the others. ``categories``: source_id (string), name."""
    from pyspark.sql import Window

    number = F.try_to_number("source_id", F.lit("S9999999999")).cast("long")
    order = Window.orderBy(number.isNull(), number, "source_id")
    return categories.distinct().withColumn("category_id", (F.dense_rank().over(order) - 1).cast("int"))


def read_coco(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(samples, categories). Images without a name and annotations of unknown categories are left out."""
    doc = spark.read.schema(COCO).option("multiLine", True).json(manifest)
    cats = dense_categories(doc.select(F.explode("categories").alias("c")).select(F.col("c.id").cast("string").alias("source_id"), "c.name"))
    images = doc.select(F.explode("images").alias("i")).select("i.*").where("file_name is not null and file_name <> ''")
    notes = doc.select(F.explode("annotations").alias("a")).select("a.*").where("size(bbox) = 4")
    known = notes.join(cats, notes["category_id"].cast("string") == cats["source_id"]).select(
        "image_id", F.struct(cats["category_id"], F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), F.col("bbox")[2].alias("w"), F.col("bbox")[3].alias("h"), (F.coalesce("iscrowd", F.lit(0)) != 0).alias("iscrowd"), notes["id"].cast("string").alias("label_id")).alias("label")
    )
    labels = known.groupBy("image_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    joined = images.join(labels, images["id"] == labels["image_id"], "left")
    empty = F.array().cast("array<struct<category_id:int,x:double,y:double,w:double,h:double,iscrowd:boolean,label_id:string>>")
    return joined.select(F.col("id").cast("string").alias("sample_id"), F.col("file_name").alias("path"), "width", "height", F.col("source").alias("contributor"), "batch", F.coalesce("labels", empty).alias("labels")), cats


def yolo_box(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Centre form in shares to top-left form in pixels."""
    return F.struct(((xc - w / 2) * width).alias("x"), ((yc - h / 2) * height).alias("y"), (w * width).alias("w"), (h * height).alias("h"))


def yolo_row(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The inverse, as text."""
    return F.format_string("%.6f %.6f %.6f %.6f", (x + w / 2) / width, (y + h / 2) / height, w / width, h / height)


def voc_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """1-based inclusive corners to 0-based top-left form."""
    return F.struct((xmin - 1).alias("x"), (ymin - 1).alias("y"), (xmax - xmin + 1).alias("w"), (ymax - ymin + 1).alias("h"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def read_yolo(spark: SparkSession, root: str, sizes: DataFrame | None = None) -> DataFrame:
    """Boxes of ``labels/*.txt``: stem, class_id, x, y, w, h (pixels where ``sizes`` has the stem, else shares). Short and odd lines are skipped."""
    lines = spark.read.text(f"{root}/labels").select(stem(F.col("_metadata.file_path")).alias("stem"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 5)
    parts = [F.expr("try_cast(p[0] as int)").alias("class_id"), *(F.expr(f"try_cast(p[{i}] as double)").alias(n) for i, n in enumerate(("xc", "yc", "bw", "bh"), 1))]
    ok = lines.select("stem", *parts).dropna()
    if sizes is None:
        return ok.select("stem", "class_id", (F.col("xc") - F.col("bw") / 2).alias("x"), (F.col("yc") - F.col("bh") / 2).alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"))
    both = ok.join(sizes, "stem", "left").withColumn("b", yolo_box(F.col("xc"), F.col("yc"), F.col("bw"), F.col("bh"), F.coalesce("width", F.lit(1)), F.coalesce("height", F.lit(1))))
    return both.select("stem", "class_id", "b.x", "b.y", "b.w", "b.h")


def write_yolo(boxes: DataFrame, out: str) -> None:
    """One text file group a stem: class and box in shares. ``boxes``: stem, class_id, x, y, w, h, width, height."""
    row = F.concat_ws(" ", F.col("class_id").cast("string"), yolo_row(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height"))))
    boxes.select("stem", row.alias("value")).repartition("stem").sortWithinPartitions("stem", "value").write.partitionBy("stem").text(out)


def read_voc(spark: SparkSession, root: str) -> DataFrame:
    """Samples of ``Annotations/*.xml``. Files with a DTD, or over a megabyte, are refused: they give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(f"{root}/Annotations").where(F.col("length") <= VOC_BYTES)
    text = F.decode("content", "UTF-8")
    safe = files.select("path", text.alias("xml")).where(~F.col("xml").contains("<!DOCTYPE") & ~F.col("xml").contains("<!ENTITY"))
    doc = safe.withColumn("d", F.from_xml("xml", VOC)).where("d is not null")
    box = F.transform("d.object", lambda o: F.struct(o["name"].alias("name"), voc_box(o["bndbox"]["xmin"], o["bndbox"]["ymin"], o["bndbox"]["xmax"], o["bndbox"]["ymax"]).alias("box")))
    return doc.select(stem(F.col("path")).alias("sample_id"), F.col("d.filename").alias("path"), F.col("d.size.width").alias("width"), F.col("d.size.height").alias("height"), F.coalesce(box, F.array().cast("array<struct<name:string,box:struct<x:double,y:double,w:double,h:double>>>")).alias("objects"))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Class by folder: sample_id, path, category, content_sha256, length, and size from the header."""
    glob = "*.{" + ",".join(e[1:] for e in IMAGES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    size = image_size("content")
    return files.select(F.sha2("content", 256).alias("content_sha256"), "path", "length", F.element_at(F.split("path", "/"), -2).alias("category"), stem(F.col("path")).alias("sample_id"), size["width"].alias("width"), size["height"].alias("height"))


def header_size(data: bytes | None, most_pixels: int = 89_478_485) -> tuple[int, int] | None:
    """(width, height) from a PNG, GIF, BMP or JPEG header; None if unreadable or above the pixel budget."""
    size = None
    if data is None:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        size = struct.unpack(">II", data[16:24])
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        size = struct.unpack("<HH", data[6:10])
    elif data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        size = (w, abs(h))
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                size = (w, h)
                break
            at += 2 + length
    return size if size and size[0] > 0 and size[1] > 0 and size[0] * size[1] <= most_pixels else None


def image_size(content: str) -> Column:
    @F.pandas_udf("width int, height int")
    def sizes(data: pd.Series) -> pd.DataFrame:
        found = [header_size(d) for d in data]
        return pd.DataFrame({"width": pd.array([f[0] if f else None for f in found], dtype="Int32"), "height": pd.array([f[1] if f else None for f in found], dtype="Int32")})

    return sizes(F.substring(content, 1, 65536))


def detect(spark: SparkSession, root: str) -> str:
    """coco, yolo, voc or folder, in that order."""
    if coco_manifest(spark, root):
        return "coco"
    if exists(spark, f"{root}/labels") and exists(spark, f"{root}/images"):
        return "yolo"
    return "voc" if exists(spark, f"{root}/Annotations") else "folder"


def annotations(samples: DataFrame) -> DataFrame:
    """One row a label: annotation_id, sample_id, category_id and box; never stored."""
    each = samples.select("sample_id", F.posexplode("labels").alias("pos", "l"))
    return each.select(F.coalesce("l.label_id", F.concat("sample_id", F.lit(":"), F.col("pos").cast("string"))).alias("annotation_id"), "sample_id", "l.category_id", "l.x", "l.y", "l.w", "l.h", "l.iscrowd")


def resolve_contributor(samples: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """``contributor`` and ``tier``: a sidecar entry (by name or stem), a contributor folder, the format's own field, or none."""
    folder = F.nullif(F.regexp_extract("path", r"(?:^|/)contributor[_-]([^/]+)/", 1), F.lit(""))
    own = F.nullif(F.col("contributor"), F.lit(""))
    if sidecar is not None:
        keys = sidecar.select(F.explode(F.array_distinct(F.array(F.col("name"), F.element_at(F.split("name", "/"), -1), stem(F.col("name"))))).alias("__key"), F.col("contributor").alias("__side")).groupBy("__key").agg(F.min("__side").alias("__side"))
        samples = samples.join(keys, stem(F.col("path")) == F.col("__key"), "left")
    else:
        samples = samples.withColumn("__side", F.lit(None).cast("string"))
    return samples.withColumn("tier", F.when(F.col("__side").isNotNull(), "sidecar").when(folder.isNotNull(), "directory").when(own.isNotNull(), "format").otherwise("none")).withColumn("contributor", F.coalesce("__side", folder, own)).drop("__side", "__key")


def resolve_batch(path: Column, declared: Column) -> Column:
    """The declared batch, else the innermost batch_ or source_ folder; cleaned, at most 128 characters."""
    folders = F.filter(F.reverse(F.split(path, "/")), lambda p: p.startswith("batch_") | p.startswith("source_"))
    chosen = F.coalesce(F.nullif(declared, F.lit("")), F.get(folders, F.lit(0)))
    return F.left(F.trim(F.regexp_replace(chosen, r"\p{C}", "_")), F.lit(128))


def capabilities(samples: DataFrame) -> DataFrame:
    """What a set can support, in one pass."""
    return samples.agg(F.bool_or(F.col("width").isNotNull() & F.col("height").isNotNull()).alias("images"), F.bool_or(F.size("labels") > 0).alias("labels"), F.bool_or(F.col("contributor").isNotNull()).alias("contributors"))
