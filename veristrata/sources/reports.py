"""Reports, evidence, caches and small trusted files."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import canonical
from veristrata.plans.capability import FINDING

SCAN_ID = re.compile(r"^scan-[0-9]{8}-[0-9]{4}$")
MOST_BYTES = 8 << 20


def scan_id(day: str, number: int) -> str:
    return f"scan-{day}-{number:04d}"


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def reserve(spark: SparkSession, path: str) -> None:
    """Take an output folder for this run; one that is there already is refused."""
    p, fs = _filesystem(spark, path)
    if fs.exists(p) or not fs.mkdirs(p):
        raise FileExistsError(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, never over another one."""
    p, fs = _filesystem(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str, most: int = MOST_BYTES) -> str:
    row = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= most, F.col("content")).alias("content")).first()
    if row is None or row["content"] is None:
        raise ValueError(f"{path} is missing or larger than {most} bytes")
    return bytes(row["content"]).decode("utf-8")


def report(scan: str, findings: DataFrame, plan: list[dict], verdict: str, limitations: Iterable[str] = (), evidence_cap: int = 20) -> dict:
    """The report of one scan: findings in a fixed order, each with at most ``evidence_cap`` pieces of evidence; facts that are absent are absent keys."""
    rows = findings.withColumn("evidence", F.slice("evidence", 1, evidence_cap)).orderBy("detector_id", "finding_id").select(F.to_json(F.struct(*findings.columns)).alias("j")).collect()
    return {"scan_id": scan, "verdict": verdict, "plan": plan, "findings": [json.loads(r["j"]) for r in rows], "limitations": list(dict.fromkeys(limitations))}


def write_report(spark: SparkSession, path: str, doc: dict) -> None:
    write_text(spark, f"{path}/report.json", json.dumps(doc, sort_keys=True, indent=1, ensure_ascii=False))
    write_text(spark, f"{path}/report.html", to_html(doc))
    write_text(spark, f"{path}/coverage.md", to_markdown(doc))


def to_html(doc: dict) -> str:
    cells = "".join(f"<tr><td>{html.escape(f.get('severity', ''))}</td><td>{html.escape(f.get('detector_id', ''))}</td><td>{html.escape(f.get('target_ref', ''))}</td><td>{html.escape(f.get('reason', ''))}</td></tr>" for f in doc["findings"])
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(doc['scan_id'])}</title><h1>{html.escape(doc['verdict'])}</h1><table>{cells}</table>"


def to_markdown(doc: dict) -> str:
    lines = ["| check | decision | reason |", "|---|---|---|", *(f"| {p['detector_id']} | {p['decision']} | {p['reason']} |" for p in doc["plan"])]
    return "\n".join([*lines, "", *(f"- {x}" for x in doc["limitations"])]) + "\n"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Reports under ``root``: path, scan_id, report (JSON text), problem. A folder's name must be the report's own id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").load(root)
    named = files.select("path", F.element_at(F.split("path", "/"), -2).alias("scan_id"), F.decode("content", "UTF-8").alias("report"))
    inside = F.get_json_object("report", "$.scan_id")
    problem = F.when(~F.col("scan_id").rlike(SCAN_ID.pattern), "bad name").when(inside.isNull(), "unreadable").when(inside != F.col("scan_id"), "id doesn't match")
    return named.withColumn("problem", problem)


def findings_of(reports: DataFrame) -> DataFrame:
    """The findings of sound reports, by the one schema."""
    return reports.where("problem is null").select(F.explode(F.from_json(F.get_json_object("report", "$.findings"), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _fields())}>>")).alias("f")).select("f.*")


def _fields() -> list[str]:
    return re.split(r", (?=[a-z_]+ [a-z])", FINDING)


def write_evidence(rows: DataFrame, out: str) -> None:
    """Content-addressed: each different content once, in partitions by the address's head. ``rows``: content (binary), kind."""
    addressed = rows.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"]).withColumn("head", F.left("sha256", F.lit(2)))
    try:
        known = rows.sparkSession.read.parquet(out).select("sha256")
        addressed = addressed.join(known, "sha256", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    addressed.write.mode("append").partitionBy("head").parquet(out)


def through_cache(keys: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows to append to the cache): what the cache lacks or holds broken is computed. Both: key, value."""
    sound = cache.where("value is not null").dropDuplicates(["key"])
    fresh = compute(keys.join(sound.select("key"), "key", "left_anti"))
    return keys.join(sound, "key").select("key", "value").unionByName(fresh.select("key", "value")), fresh


def read_calibration(text: str) -> list[tuple[str, list[float], list[float]]]:
    """Rows of a calibration file: detector, edges, levels. Repeated keys, unsorted edges and levels outside 0 to 1 are refused."""
    doc = json.loads(text, object_pairs_hook=canonical._pairs)
    out = []
    for name, c in sorted(doc["detectors"].items()):
        edges, levels = [float(x) for x in c["edges"]], [float(x) for x in c["levels"]]
        if len(edges) != len(levels) or not edges or edges != sorted(set(edges)) or levels != sorted(levels) or not 0 <= levels[0] <= levels[-1] <= 1:
            raise ValueError(f"bad calibration of {name}")
        out.append((name, edges, levels))
    return out


def write_calibration(rows: Iterable[tuple[str, list[float], list[float]]]) -> str:
    return json.dumps({"detectors": {n: {"edges": list(e), "levels": list(v)} for n, e, v in rows}}, sort_keys=True)


def trust_root(text: str) -> dict[str, list[bytes]]:
    """Public keys by role."""
    doc = canonical.parse(text.strip().encode())
    return {role: [bytes.fromhex(k) for k in keys] for role, keys in doc["keys"].items()}


def standing_limitations(text: str, generated: Iterable[str]) -> list[str]:
    """Reviewed lines (one each, ``#`` for comments) after the generated ones, each once."""
    reviewed = [line.strip() for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    return list(dict.fromkeys([*generated, *reviewed]))


def reference_manifest(model_id: str, digest: str, architecture: str, fingerprint: Iterable[tuple[str, float]]) -> str:
    """Fingerprint values go in as whole millionths, which canonical JSON can hold."""
    import math

    return canonical.encode({"model_id": model_id, "digest": digest, "architecture": architecture, "fingerprint": {p: math.floor(v * 1_000_000 + 0.5) for p, v in fingerprint}}).decode()
