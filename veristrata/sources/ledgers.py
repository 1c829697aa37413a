"""Ledger files: strict JSON lines, SQLite exports, payload sidecars."""

from __future__ import annotations

import base64
import binascii
import json
import sqlite3
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import canonical

SQLITE_MAGIC = b"SQLite format 3\x00"
LINES = "path string, pos long, rec binary, problem string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its exact bytes; ``problem`` for blank or unterminated lines. A file is one ordered chain, so one task reads it, line by line."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                rows, lines = [], content.split(b"\n")
                tail = lines.pop()
                for i, line in enumerate(lines):
                    rows.append((p, i, line, None if line.strip() else "blank line"))
                if tail:
                    rows.append((p, len(lines), tail, "unterminated line"))
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=["path", "pos", "rec", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, LINES)


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``records`` in row order, with the file's own derived columns, from files that executors can open."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                rows = [(p, i, r[4] if isinstance(r[4], bytes) else str(r[4]).encode(), r[0], r[1], r[2], r[3] if isinstance(r[3], bytes) else None) for i, r in enumerate(db.execute("select seq, type, nonce, rec_hash, rec from records order by rowid"))]
                db.close()
                yield pd.DataFrame(rows, columns=["path", "pos", "rec", "seq", "type", "nonce", "rec_hash"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pos long, rec binary, seq long, type string, nonce string, rec_hash binary")


def sniff(head: bytes) -> str:
    return "sqlite" if head.startswith(SQLITE_MAGIC) else "jsonl"


def export_jsonl(ledger: DataFrame, out: str) -> None:
    """Verbatim records, one a line, in order: the files' names follow the order of ``seq``."""
    ledger.select("seq", F.decode("rec", "UTF-8").alias("value")).repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(out)


def strict_payload(line: str) -> tuple[str, bytes] | None:
    """(address, bytes) of a payload line; None if it isn't exactly that, or its bytes don't hash to the address."""
    import hashlib

    try:
        doc = canonical.parse(line.encode())
        data = base64.b64decode(doc["b64"], validate=True)
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None
    return (doc["address"], data) if set(doc) == {"address", "b64"} and hashlib.sha256(data).hexdigest() == doc["address"] else None


def write_payloads(payloads: DataFrame, out: str) -> None:
    """``address`` and ``data`` as lines, ordered by address."""
    line = F.concat(F.lit('{"address":"'), "address", F.lit('","b64":"'), F.base64("data"), F.lit('"}'))
    payloads.repartitionByRange("address").sortWithinPartitions("address").select(line.alias("value")).write.text(out)


def sections(ledger: DataFrame) -> DataFrame:
    """Header fields of each record as columns, by a schema. Strictness is ``canonical.parse``'s task, not this one's."""
    header = "v int, type string, seq bigint, prev_record_hash string, key_id string, created_at_utc string, nonce string, signature string"
    return ledger.withColumn("h", F.from_json(F.decode("rec", "UTF-8"), header)).select("*", "h.*").drop("h")


def dumps(record: dict) -> bytes:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()
