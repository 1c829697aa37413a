"""Guards before files are trusted: paths, JSON shape, artefacts, access, embedding archives."""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# JSON limits, and the domains of standard graph operators.
MOST_BYTES, MOST_DEPTH, MOST_ITEMS = 8 << 20, 64, 1_000_000
STANDARD_DOMAINS = ("", "ai.onnx", "ai.onnx.ml")


def safe_join(root: str, name: str) -> str:
    """``name`` below ``root``; a name that leads out of it is refused."""
    if name.startswith(("/", "~")) or "\x00" in name or "\\" in name:
        raise ValueError(f"{name!r} isn't below the root")
    path = posixpath.normpath(posixpath.join(root, name))
    if path != root.rstrip("/") and not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{name!r} isn't below the root")
    return path


def json_problem(data: bytes, most_bytes: int = MOST_BYTES, depth: int = MOST_DEPTH, items: int = MOST_ITEMS) -> str | None:
    """Size, nesting or number of parts beyond the limits, told from brackets and commas outside strings, before anything is parsed."""
    if len(data) > most_bytes:
        return "too large"
    level = count = 0
    in_string = escaped = False
    for b in data:
        if in_string:
            if escaped:
                escaped = False
            elif b == 0x5C:
                escaped = True
            elif b == 0x22:
                in_string = False
        elif b == 0x22:
            in_string = True
        elif b in (0x5B, 0x7B):
            level += 1
            count += 1
            if level > depth:
                return "too deep"
        elif b in (0x5D, 0x7D):
            level -= 1
        elif b == 0x2C:
            count += 1
        if count > items:
            return "too many items"
    return None


def prescan(nodes: DataFrame) -> DataFrame:
    """Operators of a graph from outside the standard domains. ``nodes``: domain, op_type."""
    return nodes.where(~F.coalesce("domain", F.lit("")).isin(*STANDARD_DOMAINS)).groupBy("domain", "op_type").agg(F.count("*").alias("n"))


def allowed(rows: DataFrame, policy: DataFrame, forbidden: Iterable[str] = ()) -> DataFrame:
    """``allowed`` for each request: its user may write its type, and the type isn't forbidden to all. ``rows``: uid, type; ``policy``: uid, type."""
    known = policy.select("uid", "type").distinct().withColumn("__ok", F.lit(True))
    ban: Column = F.col("type").isin(*list(forbidden)) if list(forbidden) else F.lit(False)
    return rows.join(known, ["uid", "type"], "left").withColumn("allowed", F.coalesce("__ok", F.lit(False)) & ~ban).drop("__ok")


def read_npz(spark: SparkSession, path: str, ids: str = "ids", vectors: str = "embeddings") -> DataFrame:
    """Embeddings of .npz archives: pos, sample_id, vector. Pickled parts are refused; a length mismatch or a non-finite part is an error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    who, x = z[ids].astype(str), z[vectors].astype(np.float32)
                if x.ndim != 2 or len(who) != len(x) or not np.isfinite(x).all():
                    raise ValueError(f"{name}: ids and finite vectors don't match")
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pd.DataFrame({"pos": np.arange(at, at + len(part)), "sample_id": who[at : at + len(part)], "vector": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "pos long, sample_id string, vector array<float>")


def order_mismatch(vectors: DataFrame, samples: DataFrame) -> DataFrame:
    """Positions where an archive's ids aren't the set's. Both: pos, sample_id."""
    a, b = vectors.select("pos", F.col("sample_id").alias("a")), samples.select("pos", F.col("sample_id").alias("b"))
    return a.join(b, "pos", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def predict(rows: DataFrame, model, out: str = "array<double>", batch: int = 64) -> DataFrame:
    """Scores of a query-only model, ``model(array of inputs) -> array``, which each task makes its own copy of. ``rows``: id, vector."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in (b.iloc[i : i + batch] for i in range(0, len(b), batch)):
                got = np.asarray(model(np.stack(part["vector"].to_numpy())))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "scores": list(got.astype(float))})

    return rows.select("id", "vector").mapInPandas(run, f"id long, scores {out}")
