"""Packing token sequences (operator 8).

Documents become token ids with an end id, are cut into blocks of the sequence
length, and the pieces are placed by first-fit decreasing. The first bin with
room is found in a tournament tree over the bins' free capacities: each inner
node holds the larger capacity of its two children, so the leftmost bin that
fits is one walk from the root. Groups of documents, drawn by a hash, are packed
independently; a group's size in documents is fixed, so memory in a task and
the padding share don't depend on the corpus.

Defined results: a null or empty text is a document of the end id alone; very
long texts give many full sequences; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm import bpe
from veristrata.llm.common import in_batches

#: Documents of a group: some ten thousand pieces, 1 MB in a task.
GROUP_DOCS = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class TournamentTree:
    """Leftmost bin with enough free capacity, in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin that holds it; that bin's number."""
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        free[node] -= size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            a, b = free[2 * node], free[2 * node + 1]
            best = a if a > b else b
            if free[node] == best:
                break
            free[node] = best
        return bin_


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every length, and its offset there. Ties keep the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree = TournamentTree(len(lengths), capacity)
    filled: dict[int, int] = {}
    for i in order:
        size = int(lengths[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, filled.get(b, 0)
        filled[b] = filled.get(b, 0) + size
    return bins, offsets


def pieces(docs: DataFrame, length: int = 4096, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document, with ``ids`` (binary) if asked for."""
    path = tokenizer or bpe.default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = bpe.load(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                ids = codec.encode(text) + end
                for at in range(0, len(ids), 4 * length):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, length: int = 4096, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; a sequence is padded to ``length``."""
    groups = max(1, math.ceil(docs.count() / group_docs))
    cut = pieces(docs, length, end_id, tokenizer, with_ids).withColumn("group", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", F.when(F.col("doc_id").isNull(), F.col("ids_crc32"))), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "doc_tokens", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        return part.assign(sequence_id=(part["group"].to_numpy() << 32) + bins, offset=offsets).drop(columns="group")

    return cut.groupBy("group").applyInPandas(run, PIECES + (", ids binary" if with_ids else "") + ", sequence_id long, offset long")
