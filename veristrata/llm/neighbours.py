"""Approximate nearest neighbours (operator 2): anisotropic four-bit codes.

Nearness by Euclidean distance is maximum inner product with a row's own norm
taken off: |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2). Distances don't change when
all vectors are moved, so the sample's mean is the origin. A row is its norm,
held exactly, and its direction, which is coded: it is cut into subspaces of
``WIDTH`` dimensions, and each part is coded by one of 16 centres (four bits).
The centres are fitted with a score-aware loss: of the residual u - c(u), what
is parallel to u costs ``eta`` times as much as what is orthogonal to it, as it
changes large inner products most. A part's code depends on the other parts'
through the parallel residual, so encoding goes over the subspaces twice.

A search holds one table of 16 partial scores a subspace for each query, adds
the entries that the codes name (two subspaces at a time, one table of 256), and
keeps the best rows of a block for exact reranking on the original vectors in
double precision. Each task hands on its exact best, and these are merged by a
window whose limit is applied before the shuffle too.

How many rows of a block are reranked is measured when the index is built: rows
of the sample are searched in a full block of it, and ``keep`` is raised until
``RECALL`` of their true nearest are among the rows kept. Where codes tell
little, it rises to the whole block, and the search is exact.

Scale: centres are fitted on a bounded sample (``SAMPLE``); every row is coded,
once, into the index table. Queries are a stated set; they go in blocks of
``QUERY_BYTES`` against all rows. One block at a time is in the driver and
broadcast, its results are written, and the broadcast is dropped, so neither
plan nor driver grows with the number of queries. Copies of a vector are scored
once in a block and expanded by ascending id after reranking, so that a group of
copies neither fills the list nor loses its smallest ids.

Defined results: vectors that are null, empty, zero, of another length than
most rows, or hold null or non-finite parts take no part; equal distances go
to the smaller id; repeated rows count as often as they occur; a repeated query
id is searched once, by the smallest of its vectors; with fewer candidates than
asked for, all are returned; rows of null id take no part.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import checkpoint_folder, in_blocks, stored

WIDTH, CENTRES = 2, 16
#: The sample that centres are fitted on, and the fit's passes.
SAMPLE, PASSES = 8_192, 8
#: Inner products above this share of |x| matter to the loss.
THRESHOLD = 0.2
#: Rows of a block, of which this many at least are reranked.
ROWS, KEEP = 8192, 96
#: Share of the sample's true nearest that the rows kept must hold, and the sample's rows that are searched to see it.
RECALL, PROBES = 0.98, 256
#: Queries that are broadcast at once, in bytes, and those that a task scores at once.
QUERY_BYTES, QUERIES = 16 << 20, 256


@dataclass
class Codebook:
    """Centres of every subspace: (subspaces, CENTRES, WIDTH). ``origin`` is the sample's mean; ``keep`` rows of a block are reranked."""

    centres: np.ndarray
    origin: np.ndarray
    eta: float
    keep: int = KEEP

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Directions from the origin, cut into subspaces: (rows, subspaces, WIDTH), and their lengths."""
        moved = x - self.origin
        norm = np.sqrt(np.einsum("ij,ij->i", moved, moved))
        return self.cut(moved / np.maximum(norm, 1e-300)[:, None]), norm

    def cut(self, x: np.ndarray) -> np.ndarray:
        pad = self.centres.shape[0] * WIDTH - x.shape[1]
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, WIDTH)


def _parallel(parts: np.ndarray) -> np.ndarray:
    """Unit directions of the whole vectors, in subspaces."""
    norm = np.sqrt(np.einsum("nsw,nsw->n", parts, parts))
    return parts / np.maximum(norm, 1e-30)[:, None, None]


def assign(parts: np.ndarray, centres: np.ndarray, eta: float) -> np.ndarray:
    """Codes that lower the score-aware loss, by coordinate descent over subspaces."""
    n, subspaces, _ = parts.shape
    unit = _parallel(parts)
    plain = ((parts[:, :, None, :] - centres[None]) ** 2).sum(axis=3)
    codes = plain.argmin(axis=2).astype(np.uint8)
    # residual's component along x, of each subspace and centre
    along = np.einsum("nsw,nsw->ns", parts, unit)[:, :, None] - np.einsum("nsw,scw->nsc", unit, centres)
    rows = np.arange(n)
    total = along[rows[:, None], np.arange(subspaces)[None], codes].sum(axis=1)
    for _ in range(2):
        for s in range(subspaces):
            rest = total - along[rows, s, codes[:, s]]
            cost = plain[:, s] + (eta - 1) * (rest[:, None] + along[:, s]) ** 2
            codes[:, s] = cost.argmin(axis=1)
            total = rest + along[rows, s, codes[:, s]]
    return codes


def fit(x: np.ndarray, dim: int, seed: int = 7) -> Codebook:
    """Centres from a sample, alternating codes and weighted least squares under the score-aware loss."""
    subspaces = math.ceil(dim / WIDTH)
    eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    book = Codebook(np.zeros((subspaces, CENTRES, WIDTH)), x.mean(axis=0) if len(x) else np.zeros(dim), eta)
    if not len(x):
        return book
    parts, _ = book.parts(x)
    rng = np.random.default_rng(seed)
    for s in range(subspaces):
        values = np.unique(parts[:, s], axis=0)
        picked = values[rng.choice(len(values), min(CENTRES, len(values)), replace=False)]
        book.centres[s, : len(picked)] = picked
        book.centres[s, len(picked) :] = picked[0]
    unit = _parallel(parts)
    for _ in range(PASSES):
        codes = assign(parts, book.centres, eta)
        chosen = book.centres[np.arange(subspaces)[None], codes]
        total = np.einsum("nsw,nsw->n", parts - chosen, unit)
        for s in range(subspaces):
            u = unit[:, s]
            rest = total - np.einsum("nw,nw->n", parts[:, s] - chosen[:, s], u)
            # minimise |p - c|^2 + (eta - 1) (rest + u.(p - c))^2 over c
            right = parts[:, s] + (eta - 1) * (rest + np.einsum("nw,nw->n", parts[:, s], u))[:, None] * u
            left = np.eye(WIDTH)[None] + (eta - 1) * u[:, :, None] * u[:, None, :]
            for c in range(CENTRES):
                mine = codes[:, s] == c
                if mine.any():
                    book.centres[s, c] = np.linalg.solve(left[mine].sum(axis=0) + 1e-9 * np.eye(WIDTH), right[mine].sum(axis=0))
    book.keep = kept_for(book, x)
    return book


def kept_for(book: Codebook, x: np.ndarray, k: int = 10) -> int:
    """The least number of rows of a block, ``KEEP`` at least, among which ``RECALL`` of some sampled rows' nearest ``k`` are."""
    x = x[distinct(x)[0]]
    if len(x) <= KEEP:
        return KEEP
    places = []
    codes, norm = encode(book, x)
    probes = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
    scores = scan(codes, norm, tables(book, x[probes])).T
    for i, score in zip(probes, scores, strict=True):
        d = x - x[i]
        near = np.einsum("ij,ij->i", d, d)
        near[i] = np.inf
        true = np.argpartition(near, min(k, len(x) - 1) - 1)[:k]
        places.append(np.array([(score >= score[j]).sum() for j in true]))
    return int(min(ROWS, max(KEEP, math.ceil(np.quantile(np.concatenate(places), RECALL)))))


def encode(book: Codebook, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and norms."""
    parts, norm = book.parts(x)
    return pack_codes(assign(parts, book.centres, book.eta)), norm


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, 0::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


def tables(book: Codebook, queries: np.ndarray) -> np.ndarray:
    """Partial scores of each pair of subspaces: (byte places, 256, queries), single precision."""
    one = np.einsum("qsw,scw->scq", book.cut(queries - book.origin), book.centres)
    if book.centres.shape[0] % 2:
        one = np.concatenate([one, np.zeros((1, CENTRES, len(queries)))])
    low, high = one[0::2], one[1::2]
    return (low[:, None, :, :] + high[:, :, None, :]).reshape(len(low), 256, len(queries)).astype(np.float32)


def scan(codes: np.ndarray, norm: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Approximate scores (rows, queries), q.x - |x|^2 / 2, by table look-ups on packed codes."""
    out = table[0][codes[:, 0]]
    for place in range(1, codes.shape[1]):
        out += table[place][codes[:, place]]
    out *= norm[:, None].astype(np.float32)
    out -= (0.5 * norm * norm)[:, None].astype(np.float32)
    return out


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal rows, in order of their first: that row, all rows by class, and each class's start and size among these."""
    whole = np.ascontiguousarray(x + 0.0)  # negative zeros are zeros
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in whole], dtype=np.int64)
    of = np.argsort(kind, kind="stable")
    size = np.bincount(kind)
    start = np.cumsum(size) - size
    return of[start], of, start, size


def largest(score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` largest; ties to the smaller place."""
    if len(score) <= keep:
        return np.arange(len(score))
    least = np.partition(score, len(score) - keep)[len(score) - keep]
    above = np.flatnonzero(score > least)
    return np.concatenate([above, np.flatnonzero(score == least)[: keep - len(above)]])


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (array of double) of the rows that take part, whatever their length."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def dimension(rows: DataFrame) -> int:
    """The most frequent length; ties to the smaller."""
    first = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(first["d"]) if first else 0


def build_index(rows: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Codebook]:
    """Fit the centres and code every row: ``id``, ``vector``, ``codes`` (binary)."""
    known = usable(rows)
    dim = dimension(known)
    known = known.where(F.size("vector") == dim)
    drawn = known.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample).collect()
    book = fit(np.array([r["vector"] for r in drawn]).reshape(len(drawn), dim), dim)

    def code(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[i : i + 4096] for i in range(0, len(batch), 4096)):
                packed, _ = encode(book, np.stack(part["vector"].to_numpy()))
                yield pd.DataFrame({"id": part["id"], "vector": part["vector"], "codes": [c.tobytes() for c in packed]})

    return known.mapInPandas(code, "id long, vector array<double>, codes binary"), book


def merge(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of two lists of (distances, ids); ties to the smaller id."""
    distance, ids = np.concatenate([old[0], new[0]]), np.concatenate([old[1], new[1]])
    top = np.lexsort((ids, distance))[:k]
    return distance[top], ids[top]


def search_block(index: DataFrame, book: Codebook, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Every task's ``k`` nearest of each query of one block: ``query_id``, ``vec_id``, ``score``."""
    shared = index.sparkSession.sparkContext.broadcast((ids, queries))  # at most QUERY_BYTES

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        nearest = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        for rows in in_blocks(batches, ROWS):
            rows = rows.sort_values("id", kind="stable")
            own, x = rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy())
            first, of, start, size = distinct(x)
            # of a class, k rows besides the query's own can go on
            size = np.minimum(size, k + int(np.unique(own, return_counts=True)[1].max()))
            x = x[first]
            packed = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1)[first]
            _, norm = book.parts(x)
            for at in range(0, len(ids), QUERIES):
                scores = np.ascontiguousarray(scan(packed, norm, tables(book, q[at : at + QUERIES])).T)
                for j, score in enumerate(scores, at):
                    nearest[j] = merge(nearest[j], best(score, ids[j], q[j], own, x, of, start, size), k)
        yield pd.DataFrame({"query_id": np.repeat(ids, [len(d) for d, _ in nearest]), "vec_id": np.concatenate([i for _, i in nearest]), "score": np.concatenate([d for d, _ in nearest])})

    def best(score: np.ndarray, id_: int, q: np.ndarray, own: np.ndarray, x: np.ndarray, of: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact reranking of a query's ``keep`` best distinct vectors of a block."""
        picked = largest(score, book.keep)
        d = x[picked] - q
        distance = np.repeat(np.sqrt(np.einsum("ij,ij->i", d, d)), size[picked])
        ends = np.cumsum(size[picked])
        rows = of[np.repeat(start[picked] - ends + size[picked], size[picked]) + np.arange(ends[-1])]
        other = own[rows] != id_
        return distance[other], own[rows][other]

    return index.mapInPandas(run, "query_id long, vec_id long, score double")


def search(index: DataFrame, book: Codebook, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest found of every query: ``query_id``, ``rank``, ``vec_id``, ``score`` (distance). ``queries``: id, vector."""
    spark = index.sparkSession
    held = max(1, QUERY_BYTES // (8 * max(1, len(book.origin))))
    blocks = math.ceil(queries.count() / (0.9 * held))
    path = f"{checkpoint_folder(spark)}/veristrata-nearest-{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, blocks)))
    spark.createDataFrame([], "query_id long, vec_id long, score double").write.parquet(path)
    for b in range(blocks):
        rows = queries.where(number == b).orderBy("id").toPandas()  # at most ``held`` rows on average
        for at in range(0, len(rows), held):
            part = rows.iloc[at : at + held]
            search_block(index, book, part["id"].to_numpy(), np.stack(part["vector"].to_numpy()), k).write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_hundredth(rows: DataFrame, k: int = 10) -> DataFrame:
    """The query: rows whose id is divisible by 100, against all others."""
    index, book = build_index(rows)
    index = stored(index, "vectors")
    queries = stored(index.where("id % 100 = 0").groupBy("id").agg(F.min("vector").alias("vector")), "queries")  # read once a block
    return search(index, book, queries, k)
