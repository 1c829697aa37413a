"""Similarity joins, nearest neighbours, clusters and what is told from them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from veristrata.operators.graph import connected_components
from veristrata.operators.running import quantiles
from veristrata.sources.session import cut

#: Bits of the text profile hash: letters above their mean share, letters mostly in the first half, frequent pairs.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
PAIRS = ("th", "er", "on", "an", "re", "en", "ch", "io")
HASH_BITS = 2 * len(LETTERS) + len(PAIRS)


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def bind(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is named."""
    return F.transform(F.array(value), use)[0]


def profile_hash(text: Column) -> Column:
    """A 60-bit similarity-preserving hash of a text: few bits change with few letters. Null text: 0."""

    def counts(low: Column) -> Column:
        def of(t: Column, parts) -> Column:
            return F.array(*(count_of(t, p) for p in parts))

        half = F.left(low, F.floor(F.length(low) / 2).cast("int"))
        return F.struct(of(low, LETTERS).alias("whole"), bind(half, lambda h: of(h, LETTERS)).alias("half"), of(low, PAIRS).alias("pairs"))

    def packed(c: Column) -> Column:
        return bind(
            F.aggregate(c["whole"], F.lit(0), lambda a, x: a + x),
            lambda total: F.aggregate(
                F.transform(
                    F.concat(
                        F.transform(c["whole"], lambda x: x * len(LETTERS) > total),
                        F.zip_with(c["half"], c["whole"], lambda h, w: h * 2 > w),
                        F.transform(c["pairs"], lambda x: x * 60 > total),
                    ),
                    lambda flag, i: F.when(flag, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
                ),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    return bind(bind(F.lower(F.coalesce(text, F.lit(""))), counts), packed)


def hamming_pairs(hashes: DataFrame, cut: int, agree: int = 1, bits: int = HASH_BITS) -> DataFrame:
    """All pairs of different hashes within ``cut`` bits: ``id_a`` < ``id_b``, ``distance``. ``hashes``: id, hash, hashes distinct.

    The bits are split into cut + agree chunks; within ``cut`` differing bits at
    least ``agree`` chunks are equal, so an equi-join on every choice of
    ``agree`` chunks finds all pairs exactly. A larger ``agree`` makes longer
    keys, for more rows.
    """
    n = cut + agree
    edges = [round(i * bits / n) for i in range(n + 1)]
    chunk = [F.shiftrightunsigned("hash", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)]
    keys = F.array(*(F.struct(F.lit(k).alias("table"), F.xxhash64(F.lit(k), *(chunk[i] for i in choice)).alias("key")) for k, choice in enumerate(combinations(range(n), agree))))
    spread = hashes.select("id", "hash", F.explode(keys).alias("k")).select("id", "hash", "k.table", "k.key")
    a, b = spread.alias("a"), spread.alias("b")
    distance = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash")))
    joined = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (distance <= cut))
    return joined.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), distance.alias("distance")).distinct()


def balls(hashes: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """Hashes by what lies one bit from them or nearer: ``z``, ``id``, ``hash``, and of each z's members their number ``n`` and their ``centre_id`` and ``centre_hash`` (z's own hash if it is one, else the one of the smallest id).

    Two hashes lie within two bits exactly if they share such a z. A z has
    ``bits`` + 1 members at most, however many hashes there are, so no key is
    heavy, and each hash is sent ``bits`` + 1 times. ``hashes``: id, hash, hashes
    distinct. Single members are left out.
    """
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col("hash").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    spread = hashes.select("id", "hash", F.explode(F.concat(F.array("hash"), flips)).alias("z"))
    group = Window.partitionBy("z")
    centre = F.min(F.struct((F.col("hash") != F.col("z")).alias("other"), "id", "hash")).over(group)
    marked = spread.withColumn("n", F.count("*").over(group)).where("n > 1").withColumn("centre", centre)
    return marked.select("z", "id", "hash", "n", F.col("centre.id").alias("centre_id"), F.col("centre.hash").alias("centre_hash"))


def near_links(hashes: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """Links that connect what all pairs within two bits would, as stars: ``id_a`` < ``id_b``, ``distance``.

    Their number grows with the hashes and not with their pairs. Of hashes with a
    neighbour at one bit every one has such a link, so the least distance of a
    cluster is seen too.
    """
    b = balls(hashes, bits).where(F.col("id") != F.col("centre_id"))
    return b.select(F.least("id", "centre_id").alias("id_a"), F.greatest("id", "centre_id").alias("id_b"), F.bit_count(F.col("hash").bitwiseXOR(F.col("centre_hash"))).alias("distance")).distinct()


def near_pairs(hashes: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    """All pairs of hashes within two bits, each once: ``id_a`` < ``id_b``, ``distance``. A pair shares two places z; it is taken from the smaller one."""
    b = balls(hashes, bits).select("z", "id", "hash")
    x, y = b.alias("x"), b.alias("y")
    apart = F.col("x.hash").bitwiseXOR(F.col("y.hash"))
    both = x.join(y, (F.col("x.z") == F.col("y.z")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.z") < F.col("x.z").bitwiseXOR(apart)))
    return both.select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"), F.bit_count(apart).alias("distance"))


def hash_classes(rows: DataFrame) -> DataFrame:
    """``rows`` (id, hash) with ``class_id``, the smallest id of the same hash: copies meet here, not in pairs."""
    least = rows.groupBy("hash").agg(F.min("id").alias("class_id"))
    return rows.join(least, "hash")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where either is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def confirm_pairs(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs whose vectors' cosine is ``least`` or more; a pair without both vectors is dropped. ``vectors``: id, vector."""
    a = vectors.select(F.col("id").alias("id_a"), F.col("vector").alias("va"))
    b = vectors.select(F.col("id").alias("id_b"), F.col("vector").alias("vb"))
    return pairs.join(a, "id_a").join(b, "id_b").withColumn("cosine", cosine(F.col("va"), F.col("vb"))).where(F.col("cosine") >= least).drop("va", "vb")


#: Pivots of a nearest-neighbour search at most, and rows for each while there are fewer.
MOST_PIVOTS, PIVOT_ROWS = 1024, 1024
#: Rounding of distances that is allowed for when cells are left out.
SLACK = 1e-7
#: Times that cells may send the rows of both sides, on average; where more would be sent, rows pass by in place.
MOST_SENT = 4
#: Tasks in which the rows pass by a block of queries.
SLICES = 4


def _unit(vectors: pd.Series, zero_at: int) -> np.ndarray:
    """Unit vectors with two coordinates more, one of which is 1 for a zero vector: on either side another, so that its cosine with anything is 0."""
    x = np.stack(vectors.to_numpy()).astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    more = np.zeros((len(x), 2))
    more[norm[:, 0] == 0, zero_at] = 1.0
    return np.hstack([x / np.where(norm == 0, 1.0, norm), more])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _keep_nearest(held: tuple[np.ndarray, np.ndarray], a: np.ndarray, asking: np.ndarray, b: np.ndarray, ids: np.ndarray, same_table: bool) -> None:
    """Put into ``held`` (ids and cosines, k a query, best first) what is nearer in a block of rows.

    Products in single precision leave out rows that can't be among the k nearest,
    by more than their rounding; the others' cosines are summed in double precision,
    row by row, so that copies have equal ones wherever they stand.
    """
    near, cosines = held
    k, slack = near.shape[1], 1.2e-7 * (a.shape[1] + 2)
    a_short, b_short = a.astype(np.float32), b.astype(np.float32).T
    for at in range(0, len(a), 256):
        s = a_short[at : at + 256] @ b_short
        least = cosines[at : at + 256, -1] - slack
        if len(b) > k + 1 and np.isinf(least).any():
            least = np.maximum(least, np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] - 2 * slack)
        i, j = np.divmod(np.flatnonzero(s >= least[:, None]), len(b))  # in two dimensions nonzero takes longer than the product
        i += at
        if same_table:
            other = asking[i] != ids[j]
            i, j = i[other], j[other]
        if not len(i):
            continue
        c = np.concatenate([np.einsum("ij,ij->i", a[i[n : n + 16384]], b[j[n : n + 16384]]) for n in range(0, len(i), 16384)])
        rows = np.unique(i)
        i, c, j = np.concatenate([np.repeat(rows, k), i]), np.concatenate([cosines[rows].ravel(), c]), np.concatenate([near[rows].ravel(), ids[j]])
        order = np.lexsort((j, -c, i))
        i = i[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        kept = order[(first[:, None] + np.arange(k)).ravel()]
        near[rows], cosines[rows] = j[kept].reshape(-1, k), c[kept].reshape(-1, k)


def _none_yet(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)


def _long(asking: np.ndarray, near: np.ndarray, cosines: np.ndarray) -> pd.DataFrame:
    found = np.isfinite(cosines)
    return pd.DataFrame({"query_id": np.repeat(asking, near.shape[1])[found.ravel()], "id": near[found], "cosine": cosines[found]})


def _best(k: int, same_table: bool):
    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """Of one group of queries, the ``k`` nearest in one block of rows."""
        held, asking = _none_yet(len(q), k), q["id"].to_numpy(dtype=np.int64)
        if len(q) and len(r):
            _keep_nearest(held, _unit(q["vector"], 0), asking, _unit(r["vector"], 1), r["id"].to_numpy(dtype=np.int64), same_table)
        return _long(asking, *held)

    return best


def _asked_for(asked: DataFrame) -> dict[int, int]:
    """Queries of each cell: MOST_PIVOTS numbers at most."""
    return {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def _sent(wanted: dict[int, int], sizes: dict[int, int], block: int) -> int:
    """Rows that ``_meet`` would shuffle."""
    return sum(n * math.ceil(sizes.get(c, 0) / block) + sizes.get(c, 0) * math.ceil(n / block) for c, n in wanted.items())


def _meet(asked: DataFrame, rows: DataFrame, wanted: dict[int, int], sizes: dict[int, int], k: int, block: int, same_table: bool) -> DataFrame:
    """Queries and the rows of the cells that they ask for, block by block. Both: id, vector, cell. A cell of any size, or one that any number ask for, is many blocks."""
    spark = asked.sparkSession
    table = [(c, max(1, math.ceil(n / block)), max(1, math.ceil(sizes.get(c, 0) / block))) for c, n in wanted.items()]
    parts = F.broadcast(spark.createDataFrame(table, "cell int, nq int, nr int"))

    def dealt(salt: list[Column], n: str) -> Column:
        # an int, as the exploded numbers are: keys of two types would be hashed apart, and groups would miss each other
        return F.pmod(F.xxhash64("id", *salt), F.col(n)).cast("int")

    left = asked.join(parts, "cell").select("id", "vector", "cell", dealt([], "nq").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"))
    right = rows.join(parts, "cell").select("id", "vector", "cell", dealt([F.lit(1)], "nr").alias("j"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("i"))
    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(_best(k, same_table), "query_id long, id long, cosine double")


def _packed(rows: DataFrame, n: int, block: int) -> DataFrame:
    """Rows (id, vector) as blocks: ``block`` (its name), ``ids``, ``vectors``. Each row is written once."""
    kind = np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held, made, place = [], 0, 0, TaskContext.get().partitionId()

        def blocks() -> pd.DataFrame:
            ids, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pd.DataFrame({"block": [f"{place}-{made}"], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

        for batch in batches:
            for part in (batch.iloc[i : i + block] for i in range(0, len(batch), block)):
                parts.append((part["id"].to_numpy(dtype=np.int64), np.stack(part["vector"].to_numpy()).astype(kind)))
                held += len(part)
                if held >= 2 * block:
                    yield blocks()
                    parts, held, made = [], 0, made + 1
        if held:
            yield blocks()

    return cut(rows.select("id", "vector").repartition(max(1, math.ceil(n / block))).mapInPandas(pack, "block string, ids binary, vectors binary"))


def _pass_by(asked: DataFrame, rows: DataFrame, n_asked: int, n_rows: int, k: int, block: int, same_table: bool, one_frame: bool) -> DataFrame:
    """All queries against all rows: the rows stay where they are written, and pass by each block of queries in ``SLICES`` tasks, one block at a time.

    What is shuffled is each row once and ``SLICES`` times k neighbours a query. One
    frame that is both sides is packed once.
    """
    kind = np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64
    kind_asked = np.float32 if dict(asked.dtypes)["vector"] == "array<float>" else np.float64

    def opened(r: Row, kind: type, zero_at: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(r["ids"], dtype=np.int64)
        return ids, _unit(pd.Series(list(np.frombuffer(r["vectors"], dtype=kind).reshape(len(ids), -1))), zero_at)

    def near(pairs: Iterable[tuple[Row, Row]]) -> Iterator[tuple[bytes, bytes, bytes]]:
        held: dict = {}
        for q, r in pairs:
            if q["block"] not in held:
                ids, x = opened(q, kind_asked, 0)
                held[q["block"]] = ids, x, _none_yet(len(ids), k)
            ids, x, found = held[q["block"]]
            row_ids, y = opened(r, kind, 1)
            _keep_nearest(found, x, ids, y, row_ids, same_table)
        for ids, _, (near_ids, cosines) in held.values():
            yield ids.tobytes(), near_ids.tobytes(), cosines.tobytes()

    def unpacked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, near_ids, cosines in zip(batch["ids"], batch["near"], batch["cosines"], strict=True):
                yield _long(np.frombuffer(ids, dtype=np.int64), np.frombuffer(near_ids, dtype=np.int64).reshape(-1, k), np.frombuffer(cosines).reshape(-1, k))

    right = _packed(rows, n_rows, block)
    left = right if one_frame else _packed(asked, n_asked, block)
    found = asked.sparkSession.createDataFrame(left.rdd.cartesian(right.rdd.coalesce(SLICES)).mapPartitions(near), "ids binary, near binary, cosines binary")
    return found.mapInPandas(unpacked, "query_id long, id long, cosine double")


def _top(parts: DataFrame, k: int) -> DataFrame:
    order = F.struct((-F.col("cosine")).alias("far"), "id")
    return parts.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("near"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 4096, same_table: bool = True, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """Exact k nearest by cosine: ``query_id``, ``rank``, ``id``, ``cosine``; ties to the smaller id, a row isn't its own neighbour.

    Rows are dealt to cells by the nearest of a bounded number of pivots (rows of
    smallest hash). A query is compared with its own cell first; the k-th distance
    found there and the cells' radii rule out, by the triangle inequality, cells
    that can't hold a nearer row. What is left is compared, as matrix products of
    blocks. On data with clusters few cells are left. Where the cells would send the
    rows more than ``MOST_SENT`` times, all rows pass by all queries instead: the
    comparisons are those of all pairs, but what is shuffled and written grows with
    the rows. Results are the same. Inputs: id, vector; where one frame is given for
    both, its rows are dealt and packed once.
    """
    # the pivots: MOST_PIVOTS rows at most
    n = rows.count()
    pivots = rows.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(max(1, min(MOST_PIVOTS, n // pivot_rows))).toPandas()
    shape = "query_id long, rank int, id long, cosine double"
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], shape)
    marks = _unit(pivots["vector"], 1)
    schema = f"id long, vector {dict(rows.dtypes)['vector']}, cell int, away double"

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[i : i + 2048] for i in range(0, len(batch), 2048)):
                d = _apart(_unit(part["vector"], 1), marks)
                cell = d.argmin(1)
                yield pd.DataFrame({"id": part["id"], "vector": part["vector"], "cell": cell.astype(np.int32), "away": d[np.arange(len(d)), cell]})

    dealt = cut(rows.select("id", "vector").mapInPandas(deal, schema))
    stats = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    sizes = {c: size for c, (size, _) in stats.items()}
    radius = np.array([stats[c][1] if c in stats else -np.inf for c in range(len(marks))])

    def own(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[i : i + 2048] for i in range(0, len(batch), 2048)):
                d = _apart(_unit(part["vector"], 0), marks)
                d[:, np.isinf(radius)] = np.inf
                yield pd.DataFrame({"id": part["id"], "vector": part["vector"], "cell": d.argmin(1).astype(np.int32)})

    rows_in, one_frame = dealt.select("id", "vector", "cell"), queries is rows
    # under names of its own: a frame can't meet itself
    asked = dealt.select(*(F.col(c).alias(c) for c in rows_in.columns)) if one_frame else cut(queries.select("id", "vector").mapInPandas(own, schema.replace(", away double", "")))
    wanted = _asked_for(asked)
    n_asked = sum(wanted.values())
    most = MOST_SENT * (n + n_asked)
    if _sent(wanted, sizes, block) > most:
        top = _top(_pass_by(asked, rows_in, n_asked, n, k, block, same_table, one_frame), k)
    elif len(stats) == 1:
        top = _top(_meet(asked, rows_in, wanted, sizes, k, block, same_table), k)
    else:
        first = cut(_meet(asked, rows_in, wanted, sizes, k, block, same_table))
        kth = _top(first, k).select(F.col("query_id").alias("id"), F.when(F.size("near") == k, -F.element_at("near", -1)["far"]).alias("kth"))
        bounded = asked.join(kth, "id", "left")

        def further(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
            """Queries, and the other cells that may hold a row as near as their k-th."""
            for batch in batches:
                for part in (batch.iloc[i : i + 512] for i in range(0, len(batch), 512)):
                    d = _apart(_unit(part["vector"], 0), marks)
                    bound = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * part["kth"].astype(float).to_numpy()))
                    open_ = d - radius <= np.where(np.isnan(bound), np.inf, bound)[:, None] + SLACK
                    open_[np.arange(len(part)), part["cell"].to_numpy()] = False
                    open_[:, np.isinf(radius)] = False
                    yield part, open_

        def copies(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A query once for each such cell."""
            for part, open_ in further(batches):
                i, cell = np.nonzero(open_)
                yield pd.DataFrame({"id": part["id"].to_numpy()[i], "vector": part["vector"].to_numpy()[i], "cell": cell.astype(np.int32)})

        def counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, open_ in further(batches):
                n_open = open_.sum(0)
                cell = np.flatnonzero(n_open)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "n": n_open[cell].astype(np.int64)})

        wanted = {r["cell"]: r["n"] for r in bounded.mapInPandas(counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # MOST_PIVOTS rows at most
        if _sent(wanted, sizes, block) > most:
            top = _top(_pass_by(asked, rows_in, n_asked, n, k, block, same_table, one_frame), k)
        else:
            wider = cut(bounded.mapInPandas(copies, schema.replace(", away double", "")))
            top = _top(first.unionByName(_meet(wider, rows_in, wanted, sizes, k, block, same_table)), k)
    return top.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.far")).alias("cosine"))


def clusters(pairs: DataFrame, least_size: int = 2) -> DataFrame:
    """``id`` and ``cluster_id`` (smallest member) of every document in a cluster of ``least_size`` or more."""
    found = connected_components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_size)
    return found.join(sizes, "component").select(F.col("vertex").alias("id"), F.col("component").alias("cluster_id"))


def severity_by_size(n: Column) -> Column:
    return F.when(n >= 10, "high").when(n >= 3, "medium").otherwise("low")


def document_clusters(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every document in a cluster of two or more, exact copies included: ``id``, ``hash``, ``cluster_id`` (smallest member).

    ``rows``: id, hash; ``pairs``: those of the classes' smallest ids. A hash held
    by two documents is a cluster even without a pair.
    """
    return rows.join(sized_classes(rows, clusters(pairs)).select("hash", "cluster_id"), "hash").select("id", "hash", "cluster_id")


def cluster_stats(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Documents, least distance (0 where a hash repeats), and severity of every cluster. ``members``: those of ``document_clusters``."""
    classes = members.groupBy("cluster_id", "hash").agg(F.count("*").alias("k"), F.min("id").alias("id_a"))
    least = pairs.join(classes.select("id_a", "cluster_id"), "id_a").groupBy("cluster_id").agg(F.min("distance").alias("d"))
    size = classes.groupBy("cluster_id").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    apart = F.when(F.col("most") > 1, 0).otherwise(F.col("d")).alias("min_distance")
    return size.join(least, "cluster_id", "left").select("cluster_id", "n", apart, severity_by_size(F.col("n")).alias("severity"))


def sized_classes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The hash classes in a cluster: ``hash``, ``cluster_id``, ``cluster_n`` (documents, copies included) and ``severity``.

    ``rows``: id, hash; ``members``: the clusters of the classes' smallest ids. A
    class of two documents or more is a cluster even if no other class is near.
    """
    classes = rows.groupBy("hash").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(members, "id", "left").select("hash", F.coalesce("cluster_id", "id").alias("cluster_id"), "n")
    size = classes.groupBy("cluster_id").agg(F.sum("n").alias("cluster_n")).where("cluster_n >= 2")
    return classes.join(size, "cluster_id").select("hash", "cluster_id", "cluster_n", severity_by_size(F.col("cluster_n")).alias("severity"))


def label_agreement(neighbours: DataFrame, labels: DataFrame, least_neighbours: int = 5, most: float = 0.2) -> DataFrame:
    """Share of a row's neighbours with its own label; ``flagged`` if at most ``most``. ``labels``: id, label."""
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("own"))
    both = neighbours.join(labels, "id").join(own, "query_id")
    share = both.groupBy("query_id").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("own")).cast("double")).alias("agreement")).where(F.col("n") >= least_neighbours)
    return share.withColumn("flagged", F.col("agreement") <= most)


def label_conflicts(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters whose members carry two different non-empty label sets or more.

    ``labels``: id, label (several rows an id). Returns the number of sets, the
    most frequent one, and whether it has a strict majority over the next.
    """
    sets = members.join(labels, "id").groupBy("cluster_id", "id").agg(F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("label_set")).where("label_set <> ''")
    counted = sets.groupBy("cluster_id", "label_set").agg(F.count("*").alias("n"))
    top = counted.groupBy("cluster_id").agg(F.count("*").alias("n_sets"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "label_set"))), 1, 2).alias("top")).where("n_sets >= 2")
    return top.select("cluster_id", "n_sets", F.col("top")[0]["label_set"].alias("majority_set"), (F.col("top")[0]["neg"] < F.col("top")[1]["neg"]).alias("strict_majority"))


def reference_distance(queries: DataFrame, reference: DataFrame, k: int = 5) -> DataFrame:
    """1 - mean of the k best cosines to a reference set: ``query_id``, ``distance``."""
    return nearest(queries, reference, k, same_table=False).groupBy("query_id").agg((1 - F.avg("cosine")).alias("distance"))


def leave_one_out_threshold(reference: DataFrame, k: int = 5, quantile: float = 0.99, factor: float = 1.15) -> float:
    """The distance from which a row counts as out of distribution, from the reference set itself."""
    inner = nearest(reference, reference, k).groupBy("query_id").agg((1 - F.avg("cosine")).alias("distance"))
    found = quantiles(inner, "distance", [quantile]).first()
    return float(found["quantiles"][0] * factor) if found else 0.0
