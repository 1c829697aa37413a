"""Near-duplicate documents (operator 6): a chosen-path set similarity join.

A document is the set of its word shingles, sketched by MinHash. Independent
trees branch the documents recursively: a node chooses one of the sketch's
places (sometimes two, so that 1 / similarity branches are taken on average),
and a document goes on to the child named by its value at a chosen place. Alike
documents tend to stay together, others part quickly. Small nodes are compared
exhaustively on sketches; a large node whose documents are alike on average is
compared in chunks that share pivots, and any other large node branches on. So
many trees are grown that a pair at the threshold is missed with probability
``MISS``.

Documents that are joined so, directly or by a chain, form sketch groups; every
link lies inside one. Inside a group links are confirmed on the documents' full
sets: a group of moderate size (in shingles, and in documents, which bounds the
pairs) in one task, where documents known to be connected aren't compared again;
a larger one against blocks of pivots, first some members, then every member
that those didn't reach, so that each document outside the group's main part has
been compared with all others. Large groups go in batches of bounded pivots, each
stored as a part of its own.

What can be lost: a pair of similarity s is missed by all trees with probability
(1 - survival(s, depth))^trees, ``MISS`` at the threshold for nodes of the depth
that trees are numbered for, which holds ``FURTHER`` rounds beyond the one that a
node is expected to be small at; and its sketches fall below the floor with
probability 4e-6 at the threshold (``SLACK`` deviations). Both fall quickly above
the threshold. In a large node of alike documents a pair outside the part that
pivots reach is compared only where a chunk, drawn anew in each node, holds both.

Equal sets are joined before anything else, by a digest. Vertices are documents
that stand for a set; the result names every document's component.

Defined results: words are runs of anything but space and U+0009 to U+000D,
after lower-casing A-Z; a text of fewer words than a shingle has is one shingle
of all; null, empty and blank texts have no shingles and no links; a null id
has a null component and is kept; rows that share an id share a component;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristrata.llm.common import checkpoint_folder, cut, in_batches, stored
from veristrata.operators.graph import connected_components

#: Sketch places used for branching, and those compared.
PLACES, COMPARED = 128, 64
#: Probability of losing a pair at the threshold, over all trees.
MISS = 1e-5
#: A node of so many documents is compared exhaustively; chunks of dense nodes are as large.
SMALL_NODE = 192
#: Pivots that the chunks of a dense node share.
PIVOTS = 16
#: A sketch estimate may fall so many standard deviations below the threshold.
SLACK = 5.0
#: Unalike documents are taken to part by this factor at each step, for the depth to start from; nodes that are still large branch on.
PART = 50
#: Words of 64 bits in the filter that keeps texts of ungrouped documents out of a shuffle: a fixed size, whatever the corpus.
FILTER_WORDS = 1 << 17
#: Rounds of further branching that the number of trees allows for, and those after which an error is raised.
FURTHER, MOST_ROUNDS = 2, 60
#: A sketch group of more shingles or documents than this is confirmed against pivots rather than in one task.
GROUP_SHINGLES, GROUP_DOCS = 1_000_000, 3_000
#: Pivots of a large group, and the shingles of all pivots of a batch of groups (8 bytes each).
BLOCK, BATCH_SHINGLES = 60, 2_000_000
#: Most nodes whose rows stay out of the shuffle, and rows of chunks that one task compares.
HUBS, TASK_ROWS = 16_384, 10_000
MEMO = 100_000

_A = np.random.default_rng(20240601).integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(20240602).integers(0, 1 << 63, PLACES, dtype=np.uint64)


class _Words(dict):
    """Word to 64-bit hash; a memo that is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(size, len(w))
    h = np.zeros(len(w) - size + 1, dtype=np.uint64) + np.uint64(size)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i])
    return np.unique(h)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """MinHash: 16 bits of the least of each of ``PLACES`` hash functions."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, i : i + 4096] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


# ---- trees ----


def survival(similarity: float, depth: int) -> float:
    """Probability that two documents share a node at ``depth``, with 1 / similarity branches on average."""
    extra, p = 1 / similarity - 1, 1.0
    for _ in range(depth):
        q = similarity * p
        p = (1 - extra) * q + extra * (1 - (1 - q) ** 2)
    return p


def children(nodes: np.ndarray, sketches: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One step of branching. Returns (row, child) for each branch that a row's node takes."""
    draw = _mix(nodes + np.uint64(0x9E3779B97F4A7C15))
    first = (draw % np.uint64(PLACES)).astype(np.int64)
    second = ((draw >> np.uint64(16)) % np.uint64(PLACES)).astype(np.int64)
    two = (draw >> np.uint64(40)) % np.uint64(10_000) < np.uint64(int(10_000 * (100 / percent - 1)))
    rows = np.arange(len(nodes))
    rows = np.concatenate([rows, rows[two]])
    place = np.concatenate([first, second[two]])
    value = sketches[rows, place].astype(np.uint64)
    return rows, _mix(nodes[rows] ^ _mix((place.astype(np.uint64) << np.uint64(20)) + value + np.uint64(1)))


def alike(sketches: np.ndarray) -> np.ndarray:
    """Share of equal places of all pairs."""
    n = len(sketches)
    out = np.zeros((n, n), dtype=np.int16)
    for column in sketches.T:
        out += column[:, None] == column[None, :]
    return out / sketches.shape[1]


class Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _array(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(len(column), width)


def floor_of(percent: int) -> float:
    s = percent / 100
    return s - SLACK * math.sqrt(s * (1 - s) / COMPARED)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``digest`` of the set, ``sketch``; the last two null for empty sets."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                s = shingle_set(text, shingle)
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s).tobytes()) if len(s) else (doc_id, 0, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "sketch"]).astype({"doc_id": "Int64"})

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, digest binary, sketch binary")


def sketch_edges(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join every sketch group, from all trees. ``reps``: rep, sketch."""
    n = reps.count()
    depth = max(1, math.ceil(math.log(max(2, n) / SMALL_NODE) / math.log(PART)))
    trees = math.ceil(math.log(MISS) / math.log(1 - survival(percent / 100, depth + FURTHER)))
    least = floor_of(percent)

    def plant(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roots = _mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        for batch in batches:
            for part in (batch.iloc[i : i + 4096] for i in range(0, len(batch), 1024)):
                s, reps_ = _array(part["sketch"], PLACES), part["rep"].to_numpy()
                rows, nodes = np.repeat(np.arange(len(part)), trees), np.tile(roots, len(part))
                for _ in range(depth):
                    taken, nodes = children(nodes, s[rows], percent)
                    rows = rows[taken]
                yield pd.DataFrame({"node": nodes.view(np.int64), "rep": reps_[rows]})

    def branch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows, nodes = children(batch["node"].to_numpy().view(np.uint64), _array(batch["sketch"], PLACES), percent)
                yield pd.DataFrame({"node": nodes.view(np.int64), "rep": batch["rep"].to_numpy()[rows]})

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        """A forest over the documents of one small node or chunk that spans its pairs of alike sketches."""
        reps_, s = part["rep"].to_numpy(), _array(part["sketch"], COMPARED)
        first, second = np.nonzero(np.triu(alike(s) >= least, 1))
        union = Union(len(reps_))
        out = [(reps_[i], reps_[j]) for i, j in zip(first.tolist(), second.tolist(), strict=True) if reps_[i] != reps_[j] and union.join(i, j)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def density(part: pd.DataFrame) -> pd.DataFrame:
        x = alike(_array(part["sketch"], COMPARED))
        k = len(part)
        return pd.DataFrame({"node": [part["node"].iloc[0]], "dense": [k > 1 and (x.sum() - k) / (k * (k - 1)) >= least]})

    short = reps.select("rep", F.substring("sketch", 1, 2 * COMPARED).alias("sketch"))
    rows = reps.mapInPandas(plant, "node long, rep long")
    path = f"{checkpoint_folder(reps.sparkSession)}/veristrata-chunks-{uuid.uuid4().hex}"

    def keep(chunks: DataFrame) -> None:
        chunks.select("node", F.col("chunk").cast("int").alias("chunk"), "rep").write.mode("append").parquet(path)

    for k in range(MOST_ROUNDS + 1):
        rows = stored(rows, "nodes")
        # a node that holds more than a HUBS-th of all rows is one of HUBS at most: only other nodes' rows meet in a task
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        hub = F.col("size") > max(SMALL_NODE, rows.count() // HUBS)
        hubs = sizes.where(hub)
        rest = rows.join(F.broadcast(hubs.select("node")), "node", "left_anti").join(sizes.where(~hub), "node")
        lists = rest.where(F.col("size") <= SMALL_NODE).groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("reps")).where(F.size("reps") > 1)
        # trees agree on most small nodes: each set of members is compared once
        keep(lists.select("reps").distinct().select(F.xxhash64("reps").alias("node"), F.lit(0).alias("chunk"), F.explode("reps").alias("rep")))
        large = cut(rest.where(F.col("size") > SMALL_NODE).unionByName(rows.join(F.broadcast(hubs), "node")))
        if large.isEmpty():
            break
        if k == MOST_ROUNDS:
            raise RuntimeError(f"nodes still large after {MOST_ROUNDS} rounds of branching")
        draw = F.pmod(F.xxhash64("rep", "node"), F.lit(1 << 40))
        sample = large.where(F.pmod(draw, F.ceil(F.col("size") / 48)) == 0).join(short, "rep").select("node", "rep", "sketch")
        dense = cut(sample.groupBy("node").applyInPandas(density, "node long, dense boolean").where("dense").select("node"))
        if not dense.isEmpty():
            thick = large.join(dense, "node")
            chunks = F.ceil(F.col("size") / (SMALL_NODE - PIVOTS)).cast("int")
            own = thick.select("node", F.pmod(F.xxhash64("rep", "node", F.lit(7)), chunks).cast("int").alias("chunk"), "rep")
            pivots = thick.where(F.pmod(draw, F.ceil(F.col("size") / PIVOTS)) == 0).select("node", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "rep")
            keep(own.unionByName(pivots).distinct())
        rows = large.join(dense, "node", "left_anti").join(reps, "rep").select("node", "rep", "sketch").mapInPandas(branch, "node long, rep long")
    chunks = reps.sparkSession.read.schema("node long, chunk int, rep long").parquet(path)
    # narrow rows, much work: tasks are numbered by rows, as their bytes would make them too few
    tasks = max(1, math.ceil(chunks.count() / TASK_ROWS))
    return chunks.join(short, "rep").select("node", "chunk", "rep", "sketch").repartition(tasks, "node", "chunk").groupBy("node", "chunk").applyInPandas(compare, "a long, b long").distinct()


# ---- exact confirmation ----


def confirm_moderate(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``rep``, ``component``: exact components of each group (group, rep, n, text), one task a group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep")
        reps, sets = part["rep"].to_numpy(), [shingle_set(t, shingle) for t in part["text"]]
        union = Union(len(sets))
        members_of: dict[int, list[int]] = {}
        for i in range(len(sets)):
            mine = [i]
            for root in list(members_of):
                if any(jaccard_at_least(sets[i], sets[j], percent) for j in members_of[root]):
                    mine = members_of.pop(root) + mine
                    union.join(i, root)
            members_of[union.find(i)] = mine
        return pd.DataFrame({"rep": reps, "component": [reps[union.find(i)] for i in range(len(reps))]})

    return members.select("group", "rep", "text").groupBy("group").applyInPandas(run, "rep long, component long")


def confirm_large(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Exact edges (a, b) that join each group's linked documents, by blocks of pivots. ``members``: batch, group, rep, text, stored by batch."""
    spark = members.sparkSession
    path = f"{checkpoint_folder(spark)}/veristrata-links-{uuid.uuid4().hex}"
    spark.createDataFrame([], "a long, b long").write.parquet(path)
    for r in members.select("batch").distinct().orderBy("batch").collect():  # batches, not documents
        part = members.where(F.col("batch") == r["batch"]).drop("batch")
        left = part.select("group", "rep")
        main: DataFrame | None = None
        while True:
            # BLOCK pivots a group, chosen by hash; a batch's pivots are bounded by BATCH_SHINGLES
            place = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("rep", F.lit(3)), "rep"))
            chosen = cut(left.withColumn("place", place).where(F.col("place") <= BLOCK).select("group", (F.col("place") - 1).alias("bit"), "rep"))
            held = [(r["group"], r["bit"], r["rep"], shingle_set(r["text"], shingle)) for r in part.join(F.broadcast(chosen), ["group", "rep"]).toLocalIterator()]
            if not held:
                break
            by_group: dict[int, list] = {}
            for g, bit, rep, s in held:
                by_group.setdefault(g, []).append((bit, rep, s))

            def masks(batches_: Iterable[pd.DataFrame], by_group: dict = by_group) -> Iterator[pd.DataFrame]:
                for batch in batches_:
                    out = []
                    for g, rep, text in zip(batch["group"], batch["rep"], batch["text"], strict=True):
                        s = shingle_set(text, shingle)
                        out.append(sum(1 << bit for bit, other, t in by_group.get(g, ()) if other == rep or jaccard_at_least(s, t, percent)))
                    yield pd.DataFrame({"group": batch["group"], "rep": batch["rep"], "mask": np.array(out, dtype=np.int64)})

            got = cut(part.mapInPandas(masks, "group long, rep long, mask long").where("mask <> 0"))
            low_bit = F.expr("cast(round(log2(mask & -mask)) as int)")
            set_bits = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda x: F.getbit("mask", x) == 1)
            pivots = chosen.withColumnRenamed("rep", "pivot")  # BLOCK rows a group of the batch
            if main is None:
                # the main part: what the pivot with most links reaches, by pivots that share a member
                alike_rows = got.groupBy("group", "mask").agg(F.count("*").alias("n")).withColumn("bit", F.explode(set_bits))
                counts = {(r["group"], r["bit"]): (r["n"], r["m"]) for r in alike_rows.groupBy("group", "bit").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("m")).collect()}
                reach = {}
                for g, ps in by_group.items():
                    start = max((bit for bit, *_ in ps), key=lambda x, g=g: counts.get((g, x), (0, 0))[0])
                    seen = 1 << start
                    while True:
                        more = seen
                        for bit, *_ in ps:
                            if seen >> bit & 1:
                                more |= counts.get((g, bit), (0, 0))[1]
                        if more == seen:
                            break
                        seen = more
                    reach[g] = seen
                of = spark.createDataFrame(list(reach.items()), "group long, reach long")
                main = cut(got.join(F.broadcast(of), "group").where(F.col("mask").bitwiseAND(F.col("reach")) != 0).select("group", "rep"))
                left = part.select("group", "rep").join(main, ["group", "rep"], "left_anti")
                members_ = got
            else:
                # the main part is one component already: one member of it for each mask stands for all
                first = got.join(main, ["group", "rep"], "left_semi").groupBy("group", "mask").agg(F.min("rep").alias("rep")).select("group", "rep", "mask")
                members_ = got.join(main, ["group", "rep"], "left_anti").unionByName(first)
            # an edge from each member to its lowest pivot, and from each pivot to the lowest one that it shares a member with
            edges = members_.withColumn("bit", low_bit).join(F.broadcast(pivots), ["group", "bit"]).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
            shared = got.select("group", "mask").distinct().select("group", low_bit.alias("low"), F.explode(set_bits).alias("bit")).distinct()
            lowest = pivots.select("group", F.col("bit").alias("low"), F.col("pivot").alias("b"))
            among = shared.join(F.broadcast(pivots), ["group", "bit"]).join(F.broadcast(lowest), ["group", "low"]).select(F.col("pivot").alias("a"), "b").where("a <> b").distinct()
            edges.where("a <> b").unionByName(among).write.mode("append").parquet(path)
            left = cut(left.join(F.broadcast(chosen.select("group", "rep")), ["group", "rep"], "left_anti"))
            if left.isEmpty():
                break
    return spark.read.schema("a long, b long").parquet(path)


def texts_of(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``group``, ``rep``, ``text`` of the members. Most documents are in no group: a bit table of fixed size drops most of their texts before the shuffle, and the join then decides."""
    slot = F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(64 * FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = members.select(slot.alias("slot")).select(F.expr("slot div 64").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    # at most FILTER_WORDS rows: a proven bound
    near = texts.withColumn("slot", slot).withColumn("word", F.expr("slot div 64")).withColumn("bit", bit).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("rep", "text")
    return members.select("group", "rep").join(near, "rep").select("group", "rep", "text")


def components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``digest`` (null for empty sets), ``n_shingles`` and ``component_id`` of every row."""
    known = stored(sketches(docs, shingle), "sketches")
    sets = known.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch"), F.max("n").alias("n"))
    sets = stored(sets, "sets")
    reps = sets.select("rep", "sketch")
    groups = connected_components(sketch_edges(reps, percent))
    grouped = groups.select(F.col("vertex").alias("rep"), F.col("component").alias("group")).join(sets.select("rep", "n"), "rep")
    weights = grouped.groupBy("group").agg(F.sum("n").alias("weight"), F.count("*").alias("docs"), F.max("n").alias("longest"))
    large = (F.col("weight") > GROUP_SHINGLES) | (F.col("docs") > GROUP_DOCS)
    grouped = stored(grouped.join(weights.withColumn("large", large).drop("docs"), "group").select("group", "rep", "large", "longest"), "groups")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    moderate = confirm_moderate(texts_of(texts, grouped.where("not large").select("group", "rep")), shingle, percent)
    big = grouped.where("large")
    if not big.isEmpty():
        held = big.select("group", "longest").distinct().agg(F.sum(F.col("longest") * BLOCK)).first()[0]
        batch = F.pmod(F.xxhash64("group"), F.lit(max(1, math.ceil(held / BATCH_SHINGLES)))).cast("int")
        members = stored(texts_of(texts, big.select("group", "rep")).withColumn("batch", batch), "members", "batch")
        wide = connected_components(confirm_large(members, shingle, percent))
        moderate = moderate.unionByName(wide.select(F.col("vertex").alias("rep"), "component"))
    labels = sets.select("digest", "rep").join(moderate.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left").select("digest", F.coalesce("component", "rep").alias("label"))
    rows = known.select("doc_id", "n", "digest").join(labels, "digest", "left")
    return rows.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The query's form: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` (the document stands for its component)."""
    return components(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for; other columns stay.

    Of rows that share id and text one stays (of no id: all).
    """
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    if not repeated_rows(docs):
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def repeated_rows(docs: DataFrame) -> bool:
    """Does any (id, text) stand in two rows? Told by narrow keys, so that texts are shuffled only where they must be."""
    return not docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long"), F.xxhash64("text")).count().where("count > 1").isEmpty()
