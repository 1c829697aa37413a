"""Structured Streaming forms: ordered folds, idempotent append, incremental index, running Merkle roots, two-batch drift, and windows over events."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veristrata.operators import drift, governance


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_once(events: DataFrame) -> DataFrame:
    """Requests are remembered for ever, as the append contract asks."""
    return events.dropDuplicates(["request_id"])


def append_once_within(events: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """The bounded form: repeats are dropped while they come within ``delay``."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["request_id"])


def as_timestamp(events: DataFrame, time: str = "ts") -> DataFrame:
    """Zone-less timestamps can't carry a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Ours, beyond parity: counts and sums by type in tumbling windows."""
    return as_timestamp(events, time).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    return as_timestamp(events, time).withWatermark(time, delay).groupBy(F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return as_timestamp(events, time).withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


class MerkleAccumulator:
    """Perfect subtrees of what has been appended: a stack of (level, hash), log2(n) long."""

    def __init__(self, stack: list[tuple[int, str]] | None = None):
        self.stack = [(int(level), h) for level, h in stack or []]

    def append(self, leaf: bytes) -> None:
        node, level = leaf, 0
        while self.stack and self.stack[-1][0] == level:
            node = hashlib.sha256(b"\x01" + bytes.fromhex(self.stack.pop()[1]) + node).digest()
            level += 1
        self.stack.append((level, node.hex()))

    def root(self) -> str:
        if not self.stack:
            return hashlib.sha256(b"").hexdigest()
        node = bytes.fromhex(self.stack[-1][1])
        for _, h in reversed(self.stack[:-1]):
            node = hashlib.sha256(b"\x01" + bytes.fromhex(h) + node).digest()
        return node.hex()


def merkle_stream(records: DataFrame) -> DataFrame:
    """``ledger_id``, ``size`` and ``root`` after every micro-batch. ``records``: ledger_id, seq, rec. One writer a ledger, as appends are ordered."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, stack = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        tree = MerkleAccumulator(stack)
        rows = pd.concat(list(batches)).sort_values("seq")
        for rec in rows["rec"]:
            tree.append(hashlib.sha256(b"\x00" + rec.encode("utf-8")).digest())
        state.update((size + len(rows), json.dumps(tree.stack)))
        yield pd.DataFrame([(key[0], size + len(rows), tree.root())], columns=["ledger_id", "size", "root"])

    return records.groupBy("ledger_id").applyInPandasWithState(run, "ledger_id string, size long, root string", "size long, stack string", "update", GroupStateTimeout.NoTimeout)


class NonceWindow(StatefulProcessor):
    """Per ledger: nonces of the anchoring interval that is open, as map entries, and the last number.

    A nonce costs one entry, read and written alone; an anchor clears the map and
    opens the next interval with its own nonce.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "nonce string", "seq long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of Spark's protocol
        out: list[tuple] = []
        last = self.last.get()[0] if self.last.exists() else -1
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if row.seq > last + 1:
                out.append((key[0], row.seq, "missing", None, row.seq - last - 1))
            if row.type == "degraded_marker":
                out.append((key[0], row.seq, "declared_gap", None, None))
            if self.seen.containsKey((row.nonce,)):
                out.append((key[0], row.seq, "nonce_reuse", row.nonce, self.seen.getValue((row.nonce,))[0]))
            if row.type == "anchor_event":
                self.seen.clear()
            self.seen.updateValue((row.nonce,), (int(row.seq),))
            last = max(last, int(row.seq))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["ledger_id", "seq", "kind", "nonce", "about"]).astype({"about": "Int64"})

    def close(self) -> None:
        pass


WATCHED = "ledger_id string, seq long, kind string, nonce string, about long"


def watch_stream(records: DataFrame) -> DataFrame:
    """What can be told of ledgers as they grow: ``nonce_reuse`` (about: the number that used it first), ``missing`` (about: how many numbers) and ``declared_gap``.

    ``records``: ledger_id, seq, type, nonce. State is kept by Spark's RocksDB
    store, which the session must name as its state store.
    """
    return records.groupBy("ledger_id").transformWithStateInPandas(NonceWindow(), WATCHED, "Append", "None")


class FoldState(StatefulProcessor):
    """Per finding: its state as one typed value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", governance.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in governance.STATE.split(", ")]
        plain = lambda v: list(v) if isinstance(v, (list, tuple)) else v
        s = dict(zip(names, map(plain, self.state.get()), strict=True)) if self.state.exists() else governance.new_state(key[0], "review")
        s = governance.fold_all(s, governance._records(pd.concat(list(rows))))
        self.state.update(tuple(s[n] for n in names))
        yield governance._frame([s], governance.STATE)

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame) -> DataFrame:
    """State of every finding after each micro-batch. Order inside a batch is by ``seq``, never by clock.

    Actions on targets are left to a stream of their own; an approval that names none of the finding's changes alters nothing but ``last_seq``.
    """
    return events.where(~F.col("action").isin(*governance.ON_TARGETS)).groupBy("finding_id").transformWithStateInPandas(FoldState(), governance.STATE, "Update", "None")


def drift_stream(incoming: DataFrame, reference: DataFrame, sink: Callable[[DataFrame, int], None]):
    """Each micro-batch against a static reference: axis, value on both sides."""

    def one(batch: DataFrame, number: int) -> None:
        values = reference.select("axis", F.lit(0).alias("batch"), "value").unionByName(batch.select("axis", F.lit(1).alias("batch"), "value"))
        sink(drift.assess(values), number)

    return incoming.writeStream.foreachBatch(one)


def index_stream(reports: DataFrame, target: str):
    """Incremental index: each file's rows replace those of its scan, as partitions of ``target``."""

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(target)

    return reports.writeStream.foreachBatch(one)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run what is there now into a memory table, for tests and batch use."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
