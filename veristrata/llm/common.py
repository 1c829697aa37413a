"""Shared plumbing of the language-model data operators.

Nothing outside ``veristrata.llm`` imports this subpackage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.sources.session import checkpoint_dir, cut, table

__all__ = ["checkpoint_folder", "cut", "in_batches", "in_blocks", "stored", "table", "text_or_empty"]


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's ``spark.checkpoint.dir``, or a temporary one only where that is unset."""
    return checkpoint_dir(spark)


#: Rows of a batch that Python is handed.
BATCH_ROWS = 2000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts Python is to get in batches of ``BATCH_ROWS`` rows at most: a worker holds a batch several times over."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH)) <= BATCH_ROWS:
        conf.set(BATCH, str(BATCH_ROWS))
    return df


def in_blocks(batches: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``rows`` (the last one may be smaller), however Arrow cut them."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: rows - size], batch.iloc[rows - size :]
            held.append(part)
            size += len(part)
            if size == rows:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, in ``parts`` if named, and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/veristrata-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
