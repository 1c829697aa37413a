"""A training-data pipeline over ``documents``: five stages, each by one operator of ``veristrata.llm``.

1. toxicity: documents scored 0.5 or more are rejected.
2. near-duplicates: of each group of documents alike by 0.8 on five-word shingles, the one with the smallest id stays.
3. passages: sentences under a repeated span are removed, but for its first place.
4. personal data: e-mail and IP addresses, card and phone numbers are masked.
5. packing: the texts become token pieces in sequences of at most 4096.

Stages 1 to 4 return the columns of ``documents``, ``n_chars`` following the text
in stages 3 and 4; further columns of the input are left out.

Defined results: a document of null or empty text, or of null id, is scored as
its operators say (null texts have all features 0), is in no component, keeps its
null or empty text, and is packed as its end id alone. Rows that share id and
text are one document after stage 2 (rows of null id all stay). An empty table
gives no rows at every stage; without labels no document is rejected. Texts are
read whole at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import neardup, packing, passages, pii, toxicity
from veristrata.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(COLUMNS), model).where("toxicity < 0.5").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs.select(COLUMNS), shingle=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(passages.remove_repeated(docs.select(COLUMNS)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs.select(COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't state the toxicity, near-duplicate and packing stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
