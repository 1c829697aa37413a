"""The pipeline's stages, one after another."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components, check_packing
from veristrata.llm import pii


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SMALL).cache())
        assert seen[-1].columns == columns
    start, calm, single, short, masked = (({r["doc_id"]: r["text"] for r in d.collect()}) for d in seen)
    assert calm.keys() <= start.keys()
    groups = brute_components(calm, 5, 80)
    assert single.keys() == {k for k, (_, c) in groups.items() if k == c}
    assert short.keys() == single.keys() == masked.keys()
    assert not any(pii.base_spans(t) for t in masked.values())
    assert seen[-1].where(F.length("text") != F.col("n_chars")).count() == 0
    check_packing(corpus_pipeline.STAGES[-1][1](spark, seen[-1], SMALL).collect())


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    p = "A passage of several sentences stands here. It is repeated in two documents. They are not alike otherwise."
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, "one text of a few words", "en", "s", 3), (3, "one text of a few words", "en", "s", 3), (None, "no id here at all", "en", "s", 5), (None, "no id here at all", "en", "s", 5),
        (4, "word " * 30_000, "en", "s", 1), (5, f"First. {p} Mail a@b.co or +1 (826) 555-4081.", "en", "s", 1), (6, f"Second and other words. {p}", "en", "s", 1), (7, " \n\t ", "en", "s", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"toxicity": F.lit(1.0), "group": F.lit("g"), "sequence_id": F.lit(1), "id": F.lit(0), "rep": F.lit("r")})


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SMALL).cache())
        assert seen[-1].columns == corpus_pipeline.COLUMNS
    calm, single, short, masked = ([(r["doc_id"], r["text"]) for r in d.collect()] for d in seen[1:])
    assert len(calm) == 10 and len(single) == len(short) == len(masked) == 9
    after = dict(masked)
    assert after[1] is None and after[2] == "" and after[4] == "word " * 30_000 and after[6] == "Second and other words. "
    assert after[5].endswith("Mail <email> or <phone>.") and "several sentences" in after[5]
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SMALL).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in packed}[1] == 1
    check_packing([r.asDict() | ({} if r["doc_id"] is not None else {"doc_id": -i}) for i, r in enumerate(packed, 1)])


def test_stages_on_an_empty_table(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else odd_documents(spark).limit(0)


def test_run(spark):
    check_packing(corpus_pipeline.run(spark, SMALL).collect())
