"""Secrets are found and masked whole, however long; results don't follow the session's batch sizes."""

import random

import numpy as np
import pytest

from veristrata.llm import common, neighbours, pii


@pytest.fixture(scope="module")
def weight():
    return pii.train(pii.cases(pii.CASES))


def test_long_secrets(weight):
    rng = random.Random(4)
    key = "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(900))
    token = f"eyJ{key[:40]}.{key[40:700]}.{key[700:760]}"
    for lead, secret in [("password: ", key[:100]), ("token = ", key), ("api_key = ", token), ("auth token: ", token), ('secret "', token)]:
        text = f"We found {lead}{secret} and then it was over."
        spans = pii.base_spans(text)
        spans += pii.added_spans(text, spans, weight)
        masked = pii.mask(text, spans)
        assert secret[-30:] not in masked and secret[40:70] not in masked, (lead, len(secret))
    assert [m[0] for m in pii.TOKEN.finditer("eyJab.cd. Then")] == ["eyJab.cd"]


def test_blocks_of_any_batches():
    import pandas as pd

    whole = pd.DataFrame({"x": range(23)})
    for size in (1, 4, 5, 23, 50):
        cut = [whole.iloc[i : i + size] for i in range(0, 23, size)]
        blocks = list(common.in_blocks(cut, 5))
        assert [len(b) for b in blocks] == [5, 5, 5, 5, 3] and [x for b in blocks for x in b["x"]] == list(range(23))
    assert list(common.in_blocks([], 5)) == []


def test_neighbours_dont_follow_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(12_000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found, old = [], spark.conf.get(key)
    try:
        for size in ("10000", "700"):
            spark.conf.set(key, size)
            found.append(sorted(map(tuple, neighbours.nearest_of_hundredth(table).collect())))
    finally:
        spark.conf.set(key, old)
    assert found[0] == found[1]
