"""Operators 11 to 13: against SQL, brute force, and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.test_operators import odd_rows
from veristrata.llm import audit, exact, queries, resample


def test_sql(same):
    for name in ("op11_filter_audit", "op12_exact_dedup", "op13_resample"):
        same(queries.QUERIES[name], queries.ORACLES[name])


# ---- 11 ----

SPACE = re.compile("[\x20\x09-\x0d]+")


def bits_of(rows, text, i):
    t = text or ""
    w = [x for x in SPACE.split(t) if x]
    fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows))
    return sum(f << k for k, f in enumerate(fails))


def brute_audit(rows, labels):
    """``rows``: doc_id, text, lang."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = [(lang or "", bits_of([r[:2] for r in rows], t, i), i) for i, t, lang in rows]
    out = {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        removed = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, c in enumerate(order, 1):
                k = 1 << "ABCDE".index(c)
                here = [d for d in left if d[0] & k]
                gone = [d for d in own if d[0] & k and d not in left]
                left = [d for d in left if not d[0] & k]
                removed[c] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), len(gone), sum(d[0] == k for d in own), sum(d[1] in good for d in here), sum(d[1] in toxic for d in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, part int, kind string").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(docs, marks).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}


def test_audit_of_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "A" * 50, "en"), (4, "a " * 300, "en"), (5, " ".join(map(str, range(250))), "en"), (6, " ".join(map(str, range(250))), "de"), (None, " ".join(map(str, range(250))), "en"), (7, "x|y", ""), (8, " ".join(f"w{k}" for k in range(20_000)), "fr"), (9, "ÄÖ " * 70, "fr")]
    labels = [(2, 1, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_a_hot_text(spark):
    """A text that two fifths of all rows hold crosses several ranges; each range's first row is settled by what others hand on."""
    rng = random.Random(1)
    rows = [(i, "the same text" if rng.random() < 0.4 else f"text {rng.randrange(120)}", rng.choice(["en", "de", None])) for i in range(400)]
    rng.shuffle(rows)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert audited(spark, rows, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 4)]) == brute_audit(rows, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 4)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_of_one_fingerprint():
    """Texts that share a fingerprint, and rows that share an id, over every cut of one sorted run."""
    import pyarrow as pa

    rows = [(None, "a"), (3, "a"), (3, "a"), (5, "a"), (1, "b"), (4, "b"), (2, "c")]
    by_id = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))  # ranges go by fingerprint and id
    want = sorted((str(i), t, any(j is not None and i is not None and j < i and t == u for j, u in rows)) for i, t in rows)
    for cuts in itertools.combinations(range(1, len(rows)), 2):
        marked = []
        for lo, hi in itertools.pairwise([0, *cuts, len(rows)]):
            part = sorted(by_id[lo:hi], key=lambda r: (r[1], r[0] is not None, r[0] or 0))
            batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in part], pa.int64()), "part": [r[1] for r in part], "text": [r[1] for r in part], "fingerprint": pa.array([7] * len(part), pa.int64())})
            marked += [r for b in audit._compare([batch]) for r in b.to_pylist()]
        least = defaultdict(list)
        for r in marked:
            if r["kind"] == audit.HANDED:
                least[r["text"]].append(r["least"])
        got = sorted((str(r["doc_id"]), r["part"], bool(r["failures"] & audit.COPY) or r["kind"] == audit.OPEN and min(least[r["text"]]) < r["doc_id"]) for r in marked if r["kind"] != audit.HANDED)
        assert got == want, cuts


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


# ---- 12 ----


def grouped(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[SPACE.sub(" ", t or "")].append(i)
    return sorted((str(i), str(min((j for j in of[n] if j is not None), default=None)), len(of[n]), i == min((j for j in of[n] if j is not None), default=None), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [SPACE.sub(" ", t or "")])


@pytest.mark.parametrize("counters", [1, 3, 2000])
def test_exact_groups(spark, counters):
    rng = random.Random(counters)
    rows = [(i, rng.choice(["hot", "hot", "hot  text", "hot\ttext", None, "", " ", "\n", f"t{rng.randrange(60)}"])) for i in range(500)] + [(None, "only null"), (None, "hot"), (7, "same id"), (7, "same id"), (900, "word " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, keep_id int, digest string").repartition(5)
    found = exact.groups(docs, counters).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in found) == grouped(rows)
    left = exact.drop_copies(docs, counters)
    assert left.columns == docs.columns
    texts = [SPACE.sub(" ", r["text"] or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {SPACE.sub(" ", t or "") for _, t in rows}


def test_summaries_keep_their_bound(spark):
    rng = random.Random(2)
    keys = [str(min(rng.randrange(1, 40), rng.randrange(1, 400))).encode() for _ in range(4000)]
    rows = spark.createDataFrame([(k,) for k in keys], "digest binary").repartition(6)
    k, counts = 19, Counter(keys)
    found = {bytes(r["digest"]) for r in exact.frequent(rows, "digest", k).collect()}
    assert len(found) <= k + 1 and {x for x, n in counts.items() if n * (k + 1) >= 3 * len(keys)} <= found
    small = exact.reduced({i: n for i, n in enumerate([9, 5, 5, 2, 1])}, 2)
    assert small == {0: 4}  # lowered by the third largest


def test_exact_of_odd_and_no_rows(spark):
    docs = odd_rows(spark)
    assert exact.groups(docs).count() == docs.count()
    assert exact.groups(docs.limit(0)).count() == 0 and exact.drop_copies(docs.limit(0)).count() == 0


# ---- 13 ----


def brute_scores(rows, target, orders=1, least=20, percent=10):
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def buckets(w):
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in buckets(words(x))), Counter(b for x in target for b in buckets(words(x)))
    all_s, all_t = s.total(), t.total()
    out = []
    for i, x in rows:
        b = buckets(words(x))
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * (all_s + 10_000) / ((s[k] + 1) * (all_t + 10_000)))) for k in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((str(r[0]), *r[1:4], place.get(id(r))) for r in out)


def resampled(spark, rows, target, orders=1):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row int, bucket string, score int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample.draw(resample.scores(docs, wanted, orders)).collect())


@pytest.mark.parametrize("orders", [1, 3])
def test_scores_and_draw(spark, orders):
    rng = random.Random(orders)
    vocabulary = [f"W{k}" for k in range(50)] + ["É", "é", "straße", "ß1", "x y"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(n))
    rows = [(i, text(rng.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, " ...\n"), (None, text(30)), (203, "same " * 25), (203, "same " * 25), (204, "long " * 30_000)]
    target = [text(40) for _ in range(10)] + [None, ""]
    assert resampled(spark, rows, target, orders) == brute_scores(rows, target, orders)


def test_resample_of_nothing(spark):
    assert resampled(spark, [], ["a"]) == []
    rows = [(i, " ".join(f"v{(i * k) % 17}" for k in range(25))) for i in range(40)]
    assert resampled(spark, rows, []) == brute_scores(rows, [])


def test_drawn_rows_are_whole(spark):
    rows = [(i, " ".join(f"v{(i * k) % 17}" for k in range(25)), 5, "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, score string")
    found = resample.drawn(docs, docs.select("text").limit(3)).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4] and all(r["text"] == rows[r["doc_id"]][1] and r["score"] == "s" for r in found)
