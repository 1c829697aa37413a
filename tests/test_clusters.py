"""Clusters count documents: exact copies belong to them, and are one without any pair."""

from veristrata.operators import similarity


def test_copies_are_clusters(spark):
    hashes = {1: 0b0, 2: 0b0, 3: 0b0, 4: 0b1, 5: 0xFF00, 6: 0xFF00, 7: 0xF0F0F0, 8: 0x7000000, 9: 0x5000000}
    rows = spark.createDataFrame(list(hashes.items()), "id long, hash long")
    one = rows.groupBy("hash").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    pairs = similarity.hamming_pairs(one, 1)
    members = similarity.document_clusters(rows, pairs)
    got = {r["id"]: r["cluster_id"] for r in members.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 8, 9: 8}
    stats = {r["cluster_id"]: (r["n"], r["min_distance"], r["severity"]) for r in similarity.cluster_stats(pairs, members).collect()}
    assert stats == {1: (4, 0, "medium"), 5: (2, 0, "low"), 8: (2, 1, "low")}
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (5, "x"), (6, "x"), (8, "p"), (9, "q")], "id long, label string")
    found = {r["cluster_id"]: (r["n_sets"], r["majority_set"], r["strict_majority"]) for r in similarity.label_conflicts(members.select("id", "cluster_id"), labels).collect()}
    assert found == {1: (2, "b", True), 8: (2, "p", False)}
    assert similarity.document_clusters(rows.limit(0), pairs.limit(0)).count() == 0


def test_links_connect_what_pairs_do(spark):
    """Dense hashes: stars give the clusters and least distances of all pairs, in rows that grow with the hashes."""
    import random

    rng = random.Random(8)
    hashes = {rng.getrandbits(60)}
    for _ in range(60):
        h = rng.choice(sorted(hashes))
        for _ in range(rng.randrange(1, 5)):
            h ^= 1 << rng.randrange(60)
        hashes.add(h)
    centre = rng.getrandbits(60)
    hashes |= {centre ^ (1 << i) for i in range(40)}  # all within two bits of each other
    table = {i: h for i, h in enumerate(sorted(hashes))}
    rows = spark.createDataFrame(list(table.items()), "id long, hash long")
    want = {(a, b): (table[a] ^ table[b]).bit_count() for a in table for b in table if a < b and (table[a] ^ table[b]).bit_count() <= 2}
    pairs = similarity.near_pairs(rows)
    assert {(r["id_a"], r["id_b"]): r["distance"] for r in pairs.collect()} == want and pairs.count() == len(want) > 700
    links = similarity.near_links(rows)
    assert {(r["id_a"], r["id_b"]): r["distance"] for r in links.collect()}.items() <= want.items() and links.count() <= 61 * len(table)
    found = lambda p: sorted((r["id"], r["cluster_id"]) for r in similarity.clusters(p).collect())
    assert found(links) == found(pairs)
    stats = lambda p: sorted(map(tuple, similarity.cluster_stats(p, similarity.document_clusters(rows, p)).collect()))
    assert stats(links) == stats(pairs)
