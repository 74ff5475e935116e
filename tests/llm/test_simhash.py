import random

import xxhash
from pyspark.sql import Row

from chronoloom.llm.simhash_dedup import links, near_duplicates, op3_simhash_near_dedup, simhash

DATA = "/root/testdata/sf0.001"


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute(fps):
    """Component of each item by comparing all pairs."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", docs[r].doc_id) for d, f, r in zip(docs, fps, brute(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_near_dedup(spark, DATA).collect()}
    assert got == want


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r.a, r.b) for r in links(spark.createDataFrame([Row(fp=f) for f in signed])).collect()}
    for a, b in got:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    index = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(signed)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        x, y = sorted((root(index[a]), root(index[b])))
        parent[y] = x
    assert [root(i) for i in range(len(signed))] == brute([f & (1 << 64) - 1 for f in signed])


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (None, "a b c d", "x"), (5, "A B c D", "x"), (5, "a b c d", "x"), (6, "one", "x"), (7, "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((str(r.doc_id), r.component_id) for r in near_duplicates(df).collect())
    assert got == [("1", 1), ("2", 1), ("3", 1), ("5", 5), ("5", 5), ("6", 6), ("7", 7), ("None", 5)]
    assert near_duplicates(df.limit(0)).count() == 0
    assert simhash(b"") == 0
