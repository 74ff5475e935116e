"""Near copies against all pairs."""

import random

import numpy as np

import corpus_pipeline
from chronoloom.llm import near_copies as nc

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """Smallest id of each row's component by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for g in range(6):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
        rows += [(10_000 + 100 * g + i, changed(rng, words, rng.choice([0, 2, 4, 6, 9, 14]))) for i in range(40)]
    df = spark.createDataFrame([*rows, (9001, None), (9002, " "), (9003, "one two")], "doc_id bigint, text string")
    want = brute([*rows, (9001, None), (9002, " "), (9003, "one two")])
    assert len(set(want.values())) < len(want) - 60
    assert {r.doc_id: r.component_id for r in nc.near_copies(df).collect()} == want
    monkeypatch.setattr(nc, "BLOCK_ROWS", 3)
    assert {r.doc_id: r.component_id for r in nc.near_copies(df).collect()} == want
    assert nc.near_copies(df.limit(0)).count() == 0


def test_pipeline_drops_copies_with_changed_words(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = [(i, changed(rng, words, 2)) for i in range(8)] + [(9, changed(rng, words, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'a' as source", "1L as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()) == sorted(set(brute(rows).values()))
    assert len(set(brute(rows).values())) < 5


def test_pairs_at_the_threshold_meet_in_simhash_tables():
    rng = np.random.default_rng(7)
    bits, tables = nc.bits_and_tables(200_000)
    chosen, far, met = nc.chosen_bits(bits, tables), 0, 0
    for _ in range(200):
        common, own = rng.integers(0, 1 << 64, 800, np.uint64), rng.integers(0, 1 << 64, (2, 100), np.uint64)
        a, b = (nc.fingerprint(np.concatenate([common, x])) for x in own)
        far += int(nc.ones(a ^ b).sum()) > nc.FAR
        x, y = nc.table_keys(np.stack([a, b]), chosen)
        met += bool((x == y).any())
    assert met >= 199 and far <= 1


def test_cells_of_blocks_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    rows = [(i, changed(rng, words, rng.choice([2, 6, 9, 14, 20]))) for i in range(60)]
    monkeypatch.setattr(nc, "BLOCK_ROWS", 3)
    monkeypatch.setattr(nc, "BLOCK_NODES", 8)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in nc.near_copies(df).collect()} == brute(rows)
