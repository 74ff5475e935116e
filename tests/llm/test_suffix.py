import hashlib
import random
from collections import Counter

import pytest

from chronoloom.llm import suffix_dedup
from chronoloom.llm.suffix_dedup import op10_suffix_array_dedup, prefix_ranks, runs, substring_dedup

DATA = "/root/testdata/sf0.001"


def brute(texts, length, first=False):
    """(n_bytes, n_removed, n_spans, sha256) of each text by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    before, out = set(), []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            w = d[i : i + length]
            if (w in before) if first else (seen[w] > 1):
                gone[i : i + length] = b"\1" * length
            before.add(w)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs], 400), strict=True))
    assert rows_of(op10_suffix_array_dedup(spark, DATA)) == want


def mixed(seed, n=60):
    """Texts over few letters with shared, shifted, edited, overlapping and periodic parts."""
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice("abcdé ") for _ in range(m))
    shared = [word(rng.randint(10, 90)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice([word(rng.randint(0, 40)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 5))]
        t = "".join(parts)
        if t and rng.random() < 0.4:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("xyz") + t[i + 1 :]
        out.append(t)
    return [*out, "a" * 300, "ab" * 150, None, "", out[0], out[0]]


@pytest.mark.parametrize("crowd", [64, 2])
@pytest.mark.parametrize("first", [False, True])
def test_small_windows_against_brute_force(spark, monkeypatch, crowd, first):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "CELL", 5)
    texts = mixed(crowd)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows_of(substring_dedup(df, length=30, k=9, keep_first=first))
    assert got == dict(enumerate(brute(texts, 30, first)))


def test_runs_cover_every_window_once():
    rng = random.Random(1)
    data = bytes(rng.randrange(3) for _ in range(5000))
    at = 0
    for a, m, p in runs(data, 400, 128):
        assert a == at and a + m - 1 <= p <= a + 400 - 128
        at += m
    assert at == len(data) - 399


def test_prefix_ranks_order_strings():
    import numpy as np

    rng = random.Random(2)
    data = bytes(rng.randrange(2) for _ in range(400))
    r = prefix_ranks(np.frombuffer(data, np.uint8), 21)
    words = [data[i : i + 21] for i in range(len(r))]
    assert all((r[i] < r[j]) == (words[i] < words[j]) and (r[i] == r[j]) == (words[i] == words[j]) for i in range(0, 380, 7) for j in range(380))


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "x" * 10, 2)], "doc_id bigint, text string, spans int")
    assert substring_dedup(df).count() == 2 and substring_dedup(df.limit(0)).count() == 0


def brute_passages(rows, length):
    """(has_passage, n_passage_words) of each text by looking every string of words up in the other documents."""
    split = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for key, words in zip(rows, split, strict=True):
        for i in range(len(words) - length + 1):
            seen.setdefault(tuple(words[i : i + length]), set()).add(key)
    out = []
    for words in split:
        held = bytearray(len(words))
        for i in range(len(words) - length + 1):
            if len(seen[tuple(words[i : i + length])]) > 1:
                held[i : i + length] = b"\1" * length
        out.append((any(held), sum(held)))
    return out


def test_passages_of_over_50_words_on_documents(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.has_passage, r.n_passage_words) for r in op10_suffix_array_dedup(spark, DATA).collect()}
    want = brute_passages(docs, 51)
    assert got == dict(zip([i for i, _ in docs], want, strict=True)) and 0 < sum(h for h, _ in want) < len(docs)


@pytest.mark.parametrize("crowd", [64, 2])
def test_short_passages_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "WORD_CROWD", crowd)
    rng = random.Random(5 + crowd)
    word = lambda m: [rng.choice(["a", "b", "c", "dé", "e"]) for _ in range(m)]
    shared = [word(rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice([word(rng.randint(0, 25)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "\t "]) for p in parts for w in p)))
    # a repeat within one document is none of another; rows that share id and text are one document
    alone = " ".join(f"w{k}" for k in range(30))
    rows += [(200, "x " * 60), (201, f"{alone} | {alone}"), (202, None), (203, ""), (None, rows[0][1]), (None, None)]
    df = spark.createDataFrame([*rows, (201, f"{alone} | {alone}")], "doc_id bigint, text string")
    got = {r.doc_id: (r.has_passage, r.n_passage_words) for r in substring_dedup(df.filter("doc_id is not null or text is not null"), passage_words=12).collect()}
    want = brute_passages(rows, 12)
    assert got == {i: w for (i, t), w in zip(rows, want, strict=True) if i is not None or t is not None}
    assert got[200] == (False, 0) and got[201] == (False, 0) and got[None][0] == want[0][0] and 20 < sum(h for h, _ in want) < 150


def test_a_passage_of_under_400_bytes_is_found(spark):
    passage = " ".join(f"wd{k}" for k in range(51))
    df = spark.createDataFrame([(1, f"one {passage} here"), (2, f"two\n{passage} there"), (3, passage.rpartition(" ")[0])], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.has_passage, r.n_passage_words) for r in substring_dedup(df, passage_words=51).collect()}
    assert got == {1: (0, True, 51), 2: (0, True, 51), 3: (0, False, 0)}
