"""Line dedup, packing, HTML and the pipeline against brute force, and edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from chronoloom.llm.html_text import extract, html_to_text
from chronoloom.llm.line_dedup import chunk_lines, line_dedup
from chronoloom.llm.packing import END_ID, default_tokenizer, first_fit_decreasing, op6_packing, pack

DATA = "/root/testdata/sf0.001"


def brute_lines(rows):
    """Texts after removing every line of later copies of chunks, by comparing the chunks themselves in order of id."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines, gone = (text or "").split("\n"), set()
        for start, n in chunk_lines([x.encode() for x in lines]) if len(lines) > 1 else []:
            part = lines[start : start + n]
            if sum(1 for x in part if x.encode().strip()) >= 2:
                body = "\n".join(part)
                gone |= set(range(start, start + n)) if body in seen else set()
                seen.add(body)
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(40)] + ["", " "]
    passages = [[rng.choice(pool) for _ in range(rng.randint(4, 14))] for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [rng.choice([[rng.choice(pool) for _ in range(3)], rng.choice(passages)]) for _ in range(rng.randint(0, 4))]
        rows.append((i, "\n".join(x for p in parts for x in p)))
    rows.append((500, None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as h", "2 as start", "3 as n_lines0")
    got = {r.doc_id: r.text for r in line_dedup(df).collect()}
    assert got == brute_lines(rows)
    assert sum(1 for i, t in rows if got[i] != t) > 20


def test_line_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: r.text for r in line_dedup(docs).collect()} == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_line_dedup_edges(spark):
    body = "\n".join(f"a line {i}" for i in range(9))
    df = spark.createDataFrame([(2, body), (1, body), (2, body), (None, body), (3, None), (4, "")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.text is None or len(r.text) > 0) for r in line_dedup(df).collect())
    assert got == [("1", False), ("2", False), ("2", False), ("3", True), ("4", False), ("None", True)]
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    body = "\n".join(f"a line {i}" for i in range(9))
    df = spark.createDataFrame([(1, body), (2, body)], "doc_id bigint, text string").selectExpr("*", "7 as _th", "8 as _r", "9 as _dedup0", "'x' as _rid", "5 as n_lines")
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    assert (got[1]._th, got[1]._r, got[1]._dedup0, got[1]._rid, got[1].n_lines) == (7, 8, 9, "x", 9)
    assert got[1].text == body and got[2].text == "" and got[2].removed_lines == 9


def test_chunks_resist_shifts():
    lines = [f"{i * i % 1009} x".encode() for i in range(400)]
    cut = lambda x: {b"\n".join(x[a : a + n]) for a, n in chunk_lines(x)}
    assert {k for a, n in chunk_lines(lines) for k in range(a, a + n)} == set(range(400))
    assert len(cut(lines) - cut([b"new"] + lines)) <= 3


def test_line_dedup_recall_on_passages(spark):
    rng = random.Random(8)
    passages = [[f"passage {p} line {k}" for k in range(2 + p % 9)] for p in range(300)]
    texts = [[f"before {c} {p}", *lines, f"after {c} {p}"] for c in range(2) for p, lines in enumerate(passages)]
    rows = [(i, "\n".join([f"head {i} {rng.random()}" for _ in range(i % 3)] + x)) for i, x in enumerate(texts)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].removed_lines == 0 for i in range(300)) and all(f"before 1 {i}" in got[300 + i].text and f"after 1 {i}" in got[300 + i].text for i in range(300))
    assert sum(got[300 + i].removed_lines for i in range(300)) >= 0.95 * sum(map(len, passages))


def test_line_dedup_on_a_very_long_text_and_equal_lines(spark):
    long = "\n".join(f"long line {i}" for i in range(60_000))
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame([(1, long), (2, "x\n" + long), (3, "same\n" * 5000)], "doc_id bigint, text string")).collect()}
    assert got[1].text == long and got[2].removed_lines == 60_000 and got[2].text == "x"
    assert set(got[3].text.split("\n")) == {"same", ""}


def test_no_last_line_stands_alone():
    for n in range(2, 60):
        found = chunk_lines([f"{n} {i}".encode() for i in range(n)])
        assert min(size for _, size in found) >= 2 and sum(size for _, size in found) == n


def check_packing(rows, texts, length=2048):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_tokenizer())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in texts.items():
        exact = [*fresh.encode(text or "", add_special_tokens=False).ids, END_ID]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            part = np.array(exact[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(exact) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(exact)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return sum(r.length for r in rows) / (length * len(by_seq))


def test_packing_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert check_packing(op6_packing(spark, DATA).collect(), texts) > 0.95


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "long words " * 9000, 4: "<|endoftext|> мир 你好 \U0001f600 ǅ", 5: "a" * 5000, 6: "  \n\n\t x", 7: "a <|endoftext|> b", 8: "<|endoftext|>", 9: "<|endoftext |> <|"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").selectExpr("*", "1 as length", "2 as salt")
    check_packing(pack(df, group_pieces=2).collect(), texts)
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "x"), (7, "x")], "doc_id bigint, text string")
    assert pack(twice).count() == 4 and pack(twice.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_first_fit_decreasing(sizes):
    bins, offsets = first_fit_decreasing(np.array(sizes), 50)
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            b = len(free)
            free.append(50)
        want[i] = b, 50 - free[b]
        free[b] -= sizes[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(sizes))]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One<b>two</b> three<p>Four<br>five", "Onetwo three\n\nFour\nfive"),
        ("a  <i>b </i> c&nbsp;d &lt;x&gt;", "a b c\xa0d <x>"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>", "Name       Qty\nApple pie  3"),
        ("<style>.ad{display:none}#k,em{visibility:hidden}</style><div class='x ad'>no</div><em>no</em><p id=k>no</p>yes", "yes"),
        ("<div hidden>n</div><span style='display: none'>n</span><script>'</p>'</script><template>n</template>y", "y"),
        ("<pre>\n a  b\n   c</pre>d", " a  b\n   c\n\nd"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("x <!-- <p>no --> y </nothing> <3 < z", "x y <3 < z"),
        ("<title>t</title><textarea>a <b></textarea>", "a <b>"),
        ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
        ("<table><tr>stray<form><td>a</td><td>b</td></form></tr><tr><td>cc<td>d</table>", "stray\na   b\ncc  d"),
        ("<table><tbody>loose<tr><td>x</table>", "loose\nx"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
        ("", ""),
        ("<p", ""),
        ("<a href=\"x", ""),
    ],
)
def test_html(html, text):
    assert html_to_text(html)[1] == text


def test_html_edges(spark):
    deep = "<div><ul><li>" * 5000 + "x"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<b>hi"), (None, "<table>" * 300 + "<tr><td>y"), (5, deep)], "page_id bigint, html string").selectExpr("*", "1 as text")
    got = {r.page_id: r.text.strip() for r in extract(df).collect()}
    assert got[1] == got[2] == "" and got[3] == "hi" and got[None] == "y" and got[5].endswith("x")
    assert extract(df.limit(0)).count() == 0


def test_html_hostile_pages_stay_linear():
    import time

    def seconds(html):
        began = time.process_time()
        assert html_to_text(html)[1].endswith("x")
        return time.process_time() - began

    for part in ("<div>", "<p><button><div>", "<b></i>", "<ul><li>"):
        assert seconds(part * 16_000 + "x") < 12 * max(seconds(part * 4000 + "x"), 0.02)
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>b" + "<tr><td>a<td>b" * 2000 + "</table>x"
    assert len(html_to_text(wide)[1]) < 4 * len(wide)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p> <b> </b> <li> <ul> </ul> <table> <tr> <td> </table> x &amp; <!-- --> <script> </script> < > \" <a href='".split()), max_size=30))
def test_html_never_fails(parts):
    html_to_text(" ".join(parts))


def test_pipeline_stages(spark):
    """Each stage on its own input against what its operator's brute force keeps; the end packs every token left."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = corpus_pipeline.materialize(stage(spark, kept, DATA), name)
        after = {r.doc_id: r.text for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before) and kept.count() == len(after)
        if name == "line_dedup":
            want = brute_lines(list(before.items()))
            assert after == {i: t for i, t in want.items() if t == before[i] or t.split()}
        else:
            assert all(after[i] == before[i] for i in after)
    check_packing(corpus_pipeline.packing(spark, kept, DATA).collect(), {r.doc_id: r.text for r in kept.collect()})
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()).keys() == {r.doc_id for r in kept.collect()}


def test_pipeline_drops_by_id_and_text(spark):
    long, leak = " ".join(f"w{i}" for i in range(60)), spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(1, "short"), (1, long), (None, "short"), (None, long), (2, None), (3, leak), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'a' as source", "1L as n_chars")
    keep = {(1, long), (None, long), (3, long)}
    assert {(r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, DATA).collect()} == keep
    assert {(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, DATA).collect()} == set(rows) - {(3, leak)}


def test_pipeline_edges(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    odd = docs.limit(4).withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10_000})
    lost = docs.limit(3).withColumn("doc_id", F.lit(None).cast("bigint"))
    for df in (docs.unionByName(odd).unionByName(lost).unionByName(docs.limit(5)).withColumn("h", F.lit(1)), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.materialize(stage(spark, df, DATA), name)
        assert df.count() >= 0
