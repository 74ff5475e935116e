"""Quality rules, license scan, URL filter and WARC against SQL, decontamination against plain n-grams, and edge cases."""

import re

import pytest
from oracle import same

from chronoloom.llm.decontaminate import contaminated, op9_benchmark_decontamination
from chronoloom.llm.license_scan import license_scan
from chronoloom.llm.quality_rules import quality_rules
from chronoloom.llm.queries import ORACLE_SQL, QUERIES
from chronoloom.llm.url_filter import url_filter
from chronoloom.llm.warc import lookup, url_key, write_archive

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, name):
    assert same(QUERIES[name](spark, DATA), ORACLE_SQL[name]) > 0


def test_quality_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, long, None, "a"), (4, "x y z " * 30, "en", "a"), (None, long, "en", "a"), (3, long, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as distance", "3 as g")
    got = sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules(df).collect())
    assert got == [("1", 0, 0, True, False), ("2", 0, 0, True, False), ("3", 60, 0, False, True), ("3", 60, 0, False, True), ("4", 90, 90, True, False), ("None", 60, 0, False, True)]
    assert quality_rules(df.limit(0)).count() == 0


def test_quality_rejects_outliers(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60 + i % 40)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{j}$$$%%" for j in range(70)), "en", "a") for i in range(9)]
    df = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")
    assert sorted(r.doc_id for r in quality_rules(df).filter("not kept").collect()) == [1000 + i for i in range(9)]


def test_quality_judges_small_groups(spark):
    text = lambda i: " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(60 + i % 40))
    junk = " ".join(f"w{j}$$$%%" for j in range(70))
    rows = [(i, text(i), "en", "a") for i in range(200)]
    rows += [(1000, junk, "en", "tiny"), (1001, text(3), "en", "tiny"), (1002, junk, None, None), (1003, text(4), "xx", "b"), (1004, junk, "xx", "b")]
    got = quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert sorted(r.doc_id for r in got.filter("not kept").collect()) == [1000, 1002, 1004]


def test_license_edges(spark):
    text = "Start. Permission is hereby granted, free of charge, to ANY person obtaining one copy of this software and associated documentation files. CC-BY cc by. All rights reserved"
    df = spark.createDataFrame([(1, text), (2, None), (None, text), (1, text), (3, "cc by cc by")], "doc_id bigint, text string").selectExpr("*", "1 as label", "2 as pos")
    got = sorted((str(r.doc_id), r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in license_scan(df).collect())
    full = (3, 21, "cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert got == [("1", *full), ("1", *full), ("2", 0, None, "", "", 0.0), ("3", 2, 0, "cc-by", "cc-by", 1.0), ("None", *full)]
    assert license_scan(df.limit(0)).count() == 0


def test_license_bridges_a_changed_word(spark):
    text = "permission is hereby granted free of charge to any human obtaining a copy of this software and associated documentation files"
    row = license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row.labels == "mit" and row.n_spans == 1 and 0.8 < row.score < 1


def test_url_edges(spark):
    urls = [None, "", "nonsense", "http://A.COM", "http://a.com/x", "http://x.example.com/en/1", "http://www.example.com/en/1", "s://b.net/es/a?q#f", "s://b.net/es", "x://y://z/p", "http://net/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'h' as host", "1 as label", "2 as s1")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3][:3] == ("a.com", "", None) and got[4] == ("a.com", "/x", "com/", "allow")
    assert got[5][2:] == ("example.com/en/", "block") and got[6][2:] == ("www.example.com/en/", "allow")
    assert got[7] == ("b.net", "/es/a", "net/es/", "block") and got[8][2] is None and got[9][:2] == ("y:", "//z/p")
    assert got[10][2:] == ("net/fr/", "block") and url_filter(df.limit(0)).count() == 0


def test_url_templates_learn_from_labels(spark):
    rows = [(i, f"http://shop{i % 3}.net/es/{i}") for i in range(60)] + [(100, "http://shop1.net/es")] + [(200 + i, f"http://shop1.net/x{i}/y") for i in range(3)]
    got = {r.page_id: r.verdict for r in url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert all(got[i] == "block" for i in range(60)) and all(got[200 + i] == "allow" for i in range(3))


def test_url_pages_without_a_rule_take_their_siblings_verdict(spark):
    rows = [(i, f"http://a.net/{('es', 'fr')[i % 2]}/{i}/view") for i in range(40)]  # blocked by rules
    rows += [(100 + i, f"http://a.net/de/{i}/view") for i in range(9)]  # no rule, built like them
    rows += [(200 + i, f"http://a.net/about/team/x{i}") for i in range(40)]  # no rule, built otherwise
    rows += [(300 + i, f"http://b.org/de/{i}/view") for i in range(9)]  # a host without labels
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert all(got[i][1] == "block" and got[i][0] for i in range(40)) and all(got[100 + i] == (None, "block") for i in range(9))
    assert all(got[200 + i] == got.get(300 + i, (None, "allow")) == (None, "allow") for i in range(40))


def test_url_templates_at_any_depth(spark):
    deep = "/".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(i, f"http://a.net/{deep}/user{chr(97 + i % 26)}{chr(97 + i // 26)}/post") for i in range(60)] + [(100, "http://a.net/" + "x/" * 2000)]
    got = {r.page_id: r.template for r in url_filter(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert {got[i] for i in range(60)} == {f"/{deep}/*/post"} and got[100].endswith("/x/")


def test_warc_edges(spark):
    big, other = "ß" * 600, "x" * 999
    rows = [(1, "http://a.b/1", big), (2, "http://a.b/2 \r\n", big), (3, None, None), (4, "http://a.b/4", other), (5, "http://a.b/4", other), (None, "u", big), (2, "http://a.b/2 \r\n", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as key", "2 as digest")
    archive = write_archive(df)
    wanted = df.select(url_key(df.url).alias("key"), df.page_id.alias("id"))
    got = sorted((str(r.id), r.payload_bytes, r.record_type, r.refers_to) for r in lookup(spark, archive, wanted).collect())
    assert got == [("1", 1200, "revisit", 2), ("2", 1200, "response", None), ("2", 1200, "response", None), ("3", 0, "response", None), ("4", 999, "response", None), ("5", 999, "response", None), ("None", 1200, "revisit", 2)]
    full = lookup(spark, archive, wanted.filter("id = 2"), with_payload=True).first()
    assert bytes(full.payload).decode() == big
    assert lookup(spark, archive, spark.createDataFrame([("nowhere", 7)], "key string, id bigint")).count() == 0
    empty = write_archive(df.limit(0))
    assert empty.parts == [] and lookup(spark, empty, wanted).count() == 0


def test_warc_ids_of_any_text(spark):
    ids = ["a%41b", "50% \"off\"", "ü > é\n", "", "%"]
    body = "y" * 1500
    df = spark.createDataFrame([(i, "http://a.b/", body) for i in ids], "page_id string, url string, html string")
    got = {r.id: r.refers_to for r in lookup(spark, write_archive(df), df.select(url_key(df.url).alias("key"), df.page_id.alias("id"))).collect()}
    assert got == {i: None if i == max(ids) else max(ids) for i in ids}


def test_warc_lookup_over_many_blocks(spark, monkeypatch):
    from chronoloom.llm import warc

    rows = [(i, f"http://h{i % 5}.org/{i % 11}", f"page {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    archive = write_archive(df)
    search = warc.Searcher(archive)
    for i, url, html in rows[::17]:
        key = f"org,h{i % 5})/{i % 11}"
        assert [x["payload"].decode() for x in search.find(key, i)] == [html] and list(search.find(key, -1)) == []


def test_decontamination_against_plain_ngrams(spark):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: {tuple(words(t)[i : i + 13]) for i in range(len(words(t)) - 12)}
    items = {r.item_id: grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = set()
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        own = grams(d.text)
        want |= {(d.doc_id, i) for i, g in items.items() if g & own}
    got = {(r.doc_id, r.item_id) for r in op9_benchmark_decontamination(spark, DATA).collect()}
    assert got == want


def test_decontamination_slots(spark):
    item = "When a train leaves the station at 60 km then travels for 3 hours we ask Alice how far the train has gone and whether 60 km is enough"
    again = item.replace("60 km", "75 mi").replace("3 hours", "8 hours").replace("Alice", "Robert")
    mixed = item.replace("at 60 km", "at 75 mi")  # 60 km stands for two different values
    rows = [(1, "Before. " + again + " after"), (2, "Before. " + mixed + " after"), (3, "clean text " * 30), (4, None), (None, item), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as h", "2 as item_id")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 7), (None, 7)}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
