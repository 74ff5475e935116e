"""License scans by diagonal voting.

Every rolling word k-gram of every document is hash-joined to the positions of
the same k-gram in license templates (a fixed, small table, so it is broadcast).
Hits vote for their offset diagonal (place in the text minus place in the
template); neighbouring diagonals merge, which bridges an inserted or dropped
word; a merged span counts when the words it matched cover enough of the
template. The join compares the k-gram itself besides its hash, so every word
of a span is verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import table, text_of, words_of

#: Fixed values of the contract: words are separated by these, and these phrases carry these labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
K, NEIGHBOUR, COVERAGE = 4, 2, 0.6

#: Wordings of common licenses and notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def grams_of(words: str) -> str:
    """All rolling k-grams of a word array, space-joined; none for fewer than k words."""
    gram = ", ' ', ".join(f"{words}[i + {j}]" for j in range(K))
    return f"case when size({words}) >= {K} then transform(sequence(0, size({words}) - {K}), i -> concat({gram})) else cast(array() as array<string>) end"


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, t_words, t_pos, t_hash, t_gram); a few rows per template word."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, t string")
    cut = rows.select("template", "label", words_of(F.lower("t"), SEPARATORS).alias("w"))
    out = cut.select("template", "label", F.size("w").alias("t_words"), F.posexplode(F.expr(grams_of("w"))).alias("t_pos", "t_gram"))
    return out.withColumn("t_hash", F.xxhash64("t_gram"))


def places(words: str, phrase: str) -> str:
    """Ascending starts of a phrase in a word array; the joined text is looked at first."""
    parts = phrase.split(" ")
    same = " and ".join(f"{words}[i + {j}] = '{p}'" for j, p in enumerate(parts))
    none = "cast(array() as array<int>)"
    return f"case when contains(_joined, ' {phrase} ') then filter(sequence(0, size({words}) - {len(parts)}), i -> {same}) else {none} end"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Lower-casing is Unicode's; of all characters beyond A-Z only two gain ASCII
    letters by it (the Kelvin sign and the dotted capital I), and neither makes
    or breaks a base phrase. score is 1 with a base phrase, else the best
    verified coverage of a template, rounded to 6 digits, else 0. A null text
    is empty. Rows that share id and text get equal results; a null id is kept.
    Other columns of docs are not read; an empty table gives an empty result.
    """
    text = F.lower(text_of(docs, text_col))
    cut = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(docs, text_col)).alias("_th"), words_of(text, SEPARATORS).alias("_w"))
    joined = cut.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")))
    found = joined.select("_id", "_th", F.size("_w").cast("bigint").alias("n_words"), *(F.expr(places("_w", p)).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)))
    every = F.concat(*(F.col(f"_p{i}") for i in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES))))
    base = found.select("_id", "_th", "n_words", every.alias("_e"), F.array_sort(labels).alias("_b")).select(
        "_id", "_th", "n_words", F.size("_e").cast("bigint").alias("n_base"),
        F.array_min("_e").cast("bigint").alias("first_word"), F.array_max("_e").cast("bigint").alias("last_word"), "_b",
    )

    known = template_grams(docs.sparkSession, templates)
    grams = cut.select("_id", "_th", F.posexplode(F.expr(grams_of("_w"))).alias("pos", "gram")).withColumn("hash", F.xxhash64("gram"))
    hits = grams.join(F.broadcast(known), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    keys = ["_id", "_th", "template", "label", "t_words"]
    votes = hits.groupBy(*keys, (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("ts"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    w = Window.partitionBy("_id", "_th", "template").orderBy("diagonal")
    far = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= NEIGHBOUR, 0).otherwise(1)
    merged = votes.withColumn("_new", far).withColumn("span", F.sum("_new").over(w)).groupBy(*keys, "span")
    spans = merged.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("ts"))
    covered = F.expr(f"aggregate(ts, named_struct('n', {K}, 'last', ts[0]), (a, x) -> named_struct('n', a.n + least({K}, x - a.last), 'last', x), a -> a.n)")
    verified = spans.withColumn("coverage", F.round(covered / F.col("t_words"), 6)).filter(F.col("coverage") >= COVERAGE)
    best = verified.groupBy("_id", "_th").agg(F.collect_set("label").alias("_m"), F.max("coverage").alias("_c"), F.count("*").alias("_n"))

    right = best.select(F.col("_id").alias("_rid"), F.col("_th").alias("_rth"), "_m", "_c", "_n")
    both = base.join(right, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left")
    return both.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("_b", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_b", F.coalesce("_m", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("_b") > 0, 1.0).otherwise(F.coalesce("_c", F.lit(0.0))).alias("score"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_spans"),
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rows = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    cut = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(K))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    place = " union all ".join(
        f"select doc_id, i - 1 as p, '{label}' as label from (select doc_id, w, unnest(range(1, len(w) - {len(p.split()) - 2})) as i from d) where "
        + " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split()))
        for p, label in PHRASES
    )
    return f"""with d as materialized (select doc_id, {cut.format(lower)} as w from documents),
    t as (select template, label, {cut.format("lower(t)")} as w from (values {rows}) v(template, label, t)),
    tg as (select template, label, len(w) as t_words, i - 1 as t_pos, {gram} as gram from (select *, unnest(range(1, len(w) - {K - 2})) as i from t)),
    g as (select doc_id, i - 1 as pos, {gram} as gram from (select *, unnest(range(1, len(w) - {K - 2})) as i from d)),
    h as (select distinct doc_id, template, label, t_words, pos - t_pos as diagonal, t_pos from g join tg using (gram)),
    v as (select distinct doc_id, template, diagonal from h),
    n as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {NEIGHBOUR} then 0 else 1 end as fresh from v),
    s as (select *, sum(fresh) over (partition by doc_id, template order by diagonal) as span from n),
    u as (select distinct doc_id, template, label, t_words, span, unnest(range(t_pos, t_pos + {K})) as word from h join s using (doc_id, template, diagonal)),
    c as (select doc_id, template, label, span, round(count(*) / t_words, 6) as coverage from u group by doc_id, template, label, span, t_words having round(count(*) / t_words, 6) >= {COVERAGE}),
    m as (select doc_id, list(distinct label) as ml, max(coverage) as best, count(*) as n_spans from c group by 1),
    p as ({place}), b as (select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word, list(distinct label) as bl from p group by 1)
    select doc_id, len(w) as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(array_to_string(list_sort(bl), ','), '') as base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') as labels,
      case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score, coalesce(n_spans, 0)::bigint as n_spans
    from d left join m using (doc_id) left join b using (doc_id)"""


ORACLE = _oracle()
