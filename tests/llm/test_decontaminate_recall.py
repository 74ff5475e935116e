"""Recall on planted questions with other numbers, names and units, and on items that are dense in numbers."""

import random

from chronoloom.llm.decontaminate import contaminated

FRAMES = (
    "{a} bought {x} kg of apples at the market and gave {y} of them to a neighbour before walking home with {b}. How many apples are left in the basket at the end of the day?",
    "A tank holds {x} liters of water and loses {y} liters every hour through a small crack near the bottom. After how many hours will {a} find the tank completely empty?",
    "{a} reads {x} pages each evening. {a} lends the book to {b} after {y} days and never sees it again. How many pages were read before the book was gone for good?",
    "The road from the village to the harbour is {x} km long and a cart covers {y} km every morning. {a} wants to know on which day the cart will reach the harbour",
)
NAMES = ("Alice", "Robert", "Mary Ann", "Jean Luc Martin", "Priya", "Olga")


def question(rng, frame):
    a, b = rng.sample(NAMES, 2)
    return FRAMES[frame].format(a=a, b=b, x=rng.randint(11, 99), y=rng.randint(100, 999))


def test_changed_numbers_names_and_units_are_caught(spark):
    rng = random.Random(7)
    items = [(f, question(rng, f)) for f in range(4)]
    docs = []
    for i in range(200):
        text = question(rng, i % 4)
        for old, new in rng.sample([(" kg", " pounds"), (" liters", " ml"), (" km", " miles"), (" hours", " days")], 2):
            text = text.replace(old, new) if rng.random() < 0.3 else text
        docs.append((i, f"Some text goes before it here. {text} And then more text follows."))
    docs += [(1000 + i, " ".join(rng.choice("the of a cart and road water day book how many".split()) for _ in range(60))) for i in range(50)]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), by_window=True).collect()}
    want = {(i, i % 4) for i in range(200)}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_items_dense_in_numbers_match_as_written(spark):
    item = "1 2 3 4 Anna 5 6 7 Bert 8 9 10 Carl 11 12 13 14 Dora 15"
    other = "2 2 3 4 Anna 5 7 7 Bert 8 8 10 Carl 11 12 14 14 Dora 16"
    docs = spark.createDataFrame([(1, "see " + item), (2, other), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item), (5, item)], "item_id bigint, text string")
    got = contaminated(docs, bench, by_window=True).collect()
    assert [(r.doc_id, r.item_id, r.covered) for r in got] == [(1, 5, 19)]


def test_very_long_and_repeated_texts(spark):
    rng = random.Random(1)
    item = question(rng, 1)
    long = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + item
    docs = spark.createDataFrame([(1, long), (1, long), (2, " ".join([item] * 300))], "doc_id bigint, text string").selectExpr("*", "1 as written", "2 as offset")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string").selectExpr("*", "0 as ipos")
    assert sorted(r.doc_id for r in contaminated(docs, bench, by_window=True).collect()) == [1, 2]
