"""Slots that are altered one by one: the query and the pipeline judge them window by window."""

import corpus_pipeline
from chronoloom.llm.decontaminate import contaminated, op9_benchmark_decontamination

ITEM = "When a train leaves the station at 60 km then travels for 3 hours we ask Alice how far the train has gone and whether 60 km is enough"
CLOSE = "The red box holds 60 and the blue box 60 old coins that were lost by the museum in the long dry summer before the war"


def test_one_altered_slot_costs_its_windows_only(spark, tmp_path):
    texts = [
        "Before. " + ITEM.replace("at 60 km", "at 75 mi") + " after",  # 20 words and more as in the item
        CLOSE.replace("holds 60", "holds 75"),  # both equal numbers in one window
        CLOSE.replace("holds 60", "holds 75").split(" that ")[0],  # no consistent window holds 13 words
        "clean text " * 30,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'en' as lang", "'a' as source", "1L as n_chars")
    bench = spark.createDataFrame([(7, ITEM), (8, CLOSE)], "item_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in op9_benchmark_decontamination(spark, str(tmp_path)).collect()} == {(0, 7), (1, 8)}
    assert contaminated(docs, bench).count() == 0
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()} == {2, 3}
