"""SimHash near-duplicates, verified through a pivot distance table.

Fingerprints are 64-bit SimHashes of word shingles. Links are all pairs of
fingerprints that differ in at most two bits. A table of Hamming distances to
reference fingerprints (pivots) accompanies every distinct fingerprint; by the
triangle inequality a pair whose distances to any pivot differ by more than two
can't link and is discarded before its bits are compared.

Pivot tables alone still face every pair, so pairs only meet inside exact
blocks: of four 16-bit quarters at least two must agree, and each of the six
choices of two quarters is a join key. A key that more than BLOCK_ROWS distinct
fingerprints share (thousands of near copies) isn't joined with itself: its
members emit their neighbours at one bit, and two members link exactly when
they share one, which is linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table
from chronoloom.llm.components import components

WORDS, RADIUS, SEED = 3, 2, 42
BLOCK_ROWS, PIVOTS = 24, 16
CHUNK = 1 << 15


def simhash(text: bytes, k: int = WORDS) -> int:
    """Unsigned fingerprint of whole text: ASCII-lower-cased words, k-word shingles with repeats; zero without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n < k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    begin, end = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(begin), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """(id, fp) with fp as a signed 64-bit number; a null text is empty."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.column(1).type) else pa.binary())
            fps = np.array([simhash(t.as_py() or b"", k) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(kernel, f"id {kind}, fp bigint")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints from a rule: hashes of their numbers, as signed 64-bit numbers."""
    return [x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n))]


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the pivots, eight to a 64-bit column."""
    out = []
    for g in range(0, PIVOTS, 8):
        packed = F.lit(0).cast("bigint")
        for i, p in enumerate(pivots()[g : g + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("bigint"), 8 * i))
        out.append(packed.alias(f"p{g // 8}"))
    return out


def within_pivots(left: str, right: str, radius: int = RADIUS) -> Column:
    """Whether no pivot coordinate differs by more than radius."""
    ok = F.lit(True)
    for g in range(PIVOTS // 8):
        for i in range(8):
            a, b = (F.shiftrightunsigned(F.col(f"{side}.p{g}"), 8 * i).bitwiseAND(F.lit(255)) for side in (left, right))
            ok = ok & (F.abs(a - b) <= radius)
    return ok


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct(fp) that connect exactly the fingerprints within two bits of each other."""
    fp = F.col("fp")
    quarter = [F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    choices = list(combinations(range(4), 2))
    keys = F.array(*(F.shiftleft(F.lit(c).cast("bigint"), 32) + F.shiftleft(quarter[i], 16) + quarter[j] for c, (i, j) in enumerate(choices)))
    blocked = distinct.select("fp", F.explode(keys).alias("key"))
    counts = materialize(blocked.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
    small = blocked.join(counts.filter(F.col("n") <= BLOCK_ROWS).select("key"), "key").select("key", "fp", *pivot_table(fp))
    near = (F.col("a.fp") < F.col("b.fp")) & within_pivots("a", "b") & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    crowded = blocked.join(counts.filter(F.col("n") > BLOCK_ROWS).select("key"), "key").select("fp").distinct()
    flips = F.concat(F.array(fp), F.array(*(fp.bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i).cast("bigint")) for i in range(64))))
    # at most 65 fingerprints lie within one bit of a value, so each list is bounded
    shared = crowded.select("fp", F.explode(flips).alias("middle")).groupBy("middle").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """(id, fingerprint, component_id) per row of docs; other columns of docs are not read.

    Null and empty texts have the fingerprint zero and link like any other.
    component_id is the smallest non-null id of the component. Repeated rows
    each get their row. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, k), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    # written first, so that the join reads two tables and a very large component can be split
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = materialize(rooted.select("fp", "root").join(firsts, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
