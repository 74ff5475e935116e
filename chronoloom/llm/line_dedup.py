"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of WINDOW adjacent lines marks where chunks begin
and end, at LEVELS independent levels: a chunk runs from a line that begins one
to the nearest line that ends one, so both its edges follow from lines inside
it, and what stands around a repeated passage changes neither. One more level
cuts the whole text into consecutive chunks, so that every line lies in one. A
chunk of at least two lines with words that occurs more than once anywhere stays
at its first place (smallest id, then smallest line); every line that another
copy covers goes, after the copy's bytes were compared with the first one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table

#: A passage of two lines is a chunk at one level with a probability of 1/4, so at any of eight with 0.90; the first line of a
#: longer one begins a chunk with 1/2 a level, 0.996 in all.
WINDOW, LEVELS, RESIDUE, MIN_LINES, MAX_LINES = 2, 8, 2, 2, 64
MASK, FACTOR = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: The levels whose bit is set, for each value of LEVELS bits.
BITS = [[k for k in range(LEVELS) if x >> k & 1] for x in range(1 << LEVELS)]
#: Bytes of chunks that a task holds before it hands them on.
BATCH_BYTES = 32 << 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rolled(hashes: list[int]) -> list[int]:
    """The rolling hash over each WINDOW adjacent line hashes."""
    out, roll, gone = [], 0, pow(FACTOR, WINDOW, 1 << 64)
    for i, h in enumerate(hashes):
        roll = (roll * FACTOR + h - (hashes[i - WINDOW] * gone if i >= WINDOW else 0)) & MASK
        if i + 1 >= WINDOW:
            mixed = (roll ^ roll >> 32) * FACTOR & MASK
            out.append(mixed ^ mixed >> 29)
    return out


def chunk_lines(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk in order; chunks of different levels overlap, together they cover all lines.

    Chunks between marks have at most MAX_LINES lines: a mark without its end in that reach begins none.
    """
    marks = rolled(list(map(xxhash.xxh64_intdigest, lines)))
    out, start = set(), 0
    for i, mark in enumerate(marks, WINDOW - 1):
        size = i + 1 - start
        if size >= MIN_LINES and i + 2 < len(lines) and (mark >> 60 & (RESIDUE - 1) == 0 or size >= MAX_LINES):
            out.add((start, size))
            start = i + 1
    out.add((start, len(lines) - start))
    ends, top = [len(lines) + MAX_LINES] * LEVELS, (1 << LEVELS) - 1
    for i in range(len(marks) - 1, -1, -1):
        for k in BITS[marks[i] >> 32 & top]:
            ends[k] = i + WINDOW
        for k in BITS[marks[i] & top]:
            if ends[k] - i <= MAX_LINES:
                out.add((i, ends[k] - i))
    return sorted(out)


def bounds(lines: list[bytes]) -> list[int]:
    """Where each line begins in text, and one past its end."""
    return list(accumulate((len(x) + 1 for x in lines), initial=0))


def chunks(rows: DataFrame) -> DataFrame:
    """(id, th, start, n, h, size) of every chunk of rows(_id, _text) that has two lines with words."""
    kind = rows.schema["_id"].dataType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["id", "th", "start", "n", "h", "size"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            owner, cols = [], [[] for _ in kinds]
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if not text or b"\n" not in text:
                    continue
                th, lines = signed(xxhash.xxh64_intdigest(text, 42)), text.split(b"\n")
                at, worded = bounds(lines), list(accumulate((bool(x.strip()) for x in lines), initial=0))
                for start, n in chunk_lines(lines):
                    if worded[start + n] - worded[start] < MIN_LINES:
                        continue
                    body = text[at[start] : at[start + n] - 1]
                    owner.append(i)
                    for c, v in zip(cols, (th, start, n, signed(xxhash.xxh64_intdigest(body, 1)), len(body)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *map(pa.array, cols, kinds)], names=names)

    return rows.select("_id", "_text").mapInArrow(kernel, f"id {kind.simpleString()}, th bigint, start int, n int, h bigint, size bigint")


def bodies(rows: DataFrame) -> DataFrame:
    """(id, th, start, n, h, size, is_first, chunk): the bytes of the chunks that rows(id, _text, th, wanted) name."""
    kind = rows.schema["id"].dataType
    parts = ("start", "n", "h", "size", "is_first")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            owner, cols, held = [], [[] for _ in kinds], 0
            texts, wanted, hashes = batch.column(1), batch.column(3), batch.column(2).to_pylist()

            def full() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(owner, pa.int32()))  # noqa: B023
                return pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, kinds)], names=["id", "th", *parts, "chunk"])  # noqa: B023

            for i in range(batch.num_rows):
                text = texts[i].as_py().encode()
                at = bounds(text.split(b"\n"))
                for x in wanted[i].as_py():
                    body = text[at[x["start"]] : at[x["start"] + x["n"]] - 1]
                    owner.append(i)
                    held += len(body)
                    for c, v in zip(cols, (hashes[i], *(x[p] for p in parts), body), strict=True):
                        c.append(v)
                    if held > BATCH_BYTES:
                        yield full()
                        owner, cols, held = [], [[] for _ in kinds], 0
            yield full()

    schema = f"id {kind.simpleString()}, th bigint, start int, n int, h bigint, size bigint, is_first boolean, chunk binary"
    return rows.select("id", "_text", "th", "wanted").mapInArrow(kernel, schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cleaned, plus n_lines, removed_lines and removed_chunks, which replace columns of those names; all others stay.

    removed_chunks counts the runs of removed lines. A document that loses every
    line has the empty text; a null text stays null and has no lines. A null id
    comes before all others. Rows that share id and text are one document and
    get equal results. Where a chunk overlaps its own first copy, as in a line
    that is repeated over and over, the lines of that copy that no other covers
    stay. An empty table gives an empty result.
    """
    own = {"_id": F.col(id_col), "_text": F.col(text_col).cast("string")}
    rows = docs.select(*(c.alias(k) for k, c in own.items()))
    place = F.struct("id", "th", "start")
    found = materialize(chunks(rows), "chunks")
    seen = found.groupBy("h", "size").agg(F.count("*").alias("c"), F.min(place).alias("first"))
    repeated = materialize(seen.filter("c > 1").select("h", "size", "first"), "repeated")
    # both sides are written tables, so that a chunk of very many copies can be split
    hits = found.join(repeated.hint("merge"), ["h", "size"]).withColumn("is_first", place.eqNullSafe(F.col("first")))
    hits = materialize(hits.select("id", "th", F.struct("start", "n", "h", "size", "is_first").alias("hit")), "hits")
    wanted = materialize(hits.groupBy("id", "th").agg(F.collect_set("hit").alias("wanted")), "wanted")
    # Spark's xxhash64 of a string is XXH64 of its UTF-8 bytes with seed 42, as the kernel computes it
    texts = rows.filter("_text is not null").withColumn("_th", F.xxhash64("_text"))
    named = texts.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")))
    copies = materialize(bodies(named), "copies")
    kept = materialize(copies.filter("is_first").dropDuplicates(["h", "size"]).select("h", "size", F.col("chunk").alias("original")), "kept")
    later = copies.filter("not is_first").join(kept.hint("merge"), ["h", "size"]).filter(F.col("chunk") == F.col("original"))
    later = materialize(later.select("id", "th", "start", (F.col("start") + F.col("n")).alias("end")), "later")
    by_place = Window.partitionBy("id", "th").orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_place))
    runs = runs.groupBy("id", "th", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n"))
    ranges = runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("_r"))
    ranges = materialize(ranges.select(F.col("id").alias("_rid"), F.col("th").alias("_rth"), "_r"), "ranges")

    # names of the caller's columns are never used for the steps between
    own = iter(n for n in (f"_dedup{i}" for i in range(len(docs.columns) + 9)) if n not in docs.columns)
    rid, rth, r, th, lines, clean = (next(own) for _ in range(6))
    ranges = ranges.withColumnsRenamed({"_rid": rid, "_rth": rth, "_r": r})
    hashed = docs.withColumn(th, F.xxhash64(F.col(text_col).cast("string")))
    both = hashed.join(ranges.hint("merge"), F.col(id_col).eqNullSafe(F.col(rid)) & (F.col(th) == F.col(rth)), "left")
    both = both.withColumn(lines, F.split(F.col(text_col), "\n", -1))
    gap = f"""transform(sequence(0, size({r})), k -> slice({lines}, case when k = 0 then 1 else {r}[k - 1].start + {r}[k - 1].n + 1 end,
      case when k = size({r}) then size({lines}) else {r}[k].start end - case when k = 0 then 0 else {r}[k - 1].start + {r}[k - 1].n end))"""
    both = both.withColumn(clean, F.when(F.col(r).isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(F.expr(gap)), "\n")))
    counts = {
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
        "removed_lines": F.coalesce(F.expr(f"aggregate({r}, 0L, (a, x) -> a + x.n)"), F.lit(0).cast("bigint")),
        "removed_chunks": F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)).cast("bigint"),
    }
    columns = [F.col(clean).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts]
    return both.select(*columns, *(v.alias(k) for k, v in counts.items()))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs)
