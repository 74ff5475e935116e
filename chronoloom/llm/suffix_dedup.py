"""Exact substring dedup with longest-previous-factor arrays.

Every byte covered by a LENGTH-byte string that also starts elsewhere is found,
over all documents, in three steps that stay exact at any size:

1. Anchors. Each LENGTH-byte window owns the smallest hashed K-mer inside it
   (a minimizer), so equal windows own equal K-mers at equal offsets. The
   windows of a text fall into runs that share an anchor; only runs whose K-mer
   occurs elsewhere can repeat. Runs that are equal as a whole form a class; a
   class of two or more repeats in full and needs no comparison.
2. Suffix order. The remaining classes meet in groups of equal K-mers. The
   windows of a batch of groups are put in suffix order by prefix doubling on
   their bytes; the previous smaller position in that order is a window's
   earlier match, its longest previous factor, cut at LENGTH.
3. A K-mer with more than CROWD classes (a phrase in very many surroundings)
   isn't gathered: its runs are cut to cores that every window of a cell shares,
   and only windows of cores that recur are hashed and counted one by one.

The same steps find passages: strings of words, each a 64-bit hash, that another
document holds too, however many bytes they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table

LENGTH, K = 400, 128
CROWD, CELL = 64, 34
#: Words of the shortest passage that is looked for in other documents: over 50.
PASSAGE_WORDS = 51
#: Bytes of a word's hash, and the classes of words that are gathered: at most 85 words each, 0.7 MB in all, which is less than a batch.
WORD, WORD_CROWD = 8, 1024
#: Bytes of runs put in suffix order at once; a group of at most CROWD runs is never split.
BATCH_BYTES = 1 << 20
U64, BASE = np.uint64, 0x9E3779B97F4A7C15
BLOCK = 1 << 18
PLACE_BITS = 20


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64 to the powers 0 to a block's length."""
    if not _POWERS:
        n = BLOCK + LENGTH
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, b, U64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def symbols(data: bytes, width: int) -> bytes:
    """The bytes themselves, or for a width of WORD the hashes of the words between ASCII white space."""
    return data if width == 1 else b"".join(map(xxhash.xxh3_64_digest, data.split()))


def runs(data: bytes, length: int = LENGTH, k: int = K, width: int = 1) -> list[tuple[int, int, int]]:
    """(first window, number of windows, anchor) for each run of windows with one anchor, in order and in symbols of width bytes."""
    n = len(data) // width
    if n < length:
        return []
    if length - k + 1 < 1:
        raise ValueError("the anchor must not be longer than the window")
    up, down = powers()
    raw, out, w = np.frombuffer(data, f"u{width}"), [], length - k + 1
    low = U64((1 << PLACE_BITS) - 1)
    for at in range(0, n - length + 1, BLOCK):
        part = raw[at : at + BLOCK + length - 1]
        windows = len(part) - length + 1
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
        packed = (h & ~low) | np.arange(len(h), dtype=U64)
        pad = -len(packed) % w
        grid = np.concatenate([packed, np.full(pad, ~U64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        low_place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(low_place)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [windows]]))
        out += zip((starts + at).tolist(), sizes.tolist(), (low_place[starts] + at).tolist(), strict=True)
    return out


def occurrences(rows: DataFrame, length: int, k: int, width: int = 1) -> DataFrame:
    """(id, th, place, meta, akey, digest) of every run; meta holds the number of windows and the anchor's offset."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, content = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for batch in batches:
            owner, cols = [], [[] for _ in range(5)]
            ths, places, metas, keys, digests = cols
            for i, data in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                if not data or len(data) < length:
                    continue
                th = signed(content(data, 42))
                data = symbols(data, width)
                found = runs(data, length, k, width)
                owner += [i] * len(found)
                ths += [th] * len(found)
                places += [a for a, _, _ in found]
                metas += [m << 12 | p - a for a, m, p in found]
                keys += [key(data[p * width : (p + k) * width]) for _, _, p in found]
                digests += [key(data[a * width : (a + m - 1 + length) * width], 1 + p - a) for a, m, p in found]
            arrays = [pa.array(ths, pa.int64()), pa.array(places, pa.int64()), pa.array(metas, pa.int32())]
            arrays += [pa.array(np.array(c, U64).view(np.int64)) for c in (keys, digests)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *arrays], names=["id", "th", "place", "meta", "akey", "digest"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.select("_id", "_text").mapInArrow(kernel, f"id {kind}, th bigint, place bigint, meta int, akey bigint, digest bigint")


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Dense ranks of all strings of length symbols of data in order, by prefix doubling."""

    def dense(a: np.ndarray) -> np.ndarray:
        return np.unique(a, return_inverse=True)[1].astype(U64)

    size = min(length, 8 // data.itemsize)
    rank = np.zeros(len(data) - size + 1, U64)
    for j in range(size):
        rank = rank << U64(8) | data[j : len(data) - size + 1 + j].astype(U64)
    rank = dense(rank)
    while size < length:
        step = min(size, length - size)
        m = len(rank) - step
        rank, size = dense(rank[:m] << U64(32) | rank[step : step + m]), size + step
    return rank


def longest_previous(starts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): whether a window has a match elsewhere, and whether an earlier one.

    starts are window positions in text order and ranks their suffix ranks, cut
    at the window length. In suffix order with ties by position, the previous
    smaller position is the neighbour before, if it has the same rank; only
    then the longest previous factor reaches the length.
    """
    order = np.lexsort((starts, ranks))
    same = ranks[order][1:] == ranks[order][:-1]
    later, repeated = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    later[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated | later, later


def found_elsewhere(ranks: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether each window has an equal one, its neighbour in suffix order, of another owner; an owner below zero stands for several."""
    order = np.argsort(ranks, kind="stable")
    ranks, owners = ranks[order], owners[order]
    begin = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
    low, high = np.minimum.reduceat(owners, begin), np.maximum.reduceat(owners, begin)
    out = np.empty(len(ranks), bool)
    out[order] = np.repeat((low < 0) | (low != high), np.diff(np.append(begin, len(ranks))))
    return out


def flag_runs(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
SPANS_SQL = "array<struct<a:int,b:int>>"


def suffix_spans(segments: DataFrame, length: int, width: int = 1) -> DataFrame:
    """(akey, digest, every, later): window ranges of each run that match other runs of its group, and earlier ones; of words, both those of other documents."""

    def solve(group: list[tuple]) -> list[tuple]:
        buffer = np.frombuffer(b"".join(g[3] for g in group), f"u{width}")
        ranks = prefix_ranks(buffer, length)
        sizes = [len(g[3]) // width for g in group]
        ends = np.cumsum(sizes)
        begin = ends - sizes
        counts = np.array([g[2] >> 12 for g in group])
        starts = np.concatenate([np.arange(b, b + c) for b, c in zip(begin, counts, strict=True)])
        if width == 1:
            repeated, later = longest_previous(starts, ranks[starts])
        else:
            own: dict[tuple, int] = {}
            owners = np.array([-1 if g[6] else own.setdefault(g[4:6], len(own)) for g in group])
            repeated = later = found_elsewhere(ranks[starts], np.repeat(owners, counts))
        out, at = [], 0
        for g, c in zip(group, counts.tolist(), strict=True):
            out.append((g[0], g[1], flag_runs(repeated[at : at + c]), flag_runs(later[at : at + c])))
            at += c
        return out

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), SPANS, SPANS)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["akey", "digest", "every", "later"])

        group, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if group and size >= BATCH_BYTES and row[0] != group[-1][0]:
                    yield emit(solve(group))
                    group, size = [], 0
                group.append(row)
                size += len(row[3])
        if group:
            yield emit(solve(group))

    columns = ["akey", "digest", "meta", "seg", "id", "th", "settled"]
    dealt = segments.repartition("akey").sortWithinPartitions("akey", "id", "th", "place")
    return dealt.select(*columns).mapInArrow(kernel, f"akey bigint, digest bigint, every {SPANS_SQL}, later {SPANS_SQL}")


def crowded_spans(segments: DataFrame, length: int, width: int = 1, cell_size: int | None = None, keep_first: bool = False) -> DataFrame:
    """The same for runs of crowded anchors, by counting hashed windows of recurring cores."""
    step = cell_size or CELL

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cells, hashes = [], [], []
            for i, (meta, seg) in enumerate(zip(batch["meta"].to_pylist(), batch["seg"].to_pylist(), strict=True)):
                count, offset = meta >> 12, meta & 4095
                # window w starts r = offset - w symbols before the anchor; all windows of cell r // step share its core
                for cell in range((offset - count + 1) // step, offset // step + 1):
                    first, last = max(0, offset - (cell + 1) * step + 1), min(count - 1, offset - cell * step)
                    if first > last:
                        continue
                    # the part that is common to all windows of the cell, whether they are of this run or not
                    a, z = offset - cell * step, offset - (cell + 1) * step + 1 + length
                    owner.append(i)
                    cells.append(cell)
                    hashes.append(signed(xxhash.xxh3_64_intdigest(seg[a * width : z * width], 3)) if 0 <= a and z * width <= len(seg) else None)
            index = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["akey"].take(index), batch["digest"].take(index), pa.array(cells, pa.int32()), pa.array(hashes, pa.int64())], names=["akey", "digest", "cell", "core"]
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, one, two = [], [], [], []
            for i, (meta, cells, seg) in enumerate(zip(batch["meta"].to_pylist(), batch["cells"].to_pylist(), batch["seg"].to_pylist(), strict=True)):
                count, offset = meta >> 12, meta & 4095
                for cell in cells:
                    for w in range(max(0, offset - (cell + 1) * step + 1), min(count - 1, offset - cell * step) + 1):
                        h = xxhash.xxh3_128_intdigest(seg[w * width : (w + length) * width])
                        owner.append(i)
                        place.append(w)
                        one.append(signed(h >> 64))
                        two.append(signed(h & (1 << 64) - 1))
            index = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(index) for c in ("akey", "digest", "id", "th", "place", "settled")), pa.array(place, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())],
                names=["akey", "digest", "id", "th", "place", "settled", "w", "h1", "h2"],
            )

    kind = segments.schema["id"].dataType.simpleString()
    cut = materialize(segments.select("akey", "digest", "meta", "seg").mapInArrow(cores, "akey bigint, digest bigint, cell int, core bigint"), "cores")
    known = cut.filter("core is not null")
    # written first, so that the join reads two tables and a core of very many runs can be split
    again = materialize(known.groupBy("akey", "cell", "core").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    # a core that leaves its run can't be told apart by hash, so such cells are always looked at
    live = known.join(again, ["akey", "cell", "core"], "left_semi").select("akey", "digest", "cell").unionByName(cut.filter("core is null").select("akey", "digest", "cell"))
    wanted = live.groupBy("akey", "digest").agg(F.collect_set("cell").alias("cells"))
    schema = f"akey bigint, digest bigint, id {kind}, th bigint, place bigint, settled boolean, w int, h1 bigint, h2 bigint"
    found = segments.join(wanted, ["akey", "digest"]).select("akey", "digest", "id", "th", "place", "settled", "meta", "cells", "seg").mapInArrow(windows, schema)
    found = materialize(found, "windows")
    first = F.min(F.struct("id", "th", (F.col("place") + F.col("w")).alias("at")))
    more = repeats(width) if width == 1 else F.max("settled") | repeats(width)
    # written first, so that the join reads two tables and a window of very many runs can be split
    counted = materialize(found.groupBy("h1", "h2").agg(more.alias("more"), first.alias("first")).filter("more").drop("more"), "counted")
    # a settled class repeats in full; only its first run is asked for earlier windows
    hit = (found if keep_first else found.filter("not settled")).join(counted, ["h1", "h2"]).withColumn("is_first", F.struct("id", "th", (F.col("place") + F.col("w")).alias("at")).eqNullSafe(F.col("first")))
    single = lambda c: F.transform(F.array_sort(F.collect_set(c)), lambda w: F.struct(w.alias("a"), (w + 1).alias("b")))
    return hit.groupBy("akey", "digest").agg(single(F.col("w")).alias("every"), single(F.when(~F.col("is_first"), F.col("w"))).alias("later"))


def repeats(width: int) -> Column:
    """Whether a group holds two rows or more; of words, rows of two documents or more."""
    doc = F.struct("id", "th")
    return F.count("*") > 1 if width == 1 else ~F.min(doc).eqNullSafe(F.max(doc))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, keep_first: bool = False, width: int = 1
) -> DataFrame:
    """(id, th, spans) of each document with repeated bytes: spans of bytes, unmerged, in UTF-8.

    th is the XXH64 (seed 42) of the text. With keep_first, only bytes of
    windows that have an earlier copy count, in order of id, th and place. With
    a width of WORD, length, k and spans are in words, and strings count that
    another document holds; rows that share id and text are one document.
    """
    if keep_first and width != 1:
        raise ValueError("keep_first is for bytes")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    every = materialize(occurrences(rows, length, k, width), "runs")
    keys = materialize(every.groupBy("akey").agg(repeats(width).alias("more")).filter("more").select("akey"), "anchors")
    found = materialize(every.join(keys, "akey", "left_semi"), "shared")
    place = F.struct("id", "th", "place", "meta")
    classes = materialize(found.groupBy("akey", "digest").agg(repeats(width).alias("settled"), F.min(place).alias("rep")), "classes")
    groups = classes.groupBy("akey").agg(F.count("*").alias("classes"), F.min("settled").alias("least")).filter("classes > 1" if keep_first else "classes > 1 and not least")
    # written first, so that the next join reads two tables and a crowded anchor can be split
    groups = materialize(groups, "groups")
    compared = materialize(classes.join(groups.drop("least"), "akey").select("akey", "digest", "rep.*", "settled", "classes"), "compared")

    wanted = compared.groupBy("id", "th").agg(F.collect_list(F.struct("akey", "digest", "place", "meta", "settled", "classes")).alias("_s"))
    wanted = materialize(wanted.select(F.col("id").alias("_rid"), F.col("th").alias("_rth"), "_s"), "wanted")
    hashed = rows.withColumn("_th", F.xxhash64("_text"))
    texts = hashed.join(wanted, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth"))).select("_id", "_th", "_text", "_s")

    parts = {"akey": pa.int64(), "digest": pa.int64(), "place": pa.int64(), "meta": pa.int32(), "settled": pa.bool_(), "classes": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, runs_here = symbols(batch.column(2)[i].as_py().encode(), width), batch.column(3)[i].as_py()
                m = len(runs_here)
                segs = [data[s["place"] * width : (s["place"] + (s["meta"] >> 12) - 1 + length) * width] for s in runs_here]
                own = [batch.column(c).take(pa.array([i] * m, pa.int32())) for c in (0, 1)]
                rest = [pa.array([s[c] for s in runs_here], t) for c, t in parts.items()]
                yield pa.RecordBatch.from_arrays([*own, *rest, pa.array(segs, pa.binary())], names=["id", "th", *parts, "seg"])

    kind = rows.schema["_id"].dataType.simpleString()
    segments = texts.mapInArrow(cut, f"id {kind}, th bigint, akey bigint, digest bigint, place bigint, meta int, settled boolean, classes bigint, seg binary").dropDuplicates(["akey", "digest"])
    segments = materialize(segments, "segments")
    crowd = CROWD if width == 1 else WORD_CROWD
    solved = suffix_spans(segments.filter(F.col("classes") <= crowd), length, width)
    crowded = segments.filter(F.col("classes") > crowd)
    if crowded.limit(1).count():
        solved = solved.unionByName(crowded_spans(crowded, length, width, None if width == 1 else max(1, (length - k + 1) // 8), keep_first))
    solved = materialize(solved.filter(F.size("every") > 0), "solved")

    both = classes.join(solved, ["akey", "digest"], "left").filter(F.col("settled") | F.col("every").isNotNull())
    # written first, so that the next join reads two tables and a class of very many runs can be split
    both = materialize(both.select("akey", "digest", "settled", "rep", "every", "later"), "matches")
    matched = found.join(both, ["akey", "digest"])
    whole = F.array(F.struct(F.lit(0).alias("a"), F.shiftright("meta", 12).alias("b"))).cast(SPANS_SQL)
    nothing = F.array().cast(SPANS_SQL)
    if keep_first:
        spans = F.when(place.eqNullSafe(F.col("rep")), F.coalesce("later", nothing)).otherwise(whole)
    else:
        spans = F.when(F.col("settled"), whole).otherwise(F.col("every"))
    bytes_of = F.transform(spans, lambda s: F.struct((F.col("place") + s.a).alias("a"), (F.col("place") + s.b - 1 + length).alias("b")))
    return matched.select("id", "th", bytes_of.alias("s")).groupBy("id", "th").agg(F.flatten(F.collect_list("s")).alias("spans"))


def merge(spans: list[dict] | None) -> list[list[int]]:
    """Spans in order, those that meet or overlap as one."""
    merged: list[list[int]] = []
    for s in sorted({(x["a"], x["b"]) for x in spans or ()}):
        if merged and s[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s[1])
        else:
            merged.append(list(s))
    return merged


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, keep_first: bool = False, with_text: bool = True, passage_words: int = 0
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the kept text.

    Texts are UTF-8 bytes, null is empty; matches never cross documents; cuts
    that split a character leave its other bytes, shown as U+FFFD in the text
    but exact in the digest. Rows that share id and text are copies of each
    other. Other columns are not read; an empty table gives an empty result.

    With passage_words, has_passage and n_passage_words follow: whether the text
    holds that many words in a row that another document holds too, and the
    number of its words in such passages. They are counted, not removed.
    """
    spans = materialize(repeated_spans(docs, id_col, text_col, length, k, keep_first), "spans").withColumn("passages", F.array().cast(SPANS_SQL.replace("int", "bigint")))
    if passage_words:
        words = materialize(repeated_spans(docs, id_col, text_col, passage_words, max(1, passage_words // 3), width=WORD), "passages").withColumnRenamed("spans", "passages")
        both = spans.drop("passages").unionByName(words, allowMissingColumns=True)
        spans = both.groupBy("id", "th").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("spans", "passages")))
    spans = spans.select(F.col("id").alias("_rid"), F.col("th").alias("_rth"), "spans", "passages")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_th", F.xxhash64("_text"))
    both = rows.join(spans, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")), "left").select("_id", "_text", "spans", "passages")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in fields[1:]]
            for text, found, shared in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode()
                merged, kept, at = merge(found.as_py()), [], 0
                for a, b in merged:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                row = [len(data), len(data) - len(rest), len(merged), hashlib.sha256(rest).hexdigest()]
                if with_text:
                    row.append(rest.decode("utf-8", "replace"))
                if passage_words:
                    n = sum(b - a for a, b in merge(shared.as_py()))
                    row += [n > 0, n]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, fields[1:], strict=True))], names=names)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    fields += [*(["kept_text string"] if with_text else []), *(["has_passage boolean", "n_passage_words bigint"] if passage_words else [])]
    names = [id_col, *(f.split()[0] for f in fields[1:])]
    return both.mapInArrow(kernel, ", ".join(fields))


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)
