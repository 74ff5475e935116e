"""SimHash near-dedup at a word-shingle similarity: fingerprints, pivot distance table, verification on whole shingle sets.

Two texts link when the Jaccard similarity of their sets of k-word shingles is
at least PERCENT. At 0.8 two SimHashes differ in 15.15 % of their bits, a
radius that leaves no exact block in 64 bits, so a text has a SimHash of
WORDS64 * 64 bits and candidates meet in tables: a table's key are some of
those bits, chosen by a rule. bits_and_tables takes enough bits that a text meets
another in a table by chance in at most one of four cases, and enough tables that
a pair at 0.8 shares no key with a probability of at most MISSED. Both follow from the number of
texts alone. A candidate pair whose distances to any reference fingerprint differ by
more than RADIUS is discarded by the pivot table, one that differs in more than
RADIUS of its first 64 bits or in more than FAR of all by its fingerprints, and the
rest is verified on the sets. Texts with equal sets are one node.

Keys are met twice. First, one node of a large key, the text that the others
seem to be copies of, is paired with the rest. That links all but a few. Then all
nodes that can be similar to another of their key are paired in it, in cells of two
blocks of a key's nodes, only across the components that the first pairs have made and
by all bits. The comparisons there grow with
the copies that are too far from a central text times all copies of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, sized_broadcast
from chronoloom.llm.components import components
from chronoloom.llm.simhash_dedup import pivots

WORDS, PERCENT, RADIUS = 5, 80, 22
WORDS64, SEED = 16, 42
BITS = 64 * WORDS64
#: Share of bits in which two texts at 0.8 differ, and the probability that they share no key.
DIFFER, MISSED = 0.1515, 1e-4
#: Differing bits beyond which a pair is discarded (at 0.8: 155, standard deviation 11.5), and the same for sets of at most TINY shingles, whose bits are coarser (192, 12.5).
FAR, FAR_TINY, TINY = 200, 260, 8
#: Nodes beyond which a key is large.
BLOCK_ROWS = 24
#: Nodes of a key in a block.
BLOCK_NODES = 2048
#: Hashes counted at once, as eight counters share a 64-bit word.
CHUNK = 255
#: Nodes with candidates (about 60 bytes each) whose first texts are found by a broadcast join; more are joined by shuffle.
BROADCAST_NODES = 200_000
_rng = np.random.default_rng(SEED)
_numbers = _rng.integers(0, 1 << 64, (2, WORDS64), np.uint64)
FACTORS, TERMS = _numbers[0] | np.uint64(1), _numbers[1]
LANES = np.uint64(0x0101010101010101)
TABLE_SHIFT = 48


def bits_and_tables(nodes: int) -> tuple[int, int]:
    """How many bits a key has, and how many tables there are, for that many nodes."""
    bits = max(8, (max(nodes, 1) - 1).bit_length() + 2)
    # of BITS bits d differ; a table of random bits misses them all with hit(d)
    d = np.arange(BITS - bits + 1)
    choose = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, BITS + 1))]))
    weight = np.exp(choose[BITS] - choose[d] - choose[BITS - d] + d * np.log(DIFFER) + (BITS - d) * np.log1p(-DIFFER))
    hit = np.exp(choose[BITS - d] - choose[BITS - d - bits] - choose[BITS] + choose[BITS - bits])
    tables = 8
    while (weight * (1 - hit) ** tables).sum() > MISSED:
        tables += max(8, tables // 32)
    return bits, tables


@lru_cache(maxsize=4)
def chosen_bits(bits: int, tables: int) -> np.ndarray:
    """The bits of each table's key."""
    rng = np.random.default_rng([SEED, bits])
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(tables)])


def table_keys(words: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(texts, tables) keys of fingerprints (texts, WORDS64), each with its table's number in front."""
    every = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), BITS // 8), axis=1, bitorder="little")
    out = np.zeros((len(words), len(chosen)), np.int64)
    for column in chosen.T:
        out = out << 1 | every[:, column]
    return out | np.arange(len(chosen), dtype=np.int64) << TABLE_SHIFT


def shingles(text: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles of ASCII-lower-cased words; fewer words than k are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), SEED) for i in range(max(1, len(words) - k + 1))], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set as WORDS64 signed words: a bit is 1 if set in over half the hashes. The first word's bits are the hashes' own, the others' of mixed ones."""
    total = np.zeros((8, WORDS64, 8), np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK, None]
        z = (h ^ TERMS) * FACTORS
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        z[:, 0] = h[:, 0]
        for i in range(8):
            total[i] += (z >> np.uint64(i) & LANES).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(WORDS64, 8)
    over = 2 * total.transpose(1, 2, 0).reshape(WORDS64, 64) > len(hashes)
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).ravel()


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, th): a null text is empty, and th is the hash of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("th"))


def sketches(rows: DataFrame, k: int) -> DataFrame:
    """(id, th, sig, n, words) of rows(id, t, th); sig is a 128-bit hash of the shingle set, words its SimHash."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                hashes = shingles(text.as_py().encode(), k)
                found.append((xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), fingerprint(hashes)))
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()))
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["id", "th", "sig", "n", "words"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, th bigint, sig binary, n int, words array<bigint>")


def ones(x: np.ndarray) -> np.ndarray:
    """1-bits of signed words; numpy by itself counts those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def word_rows(column: pa.Array) -> np.ndarray:
    """(rows, WORDS64) of a column of fingerprints."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS64)


def keyed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(key, node, n, fp) for every table; fp is the first word. Sets without shingles have no keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = chosen_bits(bits, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                words = word_rows(part.column(2))
                own = [np.repeat(x, tables) for x in (part.column(0).to_numpy(), part.column(1).to_numpy(), words[:, 0])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table_keys(words, chosen).ravel(), *own)], names=["key", "node", "n", "fp"])

    return nodes.filter("n > 0").select("node", "n", "words").mapInArrow(kernel, "key bigint, node bigint, n int, fp bigint")


def alike(n: np.ndarray, fp: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether the nodes at x and y can be similar, by their sizes, the pivot table and their first 64 bits."""
    table = ones(fp[:, None] ^ np.array(pivots(), np.int64)).astype(np.int16)
    ok = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
    ok[ok] = (np.abs(table[x[ok]] - table[y[ok]]) <= RADIUS).all(axis=1)
    ok[ok] = ones(fp[x[ok]] ^ fp[y[ok]]) <= RADIUS
    return ok


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, key) of rows(key, node, n, fp): the pairs of the central node of each large key, key null; and each node a of a key that can be similar to another there, b null."""
    most = BLOCK_ROWS

    def of_copies(node: np.ndarray, n: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
        """The pairs of a large key's most central node, the one nearest to the majority of the bits."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1)
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(fp)).view(np.int64)
        centre = int(np.lexsort((node, ones(fp ^ middle)))[0])
        y = np.delete(np.arange(len(node)), centre)
        y = y[alike(n, fp, np.full(len(y), centre), y, percent)]
        return np.minimum(node[centre], node[y]), np.maximum(node[centre], node[y]), None

    def split(key: np.ndarray, node: np.ndarray, n: np.ndarray, fp: np.ndarray, hot: int | None) -> list[tuple]:
        """What whole keys give."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        large = sizes > most if hot is None else (sizes > most) | (key[starts] == hot)
        run = np.repeat(np.arange(len(starts)), sizes)
        at = np.flatnonzero((sizes[run] > 1) & ~large[run])
        pairs = [np.zeros((2, 0), np.int64)]
        for d in range(1, most):
            at = at[at + d < len(key)]
            at = at[run[at + d] == run[at]]
            if not len(at):
                break
            pairs.append(np.stack([at, at + d]))
        x, y = np.concatenate(pairs, axis=1)
        used = np.unique(np.concatenate([x, y]))
        ok = alike(n[used], fp[used], np.searchsorted(used, x), np.searchsorted(used, y), percent)
        met = np.unique(np.concatenate([x[ok], y[ok]]))
        out = [(node[met], None, key[met])]
        for r in np.flatnonzero(large):
            own = slice(starts[r], starts[r] + sizes[r])
            out += [of_copies(node[own], n[own], fp[own]), (node[own], None, key[own])]
        return out

    def emit(parts: list) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size = len(part[0])
            if size:
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if x is None else pa.array(x) for x in part], names=["a", "b", "key"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(cols[0][-1])
            start = int(np.searchsorted(cols[0], last))
            if start:
                yield from emit(split(*(c[:start] for c in cols), hot))
            held = [c[start:] for c in cols]
            # a large key's rows go on as they come; of a small one at most BLOCK_ROWS are held
            if last == hot or len(held[0]) > most:
                hot = last
                yield from emit([of_copies(*held[1:]), (held[1], None, held[0])])
                held = None
        if held is not None:
            yield from emit(split(*held, hot))

    return rows.repartition("key").sortWithinPartitions("key").select("key", "node", "n", "fp").mapInArrow(kernel, "a bigint, b bigint, key bigint")


def shingle_sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of every node of wanted, computed again from the first text that has it."""
    first = nodes.join(wanted.hint("merge"), "node", "left_semi")
    first = materialize(first.select("node", F.col("f.id").alias("_fid"), F.col("f.th").alias("_fth")), "texts")
    chosen = rows.join(sized_broadcast(first, BROADCAST_NODES), F.col("id").eqNullSafe(F.col("_fid")) & (F.col("th") == F.col("_fth"))).select("node", "t")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingles(t.as_py().encode(), k) for t in batch.column(1).slice(at, 1000)]
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), hashes], names=["node", "shingles"])

    return chosen.mapInArrow(kernel, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def unequal(left: str, right: str) -> Column:
    """How many bits of two fingerprints differ."""
    out = F.lit(0)
    for w in range(WORDS64):
        out = out + F.bit_count(F.get(left, F.lit(w)).bitwiseXOR(F.get(right, F.lit(w))))
    return out


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose fingerprints are near and whose shingle sets are similar; pairs may repeat."""
    pairs = materialize(pairs.distinct(), name)
    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("words").alias("wa")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("words").alias("wb")), "b")
    far = F.when(F.least("na", "nb") <= TINY, FAR_TINY).otherwise(FAR)
    pairs = materialize(both.filter(unequal("wa", "wb") <= far).select("a", "b"), f"{name}_near")
    wanted = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    sets = materialize(shingle_sets(rows, nodes, wanted, k), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    sizes = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("s"))
    return sizes.filter(100 * F.col("common") >= percent * (F.col("s") - F.col("common"))).select("a", "b")


def keyed_again(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(key, node, root, n, words) of nodes(node, root, n, words, tables) for the tables they list."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = chosen_bits(bits, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                listed = part.column(4).to_pylist()
                row = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
                key = table_keys(word_rows(part.column(3)), chosen)[row, np.concatenate(listed)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(part.column(c).take(pa.array(row)) for c in range(4))], names=["key", "node", "root", "n", "words"])

    return nodes.select("node", "root", "n", "words", "tables").mapInArrow(kernel, "key bigint, node bigint, root bigint, n int, words array<bigint>")


def across(rows: DataFrame, bits: int, tables: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a key of rows(key, node, root, n, words), in cells of two blocks of a key's nodes."""
    blocks = F.ceil(F.count("*").over(Window.partitionBy("key")) / BLOCK_NODES).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "n", "words", "own")

    most = BLOCK_ROWS

    def candidates(run: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, own: np.ndarray, words: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within each run of rows (a cell), of different components and, where a cell is of two blocks, of both."""
        sizes = np.bincount(run)
        at, found = np.flatnonzero(sizes[run] <= most), []
        for d in range(1, most):
            at = at[at + d < len(run)]
            at = at[run[at + d] == run[at]]
            ok = (root[at] != root[at + d]) & (~two[at] | (own[at] != own[at + d]))
            found.append(np.stack([at[ok], at[ok] + d]))
        for r in np.flatnonzero(sizes > most):
            here = np.flatnonzero(run == r)
            names, counts = np.unique(root[here], return_counts=True)
            main = names[counts.argmax()]
            # of two components one isn't the largest; a pair of two such is taken once
            for x in here[root[here] != main]:
                ok = (root[here] != root[x]) & ((root[here] == main) | (node[here] > node[x])) & (~two[x] | (own[here] != own[x]))
                y = here[ok]
                y = y[ones(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= FAR_TINY]
                found.append(np.stack([np.full(len(y), x), y]))
        x, y = np.concatenate(found, axis=1)
        return x, y

    def solve(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        key, node, n, words = (cols[c] for c in ("key", "node", "n", "words"))
        run = np.cumsum(np.concatenate([[False], (np.diff(key) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)]))
        x, y = candidates(run, node, cols["root"], n, cols["own"], words, cols["i"] != cols["j"])
        ok = alike(n, words[:, 0], x, y, percent)
        x, y = x[ok], y[ok]
        ok = ones(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= np.where(np.minimum(n[x], n[y]) <= TINY, FAR_TINY, FAR)
        x, y = x[ok], y[ok]
        names, first, at = np.unique(node[np.concatenate([x, y])], return_index=True, return_inverse=True)
        keys, number = table_keys(words[np.concatenate([x, y])[first]], chosen_bits(bits, tables)), np.arange(tables)
        # a pair comes from the first of the tables it shares alone
        ok = np.ones(len(x), bool)
        for c in range(0, len(x), 1000):
            p, q = at[: len(x)][c : c + 1000], at[len(x) :][c : c + 1000]
            ok[c : c + 1000] = ~((keys[p] == keys[q]) & (number < (key[x[c : c + 1000]] >> TABLE_SHIFT)[:, None])).any(axis=1)
        x, y = node[x[ok]], node[y[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: word_rows(batch[c]) if c == "words" else batch[c].to_numpy() for c in names}
            if held is not None:
                cols = {c: np.concatenate([held[c], x]) for c, x in cols.items()}
            last = (cols["key"] == cols["key"][-1]) & (cols["i"] == cols["i"][-1]) & (cols["j"] == cols["j"][-1])
            start = len(last) - int(last.sum())
            if start:
                yield solve({c: x[:start] for c, x in cols.items()})
            held = {c: x[start:] for c, x in cols.items()}
        if held is not None:
            yield solve(held)

    names = cells.columns
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(kernel, "a bigint, b bigint")


def links(rows: DataFrame, nodes: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect what similar pairs of nodes(node, n, words, f) connect; rows hold their texts."""
    bits, tables = bits_and_tables(nodes.count())
    met = materialize(meetings(keyed(nodes, bits, tables), percent), "met")
    found = materialize(verified(met.filter("key is null").select("a", "b"), rows, nodes, k, percent, "pairs"), "links")
    again = met.filter("key is not null").groupBy(F.col("a").alias("node"))
    again = materialize(again.agg(F.collect_list(F.shiftright("key", TABLE_SHIFT).cast("int")).alias("tables")), "again")
    if not again.limit(1).count():
        return found
    rooted = again.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.join(nodes.drop("f"), "node"), "rooted")
    pairs = across(keyed_again(rooted, bits, tables), bits, tables, percent)
    return found.unionByName(verified(pairs, rows, nodes, k, percent, "rest"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, component_id) per row of docs; other columns of docs are not read.

    Texts without words link with each other. component_id is the smallest
    non-null id of the component. Repeated rows each get their row. An empty
    table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    prints = materialize(sketches(rows, k), "sketches")
    firsts = prints.groupBy("sig").agg(F.min("id").alias("first"), F.min(F.struct("id", "th")).alias("f"))
    firsts = materialize(firsts.withColumn("node", F.monotonically_increasing_id()), "firsts")
    nodes = materialize(prints.select("sig", "n", "words").dropDuplicates(["sig"]).join(firsts, "sig").select("node", "n", "words", "f"), "nodes")
    roots = components(links(rows, nodes, k, percent))
    rooted = materialize(firsts.select("sig", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = materialize(rooted.select("sig", "root").join(least, "root").select("sig", "component_id"), "named")
    return prints.select("id", "sig").join(named, "sig").select(F.col("id").alias(id_col), "component_id")
