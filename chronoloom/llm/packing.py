"""Packing tokenised documents into fixed-length sequences.

First-fit decreasing over a tournament tree of bin capacities, run on its own
in each of many randomised groups of documents. Only piece lengths reach the
packing step; a group is a bounded number of pieces whatever the input's size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, table

LENGTH, END_ID, GROUP_PIECES = 2048, 1, 40_000
#: Beyond these characters the split into words could depend on a library's Unicode tables.
RARE = re.compile(r"[^\u0000-ɏ‐-›]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file, equal to the tokenizers library's.

    The file's vocabulary is run by tiktoken, which gives the same ids several
    times faster; text with characters outside the common Latin blocks, and text
    that spells an added token, goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.added = file["model"], [t["content"] for t in file.get("added_tokens") or ()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        special = {*self.added, *(t for t in model["vocab"] if t.startswith("<|") and t.endswith("|>"))}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)

    def __call__(self, text: str) -> list[int]:
        if not text.isascii() and RARE.search(text) or any(t in text for t in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(id, salt, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at multiples of length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from chronoloom.llm.packing import encoder  # the module's own cache, not a pickled copy

        encode, task, count = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            owner, cols = [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                salt, count = xxhash.xxh64_intdigest(f"{task} {count}") >> 1, count + 1
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    owner.append(i)
                    for c, v in zip(cols, (salt, at, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, pa.int64()) for c in cols)],
                names=["id", "salt", "start", "length", "ids_crc32", "doc_tokens"],
            )

    schema = f"id {kind}, salt bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(kernel, schema)


def first_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every size: the largest first, each into the first bin with room.

    The leaves of the tree are the bins' free capacities in order; an inner
    node holds the larger of its children, so the first bin with room is found
    from the root in one descent.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [length] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, length - tree[node]
        tree[node] -= size
        node >>= 1
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of docs is a document, repeated rows and null ids included. A
    null or empty text is the end id alone. Pieces of a sequence lie gapless
    from offset 0; the rest of its length positions is padding. Full pieces are
    sequences of their own. Other columns are not read; an empty table gives an
    empty result.
    """
    cut = materialize(pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), length), "pieces")
    groups = max(1, -(-cut.filter(F.col("length") < length).count() // group_pieces))
    kind = cut.schema["id"].dataType.simpleString()

    def kernel(group: pa.Table) -> pa.Table:
        sizes, number = group["length"].to_numpy(), group["group"][0].as_py()
        bins, offsets = first_fit_decreasing(sizes, length)
        keep = group.drop_columns(["salt", "group"])
        return keep.append_column("sequence_id", pa.array((np.int64(number) << 32) + bins)).append_column("offset", pa.array(offsets))

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    part = cut.filter(F.col("length") < length).withColumn("group", F.pmod(F.col("salt"), F.lit(groups)).cast("bigint"))
    packed = part.groupBy("group").applyInArrow(kernel, schema)
    # full pieces need no bin: they are numbered from the other end of the number range, by their place in the written table
    full = cut.filter(F.col("length") == length).drop("salt").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
    return packed.unionByName(full).withColumnRenamed("id", id_col)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
