"""Packing token sequences: first-fit decreasing on a tournament tree.

Each document becomes token ids and an end id. Every full run of ``capacity``
ids is a sequence of its own; the rests, one a document at most, are packed by
first-fit decreasing. A tournament tree over bin capacities finds the first bin
that has room in logarithmic time. Documents are dealt at random into groups of
about ``group_rows`` rests, so that no task sees more than a group; each group
leaves a few bins unfilled.

A null text is empty: one piece, the end id alone. Repeated rows and ids are
packed one by one. Extra columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import written

CAPACITY, END_ID, GROUP_ROWS = 2048, 1, 8192
SPECIAL = "<|endoftext|>"


class ByteBpe:
    """Ids as the tokenizers library gives them for byte_bpe_50k.json.

    The tiktoken file of the same folder holds the same merges as ranks and is
    encoded faster; the special string, which the json file maps to one id, is
    taken out before.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k.tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = len(ranks)

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self._plain(text)
        out: list[int] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(self._special)
            out += self._plain(part)
        return out


class Tournament:
    """Bins of one capacity; ``put`` gives an item to the first that has room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, size: int) -> tuple[int, int]:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= size
        leaf = at - self.leaves
        at //= 2
        while at:
            a, b = room[2 * at], room[2 * at + 1]
            most = a if a > b else b
            if room[at] == most:
                break
            room[at] = most
            at //= 2
        return leaf, offset


def first_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], offsets[i] = tree.put(int(sizes[i]))
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece, and its row
    number ``piece`` (unique, fixed once written)."""
    source = docs.select("doc_id", "text")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, piece = ByteBpe(), TaskContext.get().partitionId() << 36
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows: list[tuple[int, int, int, int, int, int]] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    for start in range(0, len(ids), capacity):
                        cut = ids[start : start + capacity]
                        rows.append((i, piece, start, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
                        piece += 1
                cols = np.array(rows, np.int64).reshape(-1, 6).T
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], names)

    schema = StructType([source.schema["doc_id"], *(StructField(name, LongType()) for name in names[1:])])
    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset.

    Even sequence ids are packed ones, odd ones are whole pieces.
    """
    cut = written(pieces(docs, capacity), "pieces")
    rests = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_rows))
    whole = cut.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("piece") * 2 + 1, "offset": F.lit(0).cast("long")})

    dealt = rests.withColumn("bin_group", F.pmod(F.xxhash64(F.lit(29), "piece"), F.lit(groups)))
    schema = StructType([*rests.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(group.length.to_numpy(), capacity)
        group["sequence_id"] = (int(group.bin_group.iloc[0]) << 24 | bins) * 2
        group["offset"] = offsets
        return group[schema.fieldNames()]

    packed = dealt.groupBy("bin_group").applyInPandas(fill, schema)
    return whole.select(*schema.fieldNames()).unionByName(packed).drop("piece")
