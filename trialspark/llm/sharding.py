"""Sharding by sampled splitters.

Records are ordered by a hash of their text, equal texts by a hash of their id.
A size-weighted sample of these keys gives quantile boundaries, which cut the
order into ranges of about equal bytes; exact byte counts of the ranges then
place the shard limits, and a range that would overfill its shard is subdivided
at the limit. Only (key, id, size) rows move, never texts.

Equal texts stay in one shard, unless they outweigh a shard. Groups above
``GROUP_SHARE`` of a shard, of which there are few, are placed first, the largest
first, each on the shard with most room; the ranges of all other records then fill
the shards to one level. A group heavier than a shard is cut between records. Shard
sizes so differ by no more than whole groups force.

Null texts count as one byte and form one group. Null and repeated ids are
ordinary rows, told apart by nothing but their order. Long texts are records like
others, and a shard is never smaller than its longest. Columns other than doc_id and
text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import written

#: Bytes that a range should hold, and the least and most ranges: the most bounds
#: what the driver holds and each task gets (two longs a range).
RANGE_BYTES, MIN_RANGES, MAX_RANGES = 64 << 20, 256, 65_536
#: Sampled keys for each range.
OVERSAMPLE = 32
#: Share of a shard from which a group is placed by itself: n_shards / GROUP_SHARE
#: groups at most, which reach the driver.
GROUP_SHARE = 0.01
_HASHES = float(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).__add__(F.lit(1)).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),  # a null text has one too
        F.xxhash64(F.lit(7), "doc_id").alias("d"),
    )


def boundaries(keyed: DataFrame, ranges: int, total: int, cut: set[int]) -> list[tuple[int, int]]:
    """At most ``ranges`` - 1 keys (h, d) that cut the bytes about evenly; only the
    heavy texts ``cut`` may spread over several ranges.

    A row is drawn with a chance in proportion to its size, by a hash of itself,
    so a rerun draws the same rows; about OVERSAMPLE * ranges keys reach the driver.
    """
    want = OVERSAMPLE * ranges
    chance = F.col("size") * F.lit(want / max(total, 1))
    draw = (F.xxhash64(F.lit(11), "h", "d") / F.lit(_HASHES) + 1) / 2
    drawn = keyed.where(draw < chance).select("h", "d", F.greatest(F.lit(1.0), chance).alias("w")).toPandas().sort_values(["h", "d"])
    if drawn.empty:
        return []
    mass = np.cumsum(drawn.w.to_numpy())
    at = np.unique(np.searchsorted(mass, mass[-1] * np.arange(1, ranges) / ranges))
    keys = list(zip(drawn.h.to_numpy()[at].tolist(), drawn.d.to_numpy()[at].tolist(), strict=True))
    lows = np.iinfo(np.int64).min
    # a text's boundary goes before its group
    return sorted({(h, d if h in cut else lows) for h, d in keys})


def _ranged(keyed: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    hs = np.array([h for h, _ in cuts], np.int64)
    ds = np.array([d for _, d in cuts], np.int64)
    schema = StructType([*keyed.schema.fields, StructField("range", IntegerType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d = batch.column("h").to_numpy(), batch.column("d").to_numpy()
            low, high = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            for at in np.unique(low[low < high]):
                mine = np.flatnonzero((low == at) & (low < high))
                low[mine] += np.searchsorted(ds[at : high[mine[0]]], d[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], names)

    return keyed.mapInArrow(run, schema)


def _level(placed: list[int], rest: int) -> list[int]:
    """What each shard has room for when ``rest`` fills all to one level."""
    low, high = 0, max(placed, default=0) + rest + 1
    while low < high:
        level = (low + high) // 2
        low, high = (low, level) if sum(max(0, level - p) for p in placed) >= rest else (level + 1, high)
    return [max(0, low - p) for p in placed]


def place_groups(weights: list[tuple[int, int]], n_shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each (group, weight), the largest first on the emptiest; their bytes."""
    placed, where = [0] * n_shards, {}
    for h, weight in sorted(weights, key=lambda g: (-g[1], g[0])):
        where[h] = min(range(n_shards), key=lambda s: (placed[s], s))
        placed[where[h]] += weight
    return where, placed


def assign_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in its shard) of all rows."""
    spark = docs.sparkSession
    keyed = written(_keyed(docs), "keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    share = max(total / n_shards, 1)
    ranges = min(MAX_RANGES, max(MIN_RANGES, -(-total // RANGE_BYTES)))
    heavy = keyed.groupBy("h").agg(F.sum("size").alias("weight")).where(F.col("weight") > share * GROUP_SHARE).collect()
    where, placed = place_groups([(r.h, r.weight) for r in heavy if r.weight <= share], n_shards)
    ranged = written(_ranged(keyed, boundaries(keyed, ranges, total, {r.h for r in heavy})), "ranged")
    own_place = spark.createDataFrame(list(where.items()), "h long, own_shard int")
    ranged = ranged.join(F.broadcast(own_place), "h", "left")
    rest, whole = ranged.where("own_shard is null"), ranged.where("own_shard is not null")

    sums = rest.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).toPandas().sort_values("range")
    sums["b0"], sums["n0"] = sums.b.cumsum() - sums.b, sums.n.cumsum() - sums.n
    before = spark.createDataFrame(sums[["range", "b0", "n0"]].astype({"range": "int32", "b0": "int64", "n0": "int64"}), "range int, b0 long, n0 long")
    limits = np.cumsum(_level(placed, total - sum(placed)))[:-1].tolist()
    in_order = Window.partitionBy("range").orderBy("h", "d", "doc_id", "size")
    group = Window.partitionBy("range", "h")
    cut = F.col("weight") > share * GROUP_SHARE
    # a row, or a whole group, goes where its middle byte lies
    middle = F.when(cut, F.col("own") + F.col("size") / 2).otherwise(F.min("own").over(group) + F.col("weight") / 2)
    at = (
        rest.join(F.broadcast(before), "range")
        .withColumn("own", F.col("b0") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("at", F.col("n0") + F.row_number().over(in_order) - 1)
        .withColumn("weight", F.sum("size").over(group))
        .withColumn("middle", middle)
        .withColumn("shard", F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]).cast("array<double>"), lambda x: x <= F.col("middle"))))
        .select("doc_id", "size", "text_crc32", "shard", "at")
    )
    filled = written(at, "placed")
    firsts = filled.groupBy("shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    out = filled.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
    if not where:
        return out
    counts = whole.groupBy("own_shard", "h", "range").agg(F.count("*").alias("n")).toPandas().sort_values(["own_shard", "h", "range"])
    began = firsts.toPandas().set_index("shard").n
    counts["slot0"] = counts.groupby("own_shard").n.cumsum() - counts.n + counts.own_shard.map(began).fillna(0).astype("int64")
    slots = spark.createDataFrame(counts[["h", "range", "slot0"]].astype({"h": "int64", "range": "int32", "slot0": "int64"}), "h long, range int, slot0 long")
    in_group = Window.partitionBy("range", "h").orderBy("d", "doc_id", "size")
    kept = whole.join(F.broadcast(slots), ["h", "range"]).select("doc_id", "size", "text_crc32", F.col("own_shard").alias("shard"), (F.col("slot0") + F.row_number().over(in_group) - 1).alias("slot"))
    return out.unionByName(kept)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> DataFrame:
    """Write whole records as ``path``/shard=k; returns the assignment.

    Ids must be unique here, since texts are joined to their shards by id.
    """
    placed = assign_shards(docs, n_shards)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    docs.select(*own).join(placed.select("doc_id", "shard", "slot"), "doc_id").write.partitionBy("shard").parquet(path)
    return placed
