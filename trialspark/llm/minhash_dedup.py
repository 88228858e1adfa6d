"""Near-duplicates by MinHash with tensored banding.

Words (A-Z lower-cased) give the set of distinct k-word shingles, as 64-bit
hashes; a document with fewer words has one shingle, one without words none.
Documents with one set are one class from the start: the class's id hashes the
whole set. Two collections of ``side`` tuples of ``width`` minhashes are computed
for each class, and every pair of a tuple of the first and one of the second
collection is a table's key: side * side tables for 2 * side tuples. ``side`` is
such that either collection misses a link at the threshold with a chance of 1e-4.

Two classes are a candidate pair only if they share a tuple of either collection,
so tuples that one class alone has are dropped before keys are formed. In a first
pass each class is compared with one class of each of its keys, the first in one of
``ORDERS`` random orders, and links are closed to components. A key whose classes
still lie in several components goes to the second pass, which pairs no two classes
blindly: each class of the key is laid against the key's hub, a class that meets very
many of the family, and is told from it by its delta: the shingles that one of them
has and the other lacks. Two classes share the hub's shingles that neither lacks, and
those of their deltas that both lack or both have beside it. So from their sizes it
follows how many delta elements two linked classes have in common: one at least, unless
both are linked to the hub, and are in its component then. What a family has in common
is in no delta, and a delta element of one class alone drops out, with the classes that
have too few left. Of the others the rarest come first, and the first few of those that
a link has in common make the keys of an equality join (``delta_keys``): sets of up to
three where a class has few of them. Candidates are counted out on their deltas. Nothing
is lost: every link of two classes of a key has a key in common.

A pair of the first pass goes on only if 256 one-bit minhashes agree about as often
as a link's do: they may fall five standard deviations short, and sets of fewer than
``FEW`` shingles always go on. What is left is confirmed on full sets.

Null texts and texts without words are linked with nothing. A component's id is
its least doc_id (null ids only if it has no other). Repeated rows are one class,
and so are rows of one id and one text. Long texts are hashed in one piece, their
sets are compared whole. Columns other than doc_id and text are not read; an empty
table gives no rows. Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, pairwise
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .common import Words, chunks, map_texts, mix, random_u64, text_buffers, written
from .graph import components

_U = np.uint64
#: Random orders of a key's classes that first compared classes are taken from.
ORDERS = 8
#: One-bit minhashes, 64 to a long, and the sets too small to be judged by them.
BITS, FEW = 256, 16
#: Bits of the filter of wanted texts: its size doesn't grow with the data, and
#: texts that it lets through in vain are dropped by the join after it.
FILTER_BITS = 1 << 25
#: Keys that a class has for each band of partners, above which fewer elements make one.
KEYS = 40
#: Bands of the weight of partners; the last has no upper end.
BANDS = 16
#: Elements of a delta up to which it goes with its keys, so that the join counts pairs
#: out; larger ones are counted out after it.
CARRIED = 256
#: Pairs of one hub that share its text in a task.
BLOCK = 1024


@dataclass(frozen=True)
class Near:
    """k-word shingles; linked where 100 * intersection >= percent * union."""

    k: int = 5
    percent: int = 80
    width: int = 3

    @property
    def side(self) -> int:
        """Tuples of a collection."""
        return math.ceil(math.log(1e-4) / math.log(1 - (self.percent / 100) ** self.width)) if self.percent < 100 else 1

    @property
    def may_differ(self) -> int:
        """One-bit minhashes in which a link may differ."""
        j = self.percent / 100
        agree = (1 + j) / 2
        spread = 2 * (agree * (1 - agree) / BITS) ** 0.5
        return int(BITS * (1 - j + 5 * spread) / 2) + 1


def _shingled(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        yield Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True).shingles(k)


def _per_set(op: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty: int = 0) -> np.ndarray:
    out = np.full(len(bounds) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = op.reduceat(values, bounds[some])
    return out


def _class_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = _per_set(np.add, mix(sets ^ _U(0x5851F42D4C957F2D)), bounds)
    return mix(total ^ mix(np.diff(bounds).astype(_U))).view(np.int64)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, node (the class), tuples: 2 * side
    longs, and bits."""
    rng = np.random.RandomState(97)
    n = 2 * near.side * near.width
    odd, shift = random_u64(rng, n) | _U(1), random_u64(rng, n)
    odd_bit = (random_u64(rng, BITS) >> _U(32)).astype(np.uint32) | np.uint32(1)
    add_bit = (random_u64(rng, BITS) >> _U(32)).astype(np.uint32)
    one_bit = (random_u64(rng, BITS) >> _U(32)).astype(np.uint32) | np.uint32(1)

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))

    def make():
        def work(texts: pa.Array):
            sizes, nodes, tuples, bits = [], [], [], []
            for sets, bounds in _shingled(texts, near.k):
                sizes.append(np.diff(bounds))
                nodes.append(_class_ids(sets, bounds))
                rows = np.zeros((len(bounds) - 1, 2 * near.side), _U)
                for i in range(2 * near.side):
                    for j in range(near.width):
                        f = i * near.width + j
                        rows[:, i] = mix(rows[:, i] + _per_set(np.minimum, sets * odd[f] + shift[f], bounds) + _U(i))
                tuples.append(rows)
                half = (sets >> _U(32)).astype(np.uint32)
                signs = np.zeros((len(bounds) - 1, BITS // 64), _U)
                for f in range(BITS):
                    low = _per_set(np.minimum, half * odd_bit[f] + add_bit[f], bounds)
                    # the bit of a least element is drawn anew for each function
                    signs[:, f // 64] |= (low * one_bit[f] >> np.uint32(31)).astype(_U) << _U(f % 64)
                bits.append(signs)
            return [pa.array(np.concatenate(sizes)), pa.array(np.concatenate(nodes)), lists(np.concatenate(tuples)), lists(np.concatenate(bits))]

        return work

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return map_texts(rows, ["doc_id", "h"], make, [StructField("n_shingles", LongType()), StructField("node", LongType()), StructField("tuples", ArrayType(LongType())), StructField("bits", ArrayType(LongType()))])


def alike(a: str, b: str, near: Near) -> Column:
    """Whether the bits of two sides differ as little as a link's may."""
    return reduce(add, (F.bit_count(F.get(F.col(a), i).bitwiseXOR(F.get(F.col(b), i))) for i in range(BITS // 64))) <= near.may_differ


def table_keys(classes: DataFrame, near: Near) -> DataFrame:
    """(node, one, two): the tuples of either collection that a class may share.

    Pairs of them are the keys of its tables.
    """
    tuples = classes.select("node", F.posexplode("tuples").alias("pos", "value"))
    shared = tuples.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    first = F.col("pos") < near.side
    return (
        tuples.join(shared, "value", "left_semi")
        .groupBy("node")
        .agg(F.collect_list(F.when(first, F.col("value"))).alias("one"), F.collect_list(F.when(~first, F.col("value"))).alias("two"))
        .where((F.size("one") > 0) & (F.size("two") > 0))
    )


def _keyed(sides: DataFrame, *more: str) -> DataFrame:
    each = sides.select("*", F.explode("one").alias("p")).select("*", F.explode("two").alias("q"))
    return each.select(F.xxhash64("p", "q").alias("key"), "node", *more)


def passing(pairs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """The pairs (x, y) whose bits are alike."""
    side = lambda n: classes.select(F.col("node").alias(n), F.col("bits").alias(f"b{n}"), F.col("n_shingles").alias(f"n{n}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").where(alike("bx", "by", near) | (F.least("nx", "ny") < FEW)).select("x", "y")


def _filter(wanted: DataFrame) -> np.ndarray:
    at = F.pmod("h", F.lit(FILTER_BITS))
    word = F.shiftright(at, 6).cast("int")
    mask = F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) % 64 as int))")
    words = wanted.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.word.to_numpy(int)] = words["mask"].to_numpy(np.int64)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of each wanted (node, h): one text of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))
    schema = StructType([StructField("h", LongType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = batch.column("h").to_numpy() % FILTER_BITS
            hit = (shared.value[at >> 6] >> (at & 63)) & 1
            if len(seen) > 200_000:
                seen.clear()
            hashes = batch.column("h").to_numpy()
            fresh = [i for i in np.flatnonzero(hit).tolist() if not (hashes[i] in seen or seen.add(hashes[i]))]
            yield batch.take(pa.array(fresh, pa.int64()))

    found = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)
    return written(found.join(wanted, "h").dropDuplicates(["node"]).select("node", "text"), "texts")


def _sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    return [sets[bounds[i] : bounds[i + 1]] for sets, bounds in _shingled(column, k) for i in range(len(bounds) - 1)]


def _beside(pairs: DataFrame, texts: DataFrame, work: Callable, schema: StructType, k: int) -> DataFrame:
    """``work(batch, sets, set)`` on rows of pairs (x, y, ...), with the sets of all x of
    the batch and the one of its y.

    A y that many rows share doesn't go with each of them: rows are dealt by y in blocks
    of about BLOCK, and the text of y comes once, before its block.
    """
    own = pairs.columns
    sizes = pairs.groupBy("y").agg(F.count("*").alias("_n"))
    dealt = pairs.join(sizes, "y").withColumn("_block", F.pmod(F.xxhash64("x"), F.ceil(F.col("_n") / BLOCK))).select(*own, "_block")
    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias("_text"))
    rows = dealt.join(side("x"), "x").select(*own, "_block", F.lit(1).alias("_kind"), "_text")
    heads = dealt.select("y", "_block").distinct().join(side("y"), "y")
    heads = heads.select(*[F.col(c) if c == "y" else F.lit(None).cast(t).alias(c) for c, t in pairs.dtypes], "_block", F.lit(0).alias("_kind"), "_text")
    laid = rows.unionByName(heads).repartition("y", "_block").sortWithinPartitions("y", "_block", "_kind")
    y_at, block_at, kind_at = own.index("y"), len(own), len(own) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, np.zeros(0, _U)
        for batch in batches:
            y, block, kind = (batch.column(i).to_numpy() for i in (y_at, block_at, kind_at))
            cuts = [*np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (block[1:] != block[:-1])]).tolist(), batch.num_rows] if batch.num_rows else []
            for low, high in pairwise(cuts):
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    key, hub = (y[low], block[low]), _sets_of(part.column(block_at + 2).slice(0, 1), k)[0]
                    part = part.slice(1)
                if part.num_rows and key == (y[low], block[low]):  # else y has no text, and so no pair
                    yield work(part.select(own), _sets_of(part.column(block_at + 2), k), hub)

    return laid.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs (x, y) whose full sets are near enough."""

    def judge(part: pa.RecordBatch, own: list[np.ndarray], other: np.ndarray) -> pa.RecordBatch:
        common = np.array([len(np.intersect1d(a, other, assume_unique=True)) for a in own])
        sizes = np.array([len(a) + len(other) for a in own])
        return part.take(pa.array(np.flatnonzero(100 * common >= near.percent * (sizes - common))))

    return _beside(pairs.select("x", "y"), texts, judge, pairs.select("x", "y").schema, near.k)


def _hubs(sides: DataFrame, roots: DataFrame) -> DataFrame:
    """(x, y, part, hub_part): the classes of each key that lies in several components,
    and the key's hub. A class counts for as much as it meets others in such keys; each
    class looks to the one that counts most in its keys, and a key's hub is the one that
    counts most of those that its classes look to: mostly one for a whole family."""
    placed = sides.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    each = _keyed(placed, "part")
    still = each.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    each = written(each.join(still, "key"), "open")
    counts = each.groupBy("node").agg(F.sum("n").alias("met"), F.first("part").alias("own"))
    best = each.join(counts, "node").groupBy("key").agg(F.max(F.struct("met", "node", F.col("own").alias("part"))).alias("best"))
    looks = each.select("key", "node").join(best, "key").groupBy("node").agg(F.max("best").alias("best"))
    hubs = each.select("key", "node").join(looks, "node").groupBy("key").agg(F.max("best").alias("hub")).select("key", F.col("hub.node").alias("y"), F.col("hub.part").alias("hub_part"))
    return each.join(hubs, "key").select(F.col("node").alias("x"), "y", "part", "hub_part").distinct()


def against_hubs(laid: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(x, y, part, hub_part, hub_n, lost, delta): the size of hub y, how many of its
    shingles class x lacks, and those that one of them has and the other lacks."""
    schema = StructType([*laid.schema.fields, StructField("hub_n", LongType()), StructField("lost", LongType()), StructField("delta", ArrayType(LongType()))])

    def compare(part: pa.RecordBatch, own: list[np.ndarray], hub: np.ndarray) -> pa.RecordBatch:
        delta = [np.setxor1d(a, hub, assume_unique=True).view(np.int64) for a in own]
        lost = [(len(d) + len(hub) - len(a)) // 2 for a, d in zip(own, delta, strict=True)]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array([len(hub)] * len(own), pa.int64()), pa.array(lost, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], schema.fieldNames())

    return _beside(laid, texts, compare, schema, near.k)


def weighed(laid: DataFrame, near: Near) -> DataFrame:
    """``laid`` with weight = 100 lost + percent * added and slack = (100 - percent) *
    hub_n. A class is linked to its hub if its weight is no more than the slack. Two
    classes share the hub's shingles that neither lost, and what both lost or both
    added counts beside: they are linked if (100 + percent) times the number of common
    elements of their deltas is no less than both weights less the slack."""
    p = near.percent
    return laid.withColumns({"weight": 100 * F.col("lost") + p * (F.size("delta") - F.col("lost")), "slack": (100 - p) * F.col("hub_n")})


def _sharing(rows: DataFrame, near: Near) -> DataFrame:
    """``rows`` whose delta is cut to elements that another class of the hub has as
    well, one of them not linked to the hub; the rarest come first. Rows with too few
    of them for any link are dropped."""
    each = rows.select("hub", "node", "loose", F.explode("delta").alias("s"))
    common = each.groupBy("hub", "s").agg(F.count("*").alias("c"), F.max("loose").alias("some")).where("c > 1 and some").select("hub", "s", "c")
    lists = each.join(common, ["hub", "s"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("_d"))
    kept = rows.drop("delta").join(lists, ["hub", "node"]).withColumn("delta", F.col("_d.s")).drop("_d")
    # what a link has in common at least: tight classes look for loose ones alone
    least = F.greatest(F.lit(1), F.ceil(F.when(F.col("loose"), F.col("weight") - F.col("slack")).otherwise(F.col("weight") + 1) / F.lit(100 + near.percent)))
    return kept.where(F.size("delta") >= least)


def _combined(elements: np.ndarray, m: int, keep: int) -> list[int]:
    """Hashes of all sets of ``m`` of the first ``keep`` elements, in their order."""
    spread = [mix(elements[:keep] + _U(j)).tolist() for j in range(m)]
    top = (1 << 64) - 1
    return [sum(spread[j][i] for j, i in enumerate(c)) & top for c in combinations(range(min(keep, len(elements))), m)]


def delta_keys(rows: DataFrame, near: Near) -> DataFrame:
    """(hub, key, node, part, top): keys that two linked classes of a hub have in common.

    A link has t elements of the deltas in common, t from both weights; with deltas in
    one order, the first m of these are among the first size - t + m of either. Sets of
    m of them (up to three, while there are at most KEYS) are keys, for each band of
    weights that a partner may have. Partners with other m meet at the lesser one, which
    is the ``top`` of one of them.
    """
    per = 100 + near.percent
    schema = StructType([rows.schema[c] for c in ("hub", "node", "part")] + [StructField("key", LongType()), StructField("top", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, tops = [], [], []
            for i, (weight, slack, loose, band, there, delta) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3, 9)], strict=True)):
                elements = np.array(delta, np.int64).view(_U)
                width = max(1, slack // 4)
                for other in range(0 if loose else min(BANDS - 1, (slack + 1) // width), BANDS):
                    if not there >> other & 1:
                        continue
                    low = other * width if loose else max(other * width, slack + 1)
                    t = max(1, -((slack - weight - low) // per))
                    rest = len(elements) - t
                    if rest < 0:
                        break  # heavier partners ask for more
                    most = max(m for m in (1, 2, 3) if m == 1 or (m <= t and comb(rest + m, m) <= KEYS))
                    for m in range(1, most + 1):
                        mark = int(mix(np.array([(min(band, other) * BANDS + max(band, other)) * 4 + m], _U))[0])
                        new = [(v ^ mark) for v in _combined(elements, m, rest + m)]
                        keys += new
                        at += [i] * len(new)
                        tops += [m == most] * len(new)
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).take(pa.array(at, pa.int64())).columns, pa.array(np.array(keys, _U).view(np.int64)), pa.array(tops, pa.bool_())], schema.fieldNames())

    banded = rows.withColumn("band", F.least(F.lit(BANDS - 1), F.floor(F.col("weight") / F.greatest(F.lit(1), F.floor(F.col("slack") / 4)))).cast("int"))
    there = banded.groupBy("hub").agg(F.bit_or(F.expr("shiftleft(1, band)")).alias("there"))  # the bands that a hub has
    return banded.join(there, "hub").select("hub", "node", "part", "weight", "slack", "loose", "band", "there", "delta").mapInArrow(run, schema)


def under_hubs(laid: DataFrame, near: Near) -> DataFrame:
    """Links (x, y) of classes in different components, one of which is not linked to
    the hub. They have delta elements in common (``weighed``), so an equality join on
    the keys of these finds them; what a family has in common is in no delta, and what
    one class alone has is in no key. Candidates are counted out on their deltas. Links
    that join no two components may be left out.
    """
    tight = F.col("weight") <= F.col("slack")
    rows = weighed(laid, near).select(F.col("y").alias("hub"), F.col("x").alias("node"), F.when(tight, F.col("hub_part")).otherwise(F.col("part")).alias("part"), (~tight).alias("loose"), "weight", "slack", "delta")
    rows = written(_sharing(rows, near), "shared")
    rows = written(_sharing(rows, near), "shared")  # without the rows that the first pass dropped
    keys = written(delta_keys(rows, near), "keys")
    full = lambda n: rows.select("hub", F.col("node").alias(n), F.col("delta").alias(f"d{n}"), F.col("weight").alias(f"w{n}"), "slack")

    def counted_out(pairs: DataFrame) -> DataFrame:
        both = pairs.join(full("x"), ["hub", "x"]).join(full("y").drop("slack"), ["hub", "y"])
        return both.where((100 + near.percent) * F.size(F.array_intersect("dx", "dy")) >= F.col("wx") + F.col("wy") - F.col("slack"))

    # each class of a key with one of them first: most links then join no components
    order = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
    heads = keys.groupBy("hub", "key").agg(F.min_by(F.struct("node", "part"), order).alias("head"))
    stars = keys.join(heads, ["hub", "key"]).where("node != head.node and part != head.part")
    stars = stars.select("hub", F.col("node").alias("x"), F.col("head.node").alias("y"), F.col("part").alias("px"), F.col("head.part").alias("py")).distinct()
    first = written(counted_out(stars).select("x", "y", "px", "py").distinct(), "first")
    joined = components(first, "px", "py").select(F.col("node").alias("part"), "root")
    keys = keys.join(joined, "part", "left").withColumn("part", F.coalesce("root", "part"))
    still = keys.groupBy("hub", "key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("top").alias("some")).where("low < high and some").select("hub", "key")
    # deltas as halves of their hashes; halves that fall together are added back as spare
    half = F.array_distinct(F.transform("delta", lambda v: F.shiftright(v, 32).cast("int")))
    brief = rows.select("hub", "node", F.when(F.size("delta") <= CARRIED, half).alias("brief"), (F.size("delta") - F.size(half)).alias("spare"), "weight", "slack")
    keys = written(keys.join(still, ["hub", "key"]).select("hub", "key", "node", "part", "top").join(brief, ["hub", "node"]), "still")
    side = lambda d, n: d.select("hub", "key", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "part", "brief", "spare", "weight", "slack")])
    common = F.size(F.array_intersect("brief_x", "brief_y")) + F.col("spare_x") + F.col("spare_y")
    may = (100 + near.percent) * common >= F.col("weight_x") + F.col("weight_y") - F.col("slack_x")
    met = side(keys.where("top"), "x").join(side(keys, "y"), ["hub", "key"])
    met = met.where((F.col("node_x") != F.col("node_y")) & (F.col("part_x") != F.col("part_y")) & (F.col("brief_x").isNull() | F.col("brief_y").isNull() | may))
    pairs = met.select("hub", F.greatest("node_x", "node_y").alias("x"), F.least("node_x", "node_y").alias("y")).distinct()
    return first.select("x", "y").unionByName(counted_out(pairs).select("x", "y")).distinct()


def links(docs: DataFrame, classes: DataFrame, near: Near) -> DataFrame:
    """(node, root) of every class that is linked with another."""
    sides = written(table_keys(classes, near), "sides")
    keys = _keyed(sides)
    by = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
    heads = keys.groupBy("key").agg(F.min_by("node", by).alias("y"), F.count("*").alias("n")).where("n > 1").select("key", "y")
    stars = keys.join(heads, "key").where("node != y").select(F.col("node").alias("x"), "y").distinct()
    stars = written(passing(stars, classes, near), "stars")
    known = classes.select("node", "h")
    texts = texts_of(docs, known.join(_ends(stars), "node", "left_semi"))
    found = written(confirmed(stars, texts, near), "found")
    roots = components(found)

    laid = written(_hubs(sides, roots), "hubs")
    if laid.isEmpty():
        return roots
    missing = written(known.join(_ends(laid), "node", "left_semi").join(texts.select("node"), "node", "left_anti"), "missing")
    if not missing.isEmpty():
        texts = texts.unionByName(texts_of(docs, missing))
    laid = written(against_hubs(laid, texts, near), "against")
    to_hub = weighed(laid, near).where((F.col("x") != F.col("y")) & (F.col("weight") <= F.col("slack"))).select("x", "y")
    rest = written(under_hubs(laid, near), "rest")
    return components(found.unionByName(to_hub).unionByName(rest))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()


def _grouped(docs: DataFrame, near: Near) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, node) of every row; (node, part, first) of every class,
    where ``first`` is (no id, doc_id, h) of the least row of its component."""
    sketch = written(sketches(docs, near), "sketch")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = written(
        sketch.where("n_shingles > 0").groupBy("node").agg(F.min(row).alias("least"), F.first("tuples").alias("tuples"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles"), F.min("h").alias("h")), "classes"
    )
    roots = links(docs, classes, near)
    linked = classes.select("node", "least").join(roots, "node")
    firsts = linked.groupBy("root").agg(F.min("least").alias("joined"))
    named = linked.join(firsts, "root").select("node", F.col("root").alias("part"), "joined")
    own = classes.select("node", "least").join(named, "node", "left").select("node", F.coalesce("part", "node").alias("part"), F.coalesce("joined", "least").alias("first"))
    return sketch.select("doc_id", "h", "n_shingles", "node"), written(own, "firsts")


def near_components(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, firsts = _grouped(docs, near or Near())
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    met = rows.where("n_shingles > 0").join(firsts, "node").select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def dedup(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """``docs`` with one row of each component and all rows without words.

    The row with the least doc_id stays (a null id comes last, and of one id the
    text with the least hash); of rows that repeat both id and text, one.
    """
    rows, firsts = _grouped(docs, near or Near())
    kept = firsts.groupBy("part").agg(F.first("first").alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.h").alias("__kh"))
    many = rows.where("n_shingles > 0").groupBy("doc_id", "h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__kh"))
    again = written(kept.join(many, kept["__id"].eqNullSafe(many["__id"]) & (kept["__kh"] == many["__kh"]), "left_semi"), "again")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.withColumns({"__h": F.xxhash64("text"), "__worded": worded})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kh"))
    out = own.where("__worded").join(kept, same, "left_semi").unionByName(own.where("not __worded"))
    if not again.isEmpty():
        once = own.where("__worded").join(again, same, "left_semi").dropDuplicates(["doc_id", "__h"])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.drop("__h", "__worded")
