"""Document fingerprints by consistent weighted sampling.

A text is a bag of weighted terms: each pair of neighbouring words (with a mark
before the first and after the last word), weighted by its count. Sample k of a bag
is drawn by the gamma scheme for consistent weighted samples: every term has, for
each k, two Gamma(2, 1) variates r and c and a uniform b, read off its 64-bit hash and
k alone; for a weight w,

    t = floor(ln w / r + b),  y = exp(r (t - b)),  a = c / (y exp(r)),

and the sample is the (term, t) of least a. Equal bags give equal samples, and two
bags agree in a sample with the chance of their generalised Jaccard similarity, the
sum of least weights over the sum of largest. Variates belong to terms, not buckets,
so long unrelated texts stay unlike. A sample is kept as 16 bits: unlike samples agree
with a chance of 1 in 65,536.

A null text is empty; texts without a word share one fingerprint. Long texts are
sampled block by block; repeated rows have one fingerprint. Of columns that are kept,
one named fingerprint gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import Words, chunks, map_texts, mix, random_u64, text_buffers

SAMPLES = 64
#: Terms handled at a time, so that their variates stay in the cache.
BLOCK = 1 << 10
_U, _F = np.uint64, np.float32
_EDGE = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _uniform(bits: np.ndarray, shift: int, width: int) -> np.ndarray:
    """``width`` bits of each word as a number inside (0, 1)."""
    part = (bits >> _U(shift) & _U((1 << width) - 1)).astype(_F)
    part += _F(0.5)
    part *= _F(2.0**-width)
    return part


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        self.odd = random_u64(np.random.RandomState(4242), samples) | _U(1)
        self.samples = samples

    def variates(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, c, r, b) of each term and sample."""
        h = terms[:, None] * self.odd
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        c = _uniform(h, 40, 24)
        c *= _uniform(h, 16, 24)
        more = h * _U(0xA0761D6478BD642F)
        more ^= more >> _U(32)
        r = _uniform(more, 0, 16)
        r *= _uniform(more, 16, 16)
        return h, -np.log(c), -np.log(r), _uniform(more, 32, 16)

    def signatures(self, terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, samples) of 16 bits; the terms of text i are bounds[i]:bounds[i + 1]."""
        out = np.full((len(bounds) - 1, self.samples), ~_U(0))
        for low in range(0, len(terms), BLOCK):
            part, weight = terms[low : low + BLOCK], weights[low : low + BLOCK]
            h, c, r, b = self.variates(part)
            name = h
            down = r * (_F(1) - b)  # ln y + r where w = 1
            heavy = np.flatnonzero(weight > 1)
            if len(heavy):
                t = np.floor(np.log(weight[heavy]).astype(_F)[:, None] / r[heavy] + b[heavy])
                down[heavy] = r[heavy] * (t - b[heavy] + _F(1))
                name[heavy] ^= mix(t.astype(_U))
            c *= np.exp(-down)
            # the bits of positive floats ascend as they do; the name comes along
            rows = c.view(np.uint32).astype(_U) << _U(32)
            rows |= name >> _U(32)
            first = max(int(np.searchsorted(bounds, low, "right")) - 1, 0)
            last = int(np.searchsorted(bounds, low + len(rows), "left"))
            inside = np.clip(bounds[first : last + 1] - low, 0, len(rows))
            some = np.flatnonzero(np.diff(inside))
            out[first + some] = np.minimum(out[first + some], np.minimum.reduceat(rows, inside[some], axis=0))
        return (mix(out & _U(0xFFFFFFFF)) >> _U(48)).astype(np.uint16)


def terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, weights, bounds): hashes and counts of the terms of each text."""
    n, docs = len(words.hash), words.n_docs
    counts = words.counts()
    left = np.empty(n, _U)
    left[1:] = words.hash[:-1]
    left[words.first[:-1][counts > 0]] = _EDGE[0]
    last = words.hash[words.first[1:][counts > 0] - 1]
    doc = np.concatenate([np.repeat(np.arange(docs), counts), np.flatnonzero(counts)])
    pair = np.concatenate([mix(left * _U(3) + words.hash * _U(7)), mix(last * _U(3) + _EDGE[1])])
    # by text, then by term: the number of the text before the leading bits of the hash
    bits = max(docs - 1, 0).bit_length()
    order = np.argsort(pair if not bits else doc.astype(_U) << _U(64 - bits) | pair >> _U(bits))
    doc, pair = doc[order], pair[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(fresh)
    return pair[starts], np.diff(np.r_[starts, len(pair)]), np.searchsorted(doc[starts], np.arange(docs + 1))


def signatures(texts: pa.Array, sampler: Sampler) -> np.ndarray:
    data, offsets = text_buffers(texts)
    parts = [sampler.signatures(*terms(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, sampler.samples), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def _hex(rows: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in rows]


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and fingerprint: 4 hex digits a sample."""

    def make():
        sampler = Sampler()
        return lambda texts: [pa.array(_hex(signatures(texts, sampler)), pa.string())]

    return map_texts(docs, docs.columns if keep is None else keep, make, [StructField("fingerprint", StringType())])


#: Bytes of text for each range of ids, and the most ranges: three longs a range
#: reach the driver and the plan.
RANGE_BYTES, MAX_RANGES = 24 << 20, 20_000


def in_descending_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, part, extra): ranges of descending doc_id, each closed by an
    ``extra`` row, the first of the next range (after the last: of the first).

    Ids must be integers; null ids come last. Rows of one id go by their text.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = source.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    wanted = int(min(MAX_RANGES, max(1, (stats[0] or 0) // RANGE_BYTES)))
    cuts = sorted({int(x) for x in source.where("doc_id is not null").approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.1 / wanted)}) if wanted > 1 and stats[1] else []
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # range 0 holds the largest ids; null ids follow the least
        up = np.searchsorted(shared.value, ids.fillna(0).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), len(shared.value) + 1, len(shared.value) - up).astype(np.int32))

    parted = source.withColumn("part", range_of("doc_id"))
    heads = parted.groupBy("part").agg(F.max("doc_id").alias("top")).toPandas().sort_values("part")
    if heads.empty:
        return parted.withColumn("extra", F.lit(False)), 1
    order = heads.part.tolist()
    tops = [None if pd.isna(x) else int(x) for x in heads.top]
    closes = spark.createDataFrame([(order[i], tops[i], order[i - 1]) for i in range(len(order))], "part int, top long, closes int")
    at = parted.join(F.broadcast(closes), "part")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    other = F.struct(F.col("closes").alias("part"), F.lit(True).alias("extra"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, other)).otherwise(F.array(own))
    return at.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.part", "to.extra"), order[-1] + 1


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of every row.

    An edited text ends in the beginning of the next document by descending id.
    A lone document is its own next.
    """
    import hashlib

    dealt, parts = in_descending_order(docs)
    ordered = dealt.repartitionById(max(parts, 1), F.col("part")).sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")
    fields = [StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        last: tuple | None = None  # the row whose next isn't known yet: part, extra, id, text, signature
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                signed = signatures(piece.column("text"), sampler)
                rows = list(zip(*(piece.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), signed, strict=True))
                if last:
                    rows.insert(0, last)
                done, edits = [], []
                for own, after in zip(rows, rows[1:]):
                    if own[1] or own[0] != after[0]:
                        continue
                    cut = len(own[3]) // 2
                    done.append((own, after))
                    edits.append(own[3][: len(own[3]) - cut] + after[3][:cut])
                last = rows[-1]
                if not done:
                    continue
                mine, nexts = np.array([o[4] for o, _ in done]), np.array([a[4] for _, a in done])
                edited = signatures(pa.array(edits, pa.large_string()), sampler)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[2] for o, _ in done], pa.int64()),
                        pa.array([len(o[3]) for o, _ in done], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                        pa.array(_hex(mine)),
                        pa.array(_hex(edited)),
                        pa.array(likeness(mine, edited)),
                        pa.array(likeness(mine, nexts)),
                    ],
                    names,
                )

    return ordered.select("part", "extra", "doc_id", "text").mapInArrow(run, StructType(fields))
