"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; n-grams of one to three code points are hashed to buckets.
Counts by language come from a sample bounded per language, and the matrix of
log probabilities is broadcast; a batch is scored by gathering its rows in numpy.
Languages weigh the same beforehand.

A text without a letter, and a null or empty one, is ``und`` with score 0; so is every
text where no language could be learnt. The score is the posterior probability; of
equally likely languages the first by name is told. Long texts are scored whole, in
blocks. Repeated rows count as often as they stand; null ids are never learnt from.
Kept columns named lang_pred or score give way to the results. An empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import held_out, map_texts

BUCKETS = 1 << 16
#: Documents of a language to learn from, about (drawn by a hash of the id).
PER_LANGUAGE = 4000
#: Languages learnt at most, the commonest: the matrix that is broadcast has a column
#: of 256 KB for each, however many stray values lang holds.
LANGUAGES = 256
#: Code points hashed at a time; longer texts are taken in blocks of this size.
BLOCK = 1 << 19
ORDERS = (1, 2, 3)
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Languages:
    names: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, their offsets, code points); a long text comes in several blocks
    that overlap by the longest n-gram less one."""
    held: list[str] = []
    ids: list[int] = []
    size, reach = 0, max(ORDERS) - 1

    def block():
        cps = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.array(ids), np.concatenate([[0], np.cumsum([len(t) for t in held])]), cps

    for i, text in enumerate(texts):
        text = (text or "").lower()
        step = BLOCK - reach
        for at in range(0, max(len(text) - reach, 1), step):
            piece = text[at : at + BLOCK]
            if size + len(piece) > BLOCK and held:
                yield block()
                held, ids, size = [], [], 0
            held.append(piece)
            ids.append(i)
            size += len(piece)
    if held:
        yield block()


def _hashed(cps: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of the n-grams inside documents, and offsets."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(cps))
    for n in ORDERS:
        h = np.full(max(len(cps) - n + 1, 0), n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ cps[j : len(cps) - n + 1 + j]) * np.uint32(_MULT[j])
            h ^= h >> np.uint32(15)
        inside = left[: len(h)] >= n
        yield (h[inside] >> np.uint32(3)) % np.uint32(BUCKETS), np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, len(h))]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Languages:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    names = sorted(sizes)
    if not names:
        return Languages([], np.zeros((BUCKETS, 0), np.float32))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / sizes[k]))])
    drawn = known.where(draw < share[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for ids, offsets, cps in _blocks(batch.column("text").to_pylist()):
                own = [langs[i] for i in ids]
                for h, bounds in _hashed(cps, offsets):
                    for lang in set(own):
                        mine = np.repeat([x == lang for x in own], np.diff(bounds))
                        counts[lang] = counts.get(lang, 0) + np.bincount(h[mine], minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = drawn.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)))
    counts[rows.bucket.to_numpy(int), rows.lang.map(names.index).to_numpy(int)] = rows.n
    return Languages(names, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32))


def classify(texts: list[str | None], model: Languages) -> tuple[list[str], np.ndarray]:
    n_langs = len(model.names)
    total = np.zeros((len(texts), n_langs))
    if n_langs:
        for ids, offsets, cps in _blocks(texts):
            for h, bounds in _hashed(cps, offsets):
                for k in range(n_langs):
                    sums = np.concatenate([[0.0], np.cumsum(model.log_p[h, k], dtype=np.float64)])
                    np.add.at(total[:, k], ids, sums[bounds[1:]] - sums[bounds[:-1]])
    lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool) & (n_langs > 0)
    if not n_langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    odds = np.exp(total - total.max(1, keepdims=True))
    score = np.where(lettered, 1 / odds.sum(1), 0.0)
    return [model.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def identify(docs: DataFrame, model: Languages, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), lang_pred and score."""
    matrix = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: pa.Array):
            names, score = classify(texts.to_pylist(), matrix.value)
            return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

        return work

    return map_texts(docs, docs.columns if keep is None else keep, make, [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
