"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target and the
raw corpus.

Byte n-grams of two orders are hashed to buckets: unlike words, they are dense
enough that a small trusted sample tells all of them. Two multinomials over the
buckets are counted: one on trusted texts (a bounded sample of the documents
labelled good), one on every document of the corpus. A document's score is the
mean, over its n-grams, of log p(target) - log p(raw); it is kept when the score
is at least ``threshold`` and the base rules hold. The threshold decides each
document by itself, so nothing is drawn.

A null text is empty. An empty text fails the base rules. Long texts count and are
scored whole; of equal scores all pass or none; repeated rows and null ids are rows
like others. Kept columns named as a result give way to it. An empty table gives no
rows. Without a trusted text all scores are 0, and the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from .common import Words, chunks, emit_counts, labelled_sample, map_texts, mix, segment_sums, text_buffers

BUCKETS = 1 << 16
ORDERS = (3, 4)
#: Trusted documents at most, and their longest text in bytes.
TRUSTED, LONGEST = 4000, 1 << 17
THRESHOLD = -0.5
#: Prior n-grams for each bucket, dealt as in the raw corpus.
PRIOR = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_U = np.uint64


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each order, by document, and their offsets."""
    n = len(data)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    both = np.full((n, len(ORDERS)), -1, np.int64)
    for k, order in enumerate(ORDERS):
        h = np.full(max(n - order + 1, 0), order, _U)
        for j in range(order):
            h = h << _U(8) | data[j : n - order + 1 + j].astype(_U)
        both[: len(h), k] = np.where(left[: len(h)] >= order, (h * _U(0x9E3779B97F4A7C15) >> _U(48)).astype(np.int64), -1)
    flat = both.ravel()
    solid = flat >= 0
    return flat[solid], np.concatenate([[0], np.cumsum(solid)])[len(ORDERS) * offsets]


def count_ngrams(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of a table, summed in Spark; BUCKETS rows at most return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets):
                total += np.bincount(ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], minlength=BUCKETS)
        yield emit_counts(total)

    rows = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows.bucket.to_numpy(int)] = rows.n.to_numpy(int)
    return counts


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio by bucket."""
    good = labelled_sample(docs, labels, "quality", TRUSTED, LONGEST).where(F.col("y") == 1)
    target, raw = count_ngrams(good).astype(float), count_ngrams(docs).astype(float)
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    # a bucket's target share is drawn to its raw share where the target is thin
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    mass = PRIOR * BUCKETS
    p_target = (target + mass * p_raw) / (target.sum() + mass)
    return np.log(p_target) - np.log(p_raw)


def base_rules(words: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each document."""
    data, offsets, n_docs = words.data, words.offsets, words.n_docs
    n_words = words.counts().astype(np.int64)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = segment_sums(leads[words.end] - leads[words.start], words.first)
    symbols = segment_sums(_SYMBOL[data], offsets)

    # a line runs from a document's start or a newline to the next one
    breaks = np.flatnonzero(data == 10)
    docs_at = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends_of = np.concatenate([breaks, offsets[1:]])
    doc_of = np.concatenate([np.arange(n_docs), docs_at])
    order = np.lexsort((starts, doc_of))
    starts, doc_of = starts[order], doc_of[order]
    ends_of = ends_of[np.lexsort((ends_of, np.concatenate([docs_at, np.arange(n_docs)])))]
    solid = np.searchsorted(words.start, ends_of) > np.searchsorted(words.start, starts)
    starts, ends_of, doc_of = starts[solid], ends_of[solid], doc_of[solid]
    keys = mix(words.span_hash(starts, ends_of) + mix(doc_of.astype(_U) + _U(1)))
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    dup_lines = np.bincount(doc_of[~first], minlength=n_docs)

    hashes, at = words.windows(3)
    doc_of_word = np.repeat(np.arange(n_docs), n_words)
    keys = mix(hashes + mix(doc_of_word[at].astype(_U) + _U(1)))
    _, where, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = at[times[where] > 1]
    marked = np.zeros(len(words.hash), bool)
    for j in range(3):
        marked[again + j] = True
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": segment_sums(marked, words.first)}


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), the base counts, llr, base_failed, kept."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        def work(texts: pa.Array):
            data, offsets = text_buffers(texts)
            parts: list[dict[str, np.ndarray]] = []
            for a, b in chunks(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got = base_rules(words)
                buckets, bounds = ngrams(words.data, words.offsets)
                got["llr"] = segment_sums(table.value[buckets], bounds) / np.maximum(np.diff(bounds), 1)
                parts.append(got)
            all_ = {k: np.concatenate([p[k] for p in parts]) for k in [*_COUNTS, "llr"]}
            failed = (all_["n_words"] < MIN_WORDS) | (100 * all_["n_repeat_words"] > REPEAT_PERCENT * all_["n_words"])
            return [pa.array(all_[k], pa.int64()) for k in _COUNTS] + [pa.array(all_["llr"], pa.float64()), pa.array(failed), pa.array(~failed & (all_["llr"] >= threshold))]

        return work

    fields = [StructField(c, LongType()) for c in _COUNTS] + [StructField("llr", DoubleType()), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())]
    return map_texts(docs, docs.columns if keep is None else keep, make, fields)
