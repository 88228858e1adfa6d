"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library's trainer: one on toxic text,
one on ordinary text. From either class the trainer gets the stretches that the
other class rarely holds (runs of byte n-grams whose share of documents differs more
than chance explains), else both dictionaries would hold the same common syllables.
Both then share one dictionary of all ordinary text behind their own, so that common
words cost the same in either. A text is cut into overlapping windows; each window is
compressed with either dictionary, and the bytes that the toxic one saves are the
window's distance. A logistic function of a document's distances (the largest, sums
of the largest, their mean, what exceeds a byte, and how many do), calibrated across
two halves of the labelled documents, each rated by dictionaries of the other half,
is its score.

Windows cover the whole text, long texts too; A-Z count as a-z, and what is not a
letter or beyond ASCII counts as a space. A null text is empty; an empty text has no
distance and gets the score of that. Rows are scored one by one: ties, repeated rows
and null ids don't matter. Columns named score or predicted give way to the results.
An empty table gives no rows. Without learnable labels of both classes every score is
0; where too little tells the classes apart to train a dictionary, it stays empty.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .common import labelled_sample, learnable, map_texts

#: Labelled documents of either class at most, and their longest text in bytes:
#: they reach the driver, so this bounds its memory.
PER_CLASS, LONGEST = 3000, 1 << 14
CUT = 0.3
WINDOW, STEP = 128, 112
#: Bytes of a class's own dictionary and of the shared one; the trainer's segment
#: and smallest match.
OWN_BYTES, SHARED_BYTES, SEGMENT, MATCH = 4096, 4096, 24, 8
#: Bytes of the n-grams whose shares of documents are compared.
GRAM = 6
_WORD = re.compile(rb"[^\x00-\x60\x7b-\x7f]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SIGNATURE = 8


@dataclass(frozen=True)
class Toxicity:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float


def plain(text: str | None) -> bytes:
    """Words in lower case between single spaces."""
    return b" " + b" ".join(_WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))) + b" "


def windows(text: bytes, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(1, len(text) - (size - step)), step)]


def distinct(texts: list[bytes]) -> list[bytes]:
    """Without near copies of earlier texts: what a group of copies repeats says
    nothing about its class."""
    odd = np.random.RandomState(8).randint(1, 1 << 31, _SIGNATURE) * 2 + 1
    seen: list[set[int]] = [set() for _ in odd]
    out = []
    for text in texts:
        words = text.split()
        triples = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(len(words) - 2, 1))], np.int64)
        least = [int((triples * o & 0xFFFFFFFF).min()) for o in odd]
        if sum(h in s for h, s in zip(least, seen, strict=True)) <= _SIGNATURE // 2:
            out.append(text)
            for h, s in zip(least, seen, strict=True):
                s.add(h)
    return out


def _grams(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    out = np.zeros(max(len(data) - GRAM + 1, 0), np.int64)
    for j in range(GRAM):
        out = out << 8 | data[j : j + len(out)]
    return out


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(_grams(t)) for t in texts)]), return_counts=True)


def stretches(own: list[bytes], other: list[bytes]) -> list[bytes]:
    """The runs of ``own`` texts whose n-grams are in too large a share of them.

    An n-gram tells the class when the log likelihood ratio of its share beats the
    logarithm of the number of n-grams, which chance rarely does for one of them.
    """
    grams, here = _document_counts(own)
    if not len(grams) or not other:
        return []
    elsewhere, n_there = _document_counts(other)
    at = np.minimum(np.searchsorted(elsewhere, grams), len(elsewhere) - 1)
    there = np.where(elsewhere[at] == grams, n_there[at], 0)
    expected = len(own) / (len(own) + len(other))
    total = here + there
    share = here / total
    ratio = total * (share * np.log(share / expected) + np.where(share < 1, (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - expected)), 0))
    telling = grams[(share > expected) & (ratio >= np.log(len(grams)))]
    out = []
    for text in own:
        begins = np.flatnonzero(np.isin(_grams(text), telling))
        if len(begins):
            first = np.flatnonzero(np.r_[True, np.diff(begins) > GRAM])
            last = np.r_[first[1:], len(begins)] - 1
            out += [text[begins[a] : begins[b] + GRAM] for a, b in zip(first, last, strict=True)]
    return out


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary by the library's trainer; empty where the samples don't do."""
    import zstandard

    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except zstandard.ZstdError:  # too few bytes
        return b""


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents."""
    shared = train([w for t in ordinary for w in windows(t, 256, 256)], SHARED_BYTES)
    own = [train(stretches(a, b), OWN_BYTES) for a, b in ((ordinary, toxic), (toxic, ordinary))]
    reach = max(map(len, own))
    return own[0].rjust(reach, b"\n") + shared, own[1].rjust(reach, b"\n") + shared


class Distance:
    """Bytes that the toxic dictionary saves in each window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters(
            format=z.FORMAT_ZSTD1_MAGICLESS, window_log=14, chain_log=14, hash_log=13, search_log=6, min_match=3, target_length=64,
            strategy=z.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        self._pair = []
        for content in (ordinary, toxic):
            held = z.ZstdCompressionDict(content or b"\n" * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self._pair.append(z.ZstdCompressor(dict_data=held, compression_params=params).compress)

    def saved(self, text: bytes) -> np.ndarray:
        ordinary, toxic = self._pair
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], float)

    def features(self, text: bytes) -> list[float]:
        saved = self.saved(text)
        top = np.zeros(8)
        best = np.sort(saved)[::-1][:8]
        top[: len(best)] = best
        over = np.maximum(saved - 1, 0)
        return [top[0] / 4, top[:2].sum() / 8, top[:4].sum() / 16, top.sum() / 32, saved.mean(), np.log1p(over.sum()), np.log1p((over > 0).sum()), (over > 0).mean()]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([ridge] * (len(w) - 1) + [1e-6])
        step = np.linalg.solve(hess, grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fit_texts(texts: list[str], y: np.ndarray, toxic_share: float) -> Toxicity | None:
    """``toxic_share``: of the population, which the score is calibrated to."""
    classes = []
    for label in (0, 1):
        mine = sorted({plain(t) for t, v in zip(texts, y, strict=True) if v == label}, key=lambda t: (zlib.crc32(t), t))
        classes.append(distinct(mine))
    if not all(classes):
        return None
    x, t = [], []
    for learn, rest in ((0, 1), (1, 0)):  # either half is rated by dictionaries of the other
        of = Distance(*train_dictionaries(classes[1][learn::2], classes[0][learn::2]))
        for label in (0, 1):
            x += [of.features(d) for d in classes[label][rest::2]]
            t += [label] * len(classes[label][rest::2])
    t = np.array(t, float)
    share = min(max(t.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(t == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    w = _logistic(np.array(x), t, weight)
    return Toxicity(*train_dictionaries(classes[1], classes[0]), w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Toxicity | None:
    share = learnable(labels, label).agg(F.avg("y")).first()[0]
    rows = labelled_sample(docs, labels, label, per_class, LONGEST).toPandas()
    return fit_texts(rows.text.tolist(), rows.y.to_numpy(int), float(share)) if len(rows) else None


def score(docs: DataFrame, model: Toxicity | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), with score and predicted."""

    def make():
        of = Distance(model.ordinary, model.toxic) if model else None

        def work(texts: pa.Array):
            if of is None:
                got = np.zeros(len(texts))
            else:
                x = np.array([of.features(plain(t.as_py())) for t in texts])
                got = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))
            return [pa.array(got, pa.float64()), pa.array((got >= CUT).astype(np.int32))]

        return work

    return map_texts(docs, docs.columns if keep is None else keep, make, [StructField("score", DoubleType()), StructField("predicted", IntegerType())])
