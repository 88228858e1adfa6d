"""SentencePiece encoding and decoding by suffix-array matching.

Spaces become U+2581 and one is put before the text. No piece goes on past a
U+2581 that follows another character, so a text falls into units: a run of them
and what follows. The units of a batch that are new are concatenated and indexed
by a suffix array as deep as the longest piece. All pieces are looked up in it by
binary search; their occurrence ranges are the edges of the units' lattices.
Sorted by position, the edges are relaxed by rank: again and again a unit's best
ranked edge that joins just two present symbols is taken, the leftmost of equals,
which gives the segmentation of the model's own merges. Characters left over are
spelled as byte pieces.

The model must be of BPE kind with byte pieces and the identity normaliser, as
piece_bpe_32k.model is. A null or empty text has no ids. Decoding gives the text
back, save that a literal U+2581 reads as a space. A long text is cut at its units,
and a unit of more than LONG_UNIT code points is relaxed with a heap, CACHED units at
most are remembered: ids are the same either way. Rows are handled one by one, so
ties, repeats and null ids don't matter; kept columns named as a result give way to
it. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from .common import map_texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
DEPTH = 16  # code points compared, four to a word of 64 bits
CACHED = 300_000
LONG_UNIT = 256
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pieces:
    def __init__(self, model: str = MODEL):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.byte_id = {int(_BYTE.match(names[i])[1], 16): i for i in range(len(names)) if sp.is_byte(i)}
        self.raw = [b""] * len(names)
        for i in plain:
            self.raw[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        self.char_id = {names[i]: i for i in plain if len(names[i]) == 1}
        if max(len(names[i]) for i in plain) > DEPTH:
            raise ValueError("the model has longer pieces than the suffix array is deep")
        # code points that pieces use, as ranks from 1; any other is 0
        used = sorted({c for i in plain for c in names[i]})
        self.rank_of = np.zeros(0x110000, np.uint16)
        self.rank_of[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        many = [i for i in plain if len(names[i]) > 1]
        self.ids = np.array(many)
        self.order = np.argsort(np.argsort([-sp.get_score(i) for i in many], kind="stable"))
        self.length = np.array([len(names[i]) for i in many])
        cps = np.zeros((len(many), DEPTH), np.uint16)
        for k, i in enumerate(many):
            cps[k, : len(names[i])] = self.rank_of[[ord(c) for c in names[i]]]
        self.low = _words(cps)
        full = cps.copy()
        full[np.arange(DEPTH) >= self.length[:, None]] = 0xFFFF
        self.high = _words(full)
        self.id_of_order = np.empty(len(many), np.int64)
        self.id_of_order[self.order] = self.ids

    def spell(self, char: str) -> list[int]:
        known = self.char_id.get(char)
        return [known] if known is not None else [self.byte_id[b] for b in char.encode("utf-8", "replace")]


def _words(cps: np.ndarray) -> np.ndarray:
    """(n, DEPTH) ranks as (n, DEPTH // 4) words that compare as they do."""
    return np.ascontiguousarray(cps.astype(">u2")).view(">u8").astype(np.uint64).reshape(len(cps), -1)


def suffix_array(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next DEPTH ranks, and these as words."""
    padded = np.concatenate([ranks, np.zeros(DEPTH, np.uint16)]).astype(np.uint64)
    four = (padded[:-3] << np.uint64(48)) | (padded[1:-2] << np.uint64(32)) | (padded[2:-1] << np.uint64(16)) | padded[3:]
    n = len(ranks)
    keys = np.stack([four[4 * j : 4 * j + n] for j in range(DEPTH // 4)], 1)
    order = np.lexsort(keys.T[::-1])
    return order, keys[order]


def _search(keys: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all ``wanted`` rows at once among the sorted ``keys``."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        row = keys[np.minimum(mid, len(keys) - 1)]
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for j in range(keys.shape[1]):
            less |= same & (row[:, j] < wanted[:, j])
            same &= row[:, j] == wanted[:, j]
        right = (less | (same & after)) & open_
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def edges(ranks: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, order) of all occurrences of pieces, by position."""
    at, keys = suffix_array(ranks)
    first, last = _search(keys, pieces.low, False), _search(keys, pieces.high, True)
    times = np.maximum(last - first, 0)
    piece = np.repeat(np.arange(len(times)), times)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(times) - times, times)
    start = at[first[piece] + inside]
    by_position = np.argsort(start, kind="stable")
    start, piece = start[by_position], piece[by_position]
    return start, start + pieces.length[piece], pieces.order[piece]


def _relax_long(n: int, start: list[int], end: list[int], order: list[int]) -> list[bool]:
    """Boundaries left in one unit, by a heap of the edges that can be taken."""
    bound, nxt, prev = [True] * (n + 1), list(range(1, n + 2)), list(range(-1, n))
    of = {(s, e): o for s, e, o in zip(start, end, order, strict=True)}
    heap = [(of[s, s + 2], s, s + 1, s + 2) for s in range(n - 1) if (s, s + 2) in of]
    heapq.heapify(heap)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if not (bound[s] and bound[m] and bound[e]) or nxt[s] != m or nxt[m] != e:
            continue
        bound[m] = False
        nxt[s], prev[e] = e, s
        if e < n and (s, nxt[e]) in of:
            heapq.heappush(heap, (of[s, nxt[e]], s, e, nxt[e]))
        if s > 0 and (prev[s], e) in of:
            heapq.heappush(heap, (of[prev[s], e], prev[s], s, e))
    return bound


def relax(n: int, unit: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each of the n + 1 positions is still a boundary. ``unit``: of an edge."""
    bound = np.ones(n + 1, bool)
    while len(start):
        count = np.concatenate([[0], np.cumsum(bound)])
        within = count[end] - count[start]
        live = bound[start] & bound[end] & (within > 1)
        unit, start, end, order, within = unit[live], start[live], end[live], order[live], within[live]
        ready = np.flatnonzero(within == 2)
        if not len(ready):
            break
        # of each unit: the best rank, and of its places the leftmost
        best = ready[np.lexsort((start[ready], order[ready], unit[ready]))]
        best = best[np.r_[True, unit[best][1:] != unit[best][:-1]]]
        lo, hi = start[best], end[best]
        middle = np.searchsorted(count[1:], count[lo + 1], "right")
        middle = np.minimum(middle, hi - 1)
        bound[middle] = False
    return bound


class Codec:
    def __init__(self, model: str = MODEL):
        self.pieces = Pieces(model)
        self.known: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        p = self.pieces
        text = "\n".join(units)  # a newline is in no piece but byte pieces
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(u) for u in units])
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]) if len(units) else np.zeros(0, int)
        start, end, order = edges(p.rank_of[cps], p)
        owner = np.searchsorted(starts, start, "right") - 1
        long = lengths[owner] > LONG_UNIT
        bound = relax(len(cps), owner[~long], start[~long], end[~long], order[~long])
        for u in np.unique(owner[long]):
            mine = owner == u
            s0 = starts[u]
            bound[s0 : s0 + lengths[u] + 1] = _relax_long(int(lengths[u]), (start[mine] - s0).tolist(), (end[mine] - s0).tolist(), order[mine].tolist())
        # symbols of more than one character are the edges between neighbouring boundaries
        count = np.concatenate([[0], np.cumsum(bound)])
        taken = bound[start] & bound[end] & (count[end] - count[start] == 1)
        symbol = dict(zip(start[taken].tolist(), p.id_of_order[order[taken]].tolist(), strict=True))
        cuts = np.flatnonzero(bound)
        lo, hi = np.searchsorted(cuts, starts), np.searchsorted(cuts, starts + lengths)
        cuts = cuts.tolist()
        for u, a, b in zip(units, lo.tolist(), hi.tolist(), strict=True):
            ids: list[int] = []
            for c in cuts[a:b]:
                got = symbol.get(c)
                if got is None:
                    ids += p.spell(text[c])
                else:
                    ids.append(got)
            self.known[u] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        fresh = set().union(*split) - self.known.keys()
        if fresh:
            self._learn(sorted(fresh))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), "<u4") for units in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.pieces.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _in_parts(texts: pa.Array, most: int = 1 << 21) -> Iterator[list[str]]:
    part, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        part.append(text)
        size += len(text)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``keep`` columns (all by default) and ids."""

    def make():
        codec = Codec(model)
        return lambda texts: [pa.array([ids.astype(np.int32) for part in _in_parts(texts) for ids in codec.encode(part)], pa.list_(pa.int32()))]

    return map_texts(docs, docs.columns if keep is None else keep, make, [StructField("ids", ArrayType(IntegerType()))])


def decode(encoded: DataFrame, keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``keep`` columns (all by default) and text, from ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(np.array(v.as_py() or [], np.int64)) for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, "text"])

    kept = [c for c in (encoded.columns if keep is None else keep) if c.lower() != "text"]
    source = encoded.select(*dict.fromkeys([*kept, "ids"]))
    schema = source.select(*kept).schema.add(StructField("text", StringType()))
    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``keep`` columns (all by default), n_tokens, ids_crc32 (little-endian
    unsigned 32-bit ids) and whether decoding gives the text back."""

    def make():
        codec = Codec(model)

        def work(texts: pa.Array):
            counts, sums, same = [], [], []
            for part in _in_parts(texts):
                for text, ids in zip(part, codec.encode(part), strict=True):
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    same.append(codec.decode(ids) == text)
            return [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same)]

        return work

    fields = [StructField("n_tokens", LongType()), StructField("ids_crc32", LongType()), StructField("round_trip", BooleanType())]
    return map_texts(docs, docs.columns if keep is None else keep, make, fields)
