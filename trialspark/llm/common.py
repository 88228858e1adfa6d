"""What the operators share: table reads, written intermediates, word hashing.

Word hashing works on the Arrow buffers of whole batches. A word is a maximal
run of bytes other than space and 0x09-0x0D; its hash is a polynomial in the
bytes modulo 2**64, read off prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that the numpy code handles at a time; a longer text goes alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.RandomState(20240229)


def random_u64(rng: np.random.RandomState, n: int) -> np.ndarray:
    return rng.randint(0, 1 << 32, n).astype(_U) << _U(32) | rng.randint(0, 1 << 32, n).astype(_U)


_BYTE = random_u64(_RNG, 256)
_ODD = [int(x) | 1 for x in random_u64(_RNG, 16)]
_BASE = _ODD[15]
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def apart(docs: DataFrame, reads: tuple[str, ...], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on ``docs``, whose columns other than those it ``reads`` have other
    names meanwhile: no result column takes the place of one of them."""
    own = {c: c if c in reads else f"__own_{i}" for i, c in enumerate(docs.columns)}
    out = run(docs.select(*[q.alias(own[c]) for c, q in zip(docs.columns, quoted(docs.columns), strict=True)]))
    return out.select(*[F.col(own[c]).alias(c) for c in docs.columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder
    of the context. Only a local session may have neither; it gets one in /tmp."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = known.get() if known.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = "/tmp/trialspark-checkpoints"
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session, and its gateway, may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage.

    A lost executor then costs a reread, not the work before. Files last as long
    as the process, since results are lazy and may be read at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trialspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels to learn from; an id labelled both 0 and 1 has none,
    and a repeated one counts once."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("z"))
    return known.where("y = z").select("doc_id", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> DataFrame:
    """(text, y) of at most ``per_class`` learnable documents of either class.

    They are those whose hashed id is least, among texts of ``longest`` bytes or
    less. Only the ids, at most twice ``per_class`` of them, are broadcast.
    """
    known = learnable(labels, label).withColumnRenamed("doc_id", "_id")
    few = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    ids = few[0].unionByName(few[1])
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    # an id that many rows repeat counts once
    return texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    usual = CHUNK_BYTES + 4096
    if n <= usual and _POWERS:
        return _POWERS[usual]
    size = max(n, usual)
    up, down = np.full(size, _BASE, _U), np.full(size, _BASE_INV, _U)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    if size == usual:
        _POWERS[usual] = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a bijection on 64 bits)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together, one at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of a run of documents: ``start``/``end`` bytes, ``doc`` and ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        n = len(data)
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        solid = ~_SPACE[data]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        inner = offsets[:-1][offsets[:-1] < n]
        before[inner] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        #: words of document i: first[i] to first[i + 1]
        self.first = np.searchsorted(self.start, offsets)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        self._sums, self._down = sums, down
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, the same wherever the span lies."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(_U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows that stay in one document, and the first
        word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        last_of = np.repeat(self.first[1:], self.counts())
        at = np.flatnonzero(np.arange(n) + k <= last_of[:n])
        total = np.zeros(len(at), _U)
        for j in range(k):
            total += self.hash[at + j] * _U(_ODD[j])
        return mix(total), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct k-word shingle hashes by document, concatenated in ascending
        order, and n_docs + 1 offsets. Fewer than k words make one shingle."""
        hashes, at = self.windows(k)
        bounds = np.searchsorted(at, self.first)
        counts = self.counts()
        parts, sizes = [], np.zeros(self.n_docs, np.int64)
        for i in range(self.n_docs):
            if counts[i] >= k:
                got = np.unique(hashes[bounds[i] : bounds[i + 1]])
            elif counts[i]:
                own = self.hash[self.first[i] : self.first[i + 1]]
                got = mix(np.add.reduce(own * np.array(_ODD[: len(own)], _U), keepdims=True) + _U(_ODD[14] * int(counts[i]) % (1 << 64)))
            else:
                continue
            parts.append(got)
            sizes[i] = len(got)
        return np.concatenate(parts) if parts else np.zeros(0, _U), np.concatenate([[0], np.cumsum(sizes)])


def map_texts(docs: DataFrame, keep: list[str], make: Callable[[], Callable], fields: list[StructField]) -> DataFrame:
    """``keep`` columns of ``docs`` followed by ``fields``, row by row.

    ``make()`` runs once a task and returns a function from the text array of a
    batch to the arrays of ``fields``. A kept column named as a field gives way
    to it; columns not kept stay in the scan.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in keep if c.lower() not in new]
    # plain names on the way: mapInArrow takes a dot in a name for a field of a struct
    own = kept if "text" in kept else [*kept, "text"]
    source = docs.select(*[q.alias(f"c{i}") for i, q in enumerate(quoted(own))])
    schema = StructType([*source.schema.fields[: len(kept)], *fields])
    names, last, at = schema.fieldNames(), len(kept), own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], *work(batch.column(at))], names)

    return source.mapInArrow(run, schema).toDF(*kept, *[f.name for f in fields])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; empty segments give 0."""
    totals = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=totals[1:])
    return totals[offsets[1:]] - totals[offsets[:-1]]


def emit_counts(counts: np.ndarray, *key: object) -> pa.RecordBatch:
    """(key..., bucket, n) for the buckets that have a count."""
    at = np.flatnonzero(counts)
    keys = [pa.array([k] * len(at)) for k in key]
    return pa.RecordBatch.from_arrays([*keys, pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], [*(f"k{i}" for i in range(len(key))), "bucket", "n"])
