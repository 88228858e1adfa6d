"""MP4 files as a Spark data source: timing and sample tables, from their boxes.

``spark.read.format("mp4")`` reads by ranges: the headers of the top boxes, then ``moov``
alone, so a video's size doesn't matter; nothing is decoded. A partition is a file, or
``filesPerPartition`` of them, and more where there would be over ``maxPartitions``: a
partition costs more than many files' tables. The path may hold a pattern, and option ``names`` (JSON)
chooses files by name before any is opened; conditions aren't pushed into the source, as
Spark 4.1 keeps them for later queries of the same table. Only boxes that the asked
columns need are read out.

Option ``rows``:

* ``tracks`` (as standard): one row a file, with its timing runs. A file that can't be
  read says why and stops no other.
* ``moov``: the tables of the video track as they are stored, a row for each entry, for
  ``operators.demux``. Files that can't be demuxed have no rows here.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import listed, reader

TRACKS = (
    "path string, name string, length long, ok boolean, error string, timescale long, stts array<struct<count:int,delta:long>>, "
    "demux_error string, codec string, width int, height int, description binary, samples long"
)
#: kind: size (at: sample), chunk (at: chunk, value: offset), stsc (at: first chunk,
#: value: samples in each), stts and ctts (at: run, n: samples, value: ticks), stss (at:
#: sample). Samples and chunks count from 0.
MOOV = "path string, kind string, at long, n long, value long"
VIDEO = re.compile(r"\.(mp4|m4v|mov|avi|webm|mkv)$", re.I)
Span = tuple[int, int]


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the contents of the boxes in a range."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _child(data: memoryview, at: Span, *path: bytes) -> Span | None:
    for kind in path:
        found = next(((a, b) for k, a, b in boxes(data, *at) if k == kind), None)
        if found is None:
            return None
        at = found
    return at


def moov_of(read: Callable[[int, int], bytes], length: int) -> memoryview:
    """The contents of ``moov``, found by the headers of the boxes before it."""
    at = 0
    while at + 8 <= length:
        head = read(at, 16)
        size, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if size == 1 and len(head) == 16:
            size, skip = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = length - at
        if size < skip or at + size > length:
            break
        if kind == b"moov":
            return memoryview(read(at + skip, size - skip))
        at += size
    raise ValueError("no moov box")


class Movie:
    """The tracks of a ``moov`` box."""

    def __init__(self, moov: memoryview):
        self.data = moov
        self.tracks = [(a, b) for k, a, b in boxes(moov) if k == b"trak"]

    def at(self, track: Span, *path: bytes) -> Span | None:
        return _child(self.data, track, *path)

    def table(self, track: Span, kind: bytes, width: int, skip: int = 4) -> np.ndarray | None:
        """Entries of a table of the track: rows of ``width`` unsigned 32-bit numbers."""
        at = self.at(track, b"mdia", b"minf", b"stbl", kind)
        if at is None:
            return None
        n = struct.unpack_from(">I", self.data, at[0] + skip)[0]
        if at[0] + skip + 4 + 4 * width * n > at[1]:
            raise ValueError(f"the table {kind.decode()} is cut off")
        return np.frombuffer(self.data, ">u4", width * n, at[0] + skip + 4).reshape(n, width).astype(np.int64)

    def handler(self, track: Span) -> bytes:
        at = self.at(track, b"mdia", b"hdlr")
        return bytes(self.data[at[0] + 8 : at[0] + 12]) if at else b""

    def video(self) -> Span | None:
        return next((t for t in self.tracks if self.handler(t) == b"vide"), None)

    def timing(self) -> tuple[int, list[tuple[int, int]]]:
        """(timescale, [(count, delta)]) of the first video track, else the first track."""
        if not self.tracks:
            raise ValueError("no track")
        track = self.video() or self.tracks[0]
        mdhd, runs = self.at(track, b"mdia", b"mdhd"), self.table(track, b"stts", 2)
        if mdhd is None or runs is None:
            raise ValueError("a track without timing")
        timescale = struct.unpack_from(">I", self.data, mdhd[0] + (20 if self.data[mdhd[0]] == 1 else 12))[0]
        if timescale <= 0 or runs[:, 0].sum() <= 0:
            raise ValueError("no frames")
        return timescale, [(int(c), int(d)) for c, d in runs]

    def codec(self) -> dict:
        """Codec, size in pixels and decoder configuration of the video track, which must
        be H.264."""
        track = self.video()
        if track is None:
            raise ValueError("no video track")
        at = self.at(track, b"mdia", b"minf", b"stbl", b"stsd")
        entry = next(boxes(self.data, at[0] + 8, at[1]), None) if at else None
        if entry is None:
            raise ValueError("no sample description")
        kind, start, end = entry
        name = kind.decode("latin-1")
        config = _child(self.data, (start + 78, end), b"avcC") if start + 78 <= end else None
        if config is None:
            raise ValueError(f"codec {name} is not supported: only H.264 with avcC is")
        profile = bytes(self.data[config[0] + 1 : config[0] + 4])
        width, height = struct.unpack_from(">HH", self.data, start + 24)
        return {"codec": f"{name}.{profile.hex()}", "width": width, "height": height, "description": bytes(self.data[config[0] : config[1]])}

    def sizes(self, track: Span) -> np.ndarray:
        at = self.at(track, b"mdia", b"minf", b"stbl", b"stsz")
        if at is not None:
            each, n = struct.unpack_from(">II", self.data, at[0] + 4)
            if each:
                return np.full(n, each, np.int64)
            return self.table(track, b"stsz", 1, 8)[:, 0]
        at = self.at(track, b"mdia", b"minf", b"stbl", b"stz2")
        if at is None:
            raise ValueError("no sample sizes")
        bits, n = self.data[at[0] + 7], struct.unpack_from(">I", self.data, at[0] + 8)[0]
        raw = np.frombuffer(self.data, np.uint8, (n * bits + 7) // 8, at[0] + 12).astype(np.int64)
        if bits == 4:
            return np.stack([raw >> 4, raw & 15], 1).ravel()[:n]
        return raw if bits == 8 else raw[::2] * 256 + raw[1::2]

    def offsets(self, track: Span) -> np.ndarray:
        short = self.table(track, b"stco", 1)
        if short is not None:
            return short[:, 0]
        wide = self.table(track, b"co64", 2)
        if wide is None:
            raise ValueError("no chunk offsets")
        return wide[:, 0] << 32 | wide[:, 1]

    def rows(self) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, at, n, value) of MOOV, a table at a time."""
        self.codec()
        track = self.video()
        assert track is not None
        sizes, chunks = self.sizes(track), self.offsets(track)
        one = lambda a: np.ones(len(a), np.int64)
        yield "size", np.arange(len(sizes)), one(sizes), sizes
        yield "chunk", np.arange(len(chunks)), one(chunks), chunks
        runs = self.table(track, b"stsc", 3)
        if runs is None:
            raise ValueError("no chunk map")
        yield "stsc", runs[:, 0] - 1, one(runs), runs[:, 1]
        for kind in (b"stts", b"ctts"):
            runs = self.table(track, kind, 2)
            if runs is not None:
                value = runs[:, 1]
                if kind == b"ctts" and len(runs):  # signed in version 1, and in version 0 by habit
                    value = np.where(value >= 1 << 31, value - (1 << 32), value)
                yield kind.decode(), np.arange(len(runs)), runs[:, 0], value
        keys = self.table(track, b"stss", 1)
        if keys is not None:
            yield "stss", keys[:, 0] - 1, one(keys), one(keys)


def parse_timing(content: bytes) -> tuple[int, list[tuple[int, int]]]:
    return Movie(moov_of(lambda at, n: content[at : at + n], len(content))).timing()


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.columns, self.options = schema.fieldNames(), options

    def partitions(self) -> Sequence[InputPartition]:
        names = set(json.loads(self.options["names"])) if "names" in self.options else None
        files = [(p, n) for p, n in listed(self.options["path"]) if names is None or p.rpartition("/")[2] in names]
        most = int(self.options.get("maxPartitions", "1000"))
        step = max(int(self.options.get("filesPerPartition", "1")), -(-len(files) // most))
        return [_Files(files[i : i + step]) for i in range(0, len(files), step)]

    def read(self, partition: InputPartition) -> Iterator:
        moov = self.options.get("rows", "tracks") == "moov"
        for path, length in getattr(partition, "files", []):
            if moov:
                yield from self._tables(path, length)
            else:
                yield self._track(path, length)

    def _track(self, path: str, length: int) -> tuple:
        row = dict.fromkeys([f.split()[0] for f in TRACKS.split(", ")]) | {"path": path, "name": path.rpartition("/")[2], "length": length, "ok": False}
        if set(self.columns) - {"path", "name", "length"}:
            read = close = None
            try:
                if not VIDEO.search(row["name"]):
                    raise ValueError("not a video file")
                read, close = reader(path)
                movie = Movie(moov_of(read, length))
                if set(self.columns) & {"demux_error", "codec", "width", "height", "description", "samples"}:
                    try:
                        row |= movie.codec() | {"samples": len(movie.sizes(movie.video()))}
                    except (ValueError, struct.error) as e:
                        row["demux_error"] = str(e)
                row["timescale"], runs = movie.timing()
                row |= {"ok": True, "stts": runs}
            except (ValueError, struct.error, OSError) as e:
                row["error"] = str(e)
                row["demux_error"] = row["demux_error"] or str(e)
            finally:
                if close:
                    close()
        return tuple(row[c] for c in self.columns)

    def _tables(self, path: str, length: int) -> Iterator[pa.RecordBatch]:
        if not VIDEO.search(path):
            return
        read, close = reader(path)
        try:
            found = list(Movie(moov_of(read, length)).rows())
        except (ValueError, struct.error):
            found = []  # the row of the file says why
        finally:
            close()
        for kind, at, n, value in found:
            made = {"path": pa.repeat(pa.scalar(path), len(at)), "kind": pa.repeat(pa.scalar(kind), len(at)), "at": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64()), "value": pa.array(value, pa.int64())}
            if len(at):
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns)


class Mp4Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return MOOV if self.options.get("rows", "tracks") == "moov" else TRACKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_mp4(spark: SparkSession, path: str, rows: str = "tracks", columns: str | None = None, files_per_partition: int = 1, names: list[str] | None = None) -> DataFrame:
    """``columns``: DDL of the columns that are wanted, so that no others are read;
    ``names``: the files that are wanted."""
    spark.dataSource.register(Mp4Source)
    source = spark.read.format("mp4").option("rows", rows).option("filesPerPartition", files_per_partition).option("maxPartitions", 8 * spark.sparkContext.defaultParallelism)
    if names is not None:
        source = source.option("names", json.dumps(names))
    return (source.schema(columns) if columns else source).load(path)


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, name, ok, error, timescale, stts."""
    return read_mp4(spark, path, columns="path string, name string, ok boolean, error string, timescale long, stts array<struct<count:int,delta:long>>")
