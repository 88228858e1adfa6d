"""Video files of the fixture's trials, for the queries over them: an H.264 track whose
samples, chunks and runs follow from the events, with bytes that tell where they lie."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import put, shared_folder

#: Bytes between chunks, and samples in the first three chunks and in later ones.
GAP, FIRST, LATER = 7, 3, 5


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def table(kind: bytes, rows: Iterable[tuple[int, ...]], width: int, version: int = 0) -> bytes:
    rows = list(rows)
    return box(kind, struct.pack(">II", version << 24, len(rows)), *[struct.pack(f">{width}I", *(v & 0xFFFFFFFF for v in r)) for r in rows])


def runs(values: Iterable[int]) -> list[tuple[int, int]]:
    return [(len(list(g)), v) for v, g in groupby(values)]


def track(tables: list[bytes], timescale: int = 1000, handler: bytes = b"vide", entry: bytes | None = None) -> bytes:
    if entry is None:
        entry = box(b"avc1", b"\0" * 24, struct.pack(">HH", 64, 48), b"\0" * 50, box(b"avcC", b"\x01\x64\x00\x1e\xff"))
    stsd = box(b"stsd", struct.pack(">II", 0, 1), entry)
    mdhd, hdlr = box(b"mdhd", struct.pack(">IIII", 0, 0, 0, timescale), b"\0" * 8), box(b"hdlr", b"\0" * 8, handler, b"\0" * 12)
    return box(b"trak", box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stsd, *tables))))


def movie(data: list[bytes], deltas: list[int], shifts: list[int], keys: list[int], wide: bool = False) -> bytes:
    """A file whose media come before its tables."""
    out, offsets, at, per = bytearray(box(b"ftyp", b"isom", b"\0" * 4)), [], 0, []
    out += struct.pack(">I4s", 0, b"mdat")
    start = len(out) - 8
    while at < len(data):
        n = min(FIRST if len(per) < 3 else LATER, len(data) - at)
        offsets.append(len(out))
        out += b"".join(data[at : at + n]) + b"\xee" * GAP
        per.append(n)
        at += n
    struct.pack_into(">I", out, start, len(out) - start)
    chunk_map = [(1 + sum(n for n, _ in runs(per)[:i]), v, 1) for i, (_, v) in enumerate(runs(per))]
    places = table(b"co64", [(o >> 32, o) for o in offsets], 2) if wide else table(b"stco", [(o,) for o in offsets], 1)
    sizes = box(b"stsz", struct.pack(">III", 0, 0, len(data)), *[struct.pack(">I", len(d)) for d in data])
    tables = [table(b"stts", runs(deltas), 2), table(b"ctts", runs(shifts), 2, 1), table(b"stsc", chunk_map, 3), sizes, places, table(b"stss", [(k + 1,) for k in keys], 1)]
    return bytes(out + box(b"moov", track([table(b"stts", [(1, 1)], 2)], 48000, b"soun", box(b"mp4a")), track(tables)))


def write_movies(spark: SparkSession, detections: DataFrame) -> str:
    """One file a trial in a shared folder, whose path is returned."""
    folder = shared_folder(spark, "movies")

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame_index")
        ids = rows.column("event_id").to_pylist()
        data = [bytes([e % 251]) * (20 + e % 50) for e in ids]
        keys = [i for i, e in enumerate(ids) if i == 0 or e % 10 == 0]
        content = movie(data, [40 if e % 3 else 45 for e in ids], [(e % 4 - 1) * 60 for e in ids], keys, wide=ids[0] % 2 == 0)
        put(f"{folder}/trial-{rows.column('trial_id')[0]}.mp4", content)
        return pa.table({"bytes": pa.array([len(content)], pa.int64())})

    detections.select("trial_id", "frame_index", "event_id").groupBy("trial_id").applyInArrow(write, "bytes long").agg(F.sum("bytes")).collect()
    return folder
