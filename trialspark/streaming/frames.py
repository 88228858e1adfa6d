"""Frame tables as a stream with back-pressure: no more than some frames a trigger.

The stream itself holds references, a row for each row group of the Parquet files of a
folder, read off their footers in order of names. A trigger takes groups until
``maxFrames`` are reached (one at least), and its offset says how far it came, so a
restart goes on where the checkpoint says. The frames are read by the tasks, by ranges
and columns; none passes the driver. Files may be added while it runs; their names must
sort after those that were read (a writer that numbers its files does that).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..sources.files import listed, opened

REFERENCE = "path string, row_group int, frames long"


class _Groups(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"file": "", "groups": 0}

    def _after(self, start: dict) -> Iterator[tuple[str, int, int]]:
        """(path, row group, rows) of the groups behind an offset."""
        for path, _ in listed(self.path):
            name = path.rpartition("/")[2]
            if name < start["file"] or not name.endswith(".parquet"):
                continue
            system, inner, _ = opened(path)
            with system.open_input_file(inner) as f:
                footer = pq.read_metadata(f)
            for g in range(start["groups"] if name == start["file"] else 0, footer.num_row_groups):
                yield path, g, footer.row_group(g).num_rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        taken, frames, end = [], 0, start
        for path, g, n in self._after(start):
            if taken and frames + n > self.most:
                break
            taken.append((path, g, n))
            frames += n
            end = {"file": path.rpartition("/")[2], "groups": g + 1}
        return iter(taken), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        upto = (end["file"], end["groups"])
        return iter([r for r in self._after(start) if (r[0].rpartition("/")[2], r[1] + 1) <= upto])

    def commit(self, end: dict) -> None:
        pass


class FrameGroups(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_groups"

    def schema(self) -> str:
        return REFERENCE

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Groups(self.options["path"], int(self.options.get("maxFrames", "10000")))


def read_frames(spark: SparkSession, path: str, schema: StructType, max_frames: int = 10_000, tasks: int | None = None) -> DataFrame:
    """A stream of the rows of the Parquet files in ``path``, ``max_frames`` a trigger."""
    spark.dataSource.register(FrameGroups)
    groups = spark.readStream.format("frame_groups").option("maxFrames", max_frames).load(path)
    schema = StructType([StructField(f.name, f.dataType) for f in schema.fields])  # end markers have nulls
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner, _ = opened(place)
                with system.open_input_file(inner) as f:
                    for part in pq.ParquetFile(f).iter_batches(row_groups=[group], columns=arrow.names, batch_size=1000):
                        yield from pa.Table.from_batches([part]).select(arrow.names).cast(arrow).to_batches()

    return groups.repartition(tasks or spark.sparkContext.defaultParallelism, "path", "row_group").mapInArrow(run, schema)
