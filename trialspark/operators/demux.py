"""Samples of videos from the tables of their files: run-length joins as windows.

``moov`` rows (``sources.mp4``) are runs over chunks and over samples. All are laid in
one order by file and position, and each sample takes the last run that has begun: its
chunk's offset, its duration, its shift of composition. One exchange by file serves all
windows; a file's samples are one ordered series, as its frames are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import reader


#: Samples that a task should have to sort, of whole files.
SAMPLES = 50_000


def samples(moov: DataFrame, expected: int | None = None) -> DataFrame:
    """One row a sample, in decoding order: path, sample, chunk, offset, size, tick,
    delta, composition_tick, composition_index, is_key.

    ``expected``: about how many samples there are in all, if it is known; tasks then
    have about SAMPLES of them, however many files there are.

    Without ``stss`` all samples are key frames, without ``ctts`` they are shown in
    decoding order. A sample that no chunk holds has no offset: ``incomplete`` tells.
    """
    c, last = F.col, lambda name: F.last(name, ignorenulls=True)
    of = Window.partitionBy("path", "kind").orderBy("at")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    usual = int(moov.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = moov.repartition("path") if expected is None else moov.repartition(max(usual, -(-expected // SAMPLES)), "path")
    # what each run begins with: the first sample of timing runs, and the ticks before it
    d = d.withColumn("start", F.when(c("kind").isin("stts", "ctts"), F.coalesce(F.sum("n").over(before), F.lit(0))))
    d = d.withColumn("tick", F.when(c("kind") == "stts", F.coalesce(F.sum(c("n") * c("value")).over(before), F.lit(0))))
    # chunks take the number of samples of the chunk map's run they are in
    order = Window.partitionBy("path", c("kind").isin("chunk", "stsc")).orderBy("at", F.desc("kind"))
    d = d.withColumn("held", F.when(c("kind") == "chunk", last(F.when(c("kind") == "stsc", c("value"))).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    d = d.withColumn("start", F.when(c("kind") == "chunk", F.coalesce(F.sum("held").over(before), F.lit(0))).otherwise(c("start")))
    # a chunk or run without samples begins where the next does, which then counts
    d = d.where((c("kind") != "stsc") & ~((c("kind") == "chunk") & (c("held") <= 0)) & ~(c("kind").isin("stts", "ctts") & (c("n") <= 0)))
    d = d.withColumn("sample", F.coalesce("start", "at")).withColumn("is_size", c("kind") == "size")
    upto = Window.partitionBy("path").orderBy("sample", "is_size").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda kind, *fields: last(F.when(c("kind") == kind, F.struct("sample", *fields))).over(upto)
    d = d.select("path", "sample", "is_size", "value", run("chunk", "at", "value", "held").alias("ch"), run("stts", "n", "value", "tick").alias("st"), run("ctts", "n", "value").alias("ct"), run("stss").alias("ss"),
                 F.max(c("kind") == "stss").over(Window.partitionBy("path")).alias("has_keys"))
    d = d.where("is_size").drop("is_size")
    inside = lambda s, n: c("sample") < c(f"{s}.sample") + c(f"{s}.{n}")
    in_chunk = Window.partitionBy("path", "ch.at").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("offset", F.when(inside("ch", "held"), c("ch.value") + F.coalesce(F.sum("value").over(in_chunk), F.lit(0))))
    d = d.withColumn("tick", F.when(inside("st", "n"), c("st.tick") + (c("sample") - c("st.sample")) * c("st.value")))
    d = d.withColumn("composition_tick", c("tick") + F.coalesce(F.when(inside("ct", "n"), c("ct.value")), F.lit(0)))
    shown = F.row_number().over(Window.partitionBy("path").orderBy("composition_tick", "sample")) - 1
    return d.select(
        "path", "sample", F.when(inside("ch", "held"), c("ch.at")).alias("chunk"), "offset", c("value").alias("size"), "tick", F.when(inside("st", "n"), c("st.value")).alias("delta"), "composition_tick",
        shown.cast("long").alias("composition_index"), (~c("has_keys") | F.coalesce(c("ss.sample") == c("sample"), F.lit(False))).alias("is_key"),
    )


def incomplete(found: DataFrame) -> DataFrame:
    """(path, error) of files with samples that no chunk or no timing run covers."""
    d = found.groupBy("path").agg(F.count_if(F.col("offset").isNull()).alias("lost"), F.count_if(F.col("tick").isNull()).alias("untimed"))
    return d.where("lost + untimed > 0").select("path", F.concat_ws(", ", F.when(F.col("lost") > 0, F.concat("lost", F.lit(" samples in no chunk"))), F.when(F.col("untimed") > 0, F.concat("untimed", F.lit(" samples without time")))).alias("error"))


def sample_data(found: DataFrame) -> DataFrame:
    """``found`` with the samples' bytes as ``data``, fetched by ranges: rows of a file
    that follow each other share its open file. Null where a file ends too early."""
    names = found.columns
    at = [names.index(n) for n in ("path", "offset", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, read, close = None, None, None
        try:
            for batch in batches:
                got = []
                for path, offset, size in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
                    if path != now:
                        if close:
                            close()
                        (read, close), now = reader(path), path
                    data = read(offset, size) if offset is not None else None
                    got.append(data if data is not None and len(data) == size else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*names, "data"])
        finally:
            if close:
                close()

    from pyspark.sql.types import BinaryType, StructField, StructType

    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("data", BinaryType())]))
