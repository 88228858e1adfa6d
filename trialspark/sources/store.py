"""Stored tables with keys: upserts, partial updates and deletes, committed together.

A store is a folder. Writing adds folders of Parquet files; what is valid is said by the
manifest of the last version, a small file that lists each table's folders. A manifest is
made under another name and renamed to its version's, which fails if that exists: so a
write that breaks off leaves the version before it, readers see whole versions, and of
two writers on one version the second is told (``Conflict``) and loses nothing.

Rows carry the version that wrote them; a key's last row counts, a deletion is a row too.
Many small versions are read as one union; ``compact`` rewrites a table to its valid rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION, GONE = "_version", "_gone"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class Change:
    """What a commit does to a table: rows to put, keys to delete, or all rows anew."""

    put: DataFrame | None = None
    gone: DataFrame | None = None
    whole: DataFrame | None = None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """``keys``: the key columns of each table."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("versions"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The last version, or a given one."""
        if version is None:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
            version = max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), default=0)
        if version == 0:
            return Manifest()
        stream = self._fs.open(self._path(f"versions/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(version, json.loads(text))

    def _publish(self, manifest: Manifest) -> None:
        part, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{manifest.version:012d}.json")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(manifest.folders).encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(part, final, options)
        except Exception as e:
            self._fs.delete(part, False)
            if self._fs.exists(final):
                raise Conflict(f"version {manifest.version} exists") from e
            raise

    def commit(self, changes: dict[str, Change], base: Manifest | None = None) -> Manifest:
        """All changes or none, as the version after ``base`` (the last by default)."""
        base = base or self.manifest()
        version, folders = base.version + 1, dict(base.folders)
        for name, change in changes.items():
            added = []
            for rows, gone in ((change.whole, False), (change.put, False), (change.gone, True)):
                if rows is not None:
                    keys = self.keys[name]
                    rows = rows.select(*keys) if gone else rows
                    folder = f"{name}/{version:012d}-{uuid.uuid4().hex}"
                    rows.withColumns({VERSION: F.lit(version).cast("long"), GONE: F.lit(gone)}).write.parquet(f"{self.path}/{folder}")
                    added.append(folder)
            folders[name] = added if change.whole is not None else [*folders.get(name, []), *added]
        manifest = Manifest(version, folders)
        self._publish(manifest)
        return manifest

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """Valid rows of a table, or None if it was never written."""
        folders = self.manifest(version).folders.get(name)
        if not folders:
            return None
        # columns that were added later are null in older rows
        d = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{f}" for f in folders])
        if len(folders) > 1:
            last = Window.partitionBy(*self.keys[name]).orderBy(F.desc(VERSION), GONE)  # put beats delete in one commit
            d = d.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
        return d.where(~F.col(GONE)).drop(VERSION, GONE)

    def put(self, name: str, rows: DataFrame) -> Manifest:
        return self.commit({name: Change(put=rows)})

    def update(self, name: str, patch: DataFrame) -> Manifest:
        """Columns of ``patch`` replace those of rows with its keys; other columns stay,
        and a key without a row has nothing to update. The read row and the write are one
        version: a writer in between makes it a conflict."""
        base, keys = self.manifest(), self.keys[name]
        now = self.read(name, base.version)
        if now is None:
            return base
        given = [c for c in patch.columns if c not in keys]
        new = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given]).dropDuplicates(keys)
        d = now.join(new, keys)
        return self.commit({name: Change(put=d.select(*[F.col(f"_new_{c}").alias(c) if c in given else F.col(c) for c in now.columns]))}, base)

    def delete(self, gone: DataFrame, *names: str) -> Manifest:
        """Rows whose keys ``gone`` holds leave all tables at once (those given, or all
        that have the columns of ``gone`` among their keys)."""
        base = self.manifest()
        by = gone.columns
        wanted = names or [n for n, k in self.keys.items() if set(by) <= set(k)]
        changes = {}
        for n in wanted:
            now = self.read(n, base.version)
            if now is not None:
                changes[n] = Change(gone=now.select(*self.keys[n]).join(gone.distinct(), by, "left_semi"))
        return self.commit(changes, base) if changes else base

    def compact(self, name: str, partitions: int = 64) -> Manifest:
        """The table as one folder of its valid rows, ordered by key, for pruned reads."""
        base = self.manifest()
        now = self.read(name, base.version)
        if now is None:
            return base
        keys = self.keys[name]
        return self.commit({name: Change(whole=now.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys))}, base)

    def clean(self, keep: int = 1) -> int:
        """Folders that none of the last ``keep`` versions lists are deleted. No writer
        may be under way."""
        last = self.manifest().version
        known = {f for v in range(max(1, last - keep + 1), last + 1) for fs in self.manifest(v).folders.values() for f in fs}
        lost = [f"{n}/{s.getPath().getName()}" for n in self.keys if self._fs.exists(self._path(n)) for s in self._fs.listStatus(self._path(n))]
        gone = [f for f in lost if f not in known]
        for f in gone:
            self._fs.delete(self._path(f), True)
        return len(gone)
