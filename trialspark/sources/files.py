"""Files of any file system that pyarrow opens, read by ranges: for formats whose
readers Spark has not. Paths are those of Spark: plain, or with a scheme."""

from __future__ import annotations

import fnmatch
import posixpath
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before a path of it)."""
    scheme, mark, rest = path.partition(":/")
    if not mark or len(scheme) < 2:
        return fs.LocalFileSystem(), path, ""
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at ``path``: a file, a folder's files, or those that a
    pattern of the last part names. Names that begin with . or _ are left out."""
    system, inner, front = opened(path)
    folder, name = posixpath.split(inner.rstrip("/"))
    if set(name) & set("*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder or ".")) if fnmatch.fnmatch(f.base_name, name)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner))
    return sorted((front + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def reader(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """(read(offset, n), close) of a file: only what is asked for is fetched."""
    system, inner, _ = opened(path)
    f = system.open_input_file(inner)
    return lambda offset, n: f.read_at(n, offset), f.close


def put(path: str, content: bytes) -> None:
    """A whole file at once: a task that runs twice leaves one."""
    system, inner, _ = opened(path)
    system.create_dir(posixpath.dirname(inner), recursive=True)
    part = f"{posixpath.dirname(inner)}/.{posixpath.basename(inner)}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, inner)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or in the
    context's checkpoint folder. Only a local session without both gets one in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/trialspark-checkpoints"
    return f"{base.rstrip('/')}/trialspark-{name}-{uuid.uuid4().hex}"
