"""Small files beside the data: local paths directly, anything with a scheme through the Hadoop file system of the session.

Files are written whole: to a name of their own first, then renamed.
"""

from __future__ import annotations

import fcntl
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def join(*parts: object) -> str:
    """Path of parts, keeping the scheme of the first."""
    return "/".join([str(parts[0]).rstrip("/"), *[str(p).strip("/") for p in parts[1:]]])


def _local(path: object) -> Path | None:
    text = str(path)
    if text.startswith("file:"):
        return Path("/" + text.removeprefix("file:").lstrip("/"))
    return None if "://" in text else Path(text)


def _hadoop(path: object):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a session")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, spark


def exists(path: object) -> bool:
    """Whether a file or folder is there."""
    if (here := _local(path)) is not None:
        return here.exists()
    files, at, _ = _hadoop(path)
    return files.exists(at)


def entries(path: object) -> list[str]:
    """Names in a folder, sorted; a missing folder has none."""
    if not exists(path):
        return []
    if (here := _local(path)) is not None:
        return sorted(p.name for p in here.iterdir())
    files, at, _ = _hadoop(path)
    return sorted(s.getPath().getName() for s in files.listStatus(at))


def read_text(path: object) -> str:
    """Contents of a UTF-8 file."""
    if (here := _local(path)) is not None:
        return here.read_text(encoding="utf-8")
    files, at, spark = _hadoop(path)
    stream = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: object, text: str) -> None:
    """Write a file whole: a new name, flushed to disk, then renamed over the old one."""
    if (here := _local(path)) is not None:
        here.parent.mkdir(parents=True, exist_ok=True)
        new = here.with_name(f".{here.name}.{uuid.uuid4().hex}")
        try:
            with open(new, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(new, here)
        finally:
            new.unlink(missing_ok=True)
        return
    files, at, spark = _hadoop(path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    stream = files.create(new, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if files.exists(at):
        files.delete(at, False)
    if not files.rename(new, at):
        raise OSError(f"cannot write {path}")


def remove(path: object, folder: bool = False) -> None:
    """Delete a file, or a folder with all it holds; what is missing stays missing."""
    import shutil

    if (here := _local(path)) is not None:
        if folder:
            shutil.rmtree(here, ignore_errors=True)
        else:
            here.unlink(missing_ok=True)
        return
    files, at, _ = _hadoop(path)
    files.delete(at, folder)


def read_json(path: object) -> object:
    """Contents of a JSON file."""
    return json.loads(read_text(path))


def write_json(path: object, value: object) -> None:
    """Write JSON whole."""
    write_text(path, json.dumps(value, sort_keys=True, indent=1, allow_nan=False))


@contextmanager
def locked(path: object) -> Iterator[None]:
    """Exclusive lock by a file; one held by someone else gives BlockingIOError at once.

    Local locks end with their process; on other file systems the file itself is the lock and is deleted at the end.
    """
    if (here := _local(path)) is not None:
        here.parent.mkdir(parents=True, exist_ok=True)
        with open(here, "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            yield
        return
    files, at, _ = _hadoop(path)
    if not files.createNewFile(at):
        raise BlockingIOError(f"{path} is locked")
    try:
        yield
    finally:
        files.delete(at, False)
