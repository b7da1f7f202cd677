"""Files that exactly one writer creates, and what is built on them: locks that expire, records, numbered pointers.

Everything rests on one step that the store decides: creating a file that must not exist yet. HDFS and object stores with
conditional writes do it in `FileSystem.create(path, overwrite=false)`; on a local disk the file is made by the system call
that does. Whoever loses sees that the file is there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Busy(Exception):
    """Another writer holds the claim."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False if there is one already. The text ends in a line end, which tells readers that it
    is complete."""
    where, fs = _at(spark, path)
    fs.mkdirs(where.getParent())
    if fs.getScheme() == "file":
        if not spark._jvm.java.io.File(where.toUri().getPath()).createNewFile():
            return False
        out = fs.create(where, True)
    else:
        try:
            out = fs.create(where, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
    out.write(bytearray(f"{text}\n".encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """What `create_new` wrote; None if there is no such file or it is not complete."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    status = fs.getFileStatus(where)
    if status.getLen() == 0:
        return None
    data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray
    stream = fs.open(where)
    try:
        text = bytes(data(stream)).decode()
    finally:
        stream.close()
    return text[:-1] if text.endswith("\n") else None


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written, by the clocks of its store and of this machine; None if it is gone."""
    where, fs = _at(spark, path)
    try:
        return time.time() - fs.getFileStatus(where).getModificationTime() / 1000
    except Py4JJavaError:
        return None


@contextmanager
def claimed(spark: SparkSession, path: str, wait: float = 30.0, expires: float = 3600.0) -> Iterator[str]:
    """Hold the claim file `path` while the block runs, then remove it. Waits for another holder up to `wait` seconds, then
    raises Busy. A claim older than `expires` seconds is stale: one of those who wait moves it aside, and it is open again.

    A holder that outlives its claim may still write; what has to be unique for good is therefore committed by `create_new`
    on a name of its own, as `lock_once` does.
    """
    mine, until = uuid.uuid4().hex, time.time() + wait
    while not create_new(spark, path, mine):
        old = age(spark, path)
        if old is not None and old > expires:
            where, fs = _at(spark, path)
            fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(f"{path}-stale-{mine}"))
        elif time.time() > until:
            raise Busy(f"{path} is held by another writer")
        else:
            time.sleep(min(0.2, max(0.01, wait / 20)))
    try:
        yield mine
    finally:
        if read_text(spark, path) == mine:
            where, fs = _at(spark, path)
            fs.delete(where, False)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    where, fs = _at(spark, folder)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def point_to(spark: SparkSession, folder: str, text: str) -> int:
    """Add the next numbered pointer; what was pointed to before stays as it is. Returns the number."""
    number = max(_numbers(spark, folder), default=0) + 1
    while not create_new(spark, f"{folder}/{number:010d}", text):
        number += 1
    return number


def pointed_to(spark: SparkSession, folder: str) -> str | None:
    """The text of the highest pointer that is complete: one whose writer failed half-way is passed over."""
    for number in reversed(_numbers(spark, folder)):
        text = read_text(spark, f"{folder}/{number:010d}")
        if text is not None:
            return text
    return None
