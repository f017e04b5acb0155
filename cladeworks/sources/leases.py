"""Tables that are made once, however many jobs ask for them at the same time.

Whoever creates the lease file first (stores do this for one of them only) makes the table, in a folder beside its place, and moves it there by one
rename, so a table is there whole or not at all. The others wait for it. A lease that is older than its time was left by a job that died; the next one takes it over.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Store:
    """The store of a path, by its own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.files.exists(self._path(path))

    def created(self, path: str, text: str) -> bool:
        """Create a file that isn't there; whether this call did it."""
        if self.files.getUri().getScheme() == "file":  # Hadoop looks first and creates then, which lets two in
            try:
                with open(self._path(path).toUri().getPath(), "x") as own:
                    own.write(text)
            except FileExistsError:
                return False
            return True
        try:
            stream = self.files.create(self._path(path), False)
        except Exception as error:  # stores differ in what they raise
            if self.exists(path):
                return False
            raise error
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def written(self, path: str, text: str) -> None:
        """Write a file, over one that is there."""
        stream = self.files.create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def age(self, path: str) -> float | None:
        """Seconds since a file was written; None if it is gone."""
        try:
            return time.time() - self.files.getFileStatus(self._path(path)).getModificationTime() / 1000
        except Exception:
            if self.exists(path):
                raise
            return None

    def moved(self, old: str, new: str) -> bool:
        return self.files.rename(self._path(old), self._path(new))

    def deleted(self, path: str) -> None:
        self.files.delete(self._path(path), True)


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], lease_seconds: float = 3600, wait_seconds: float = 7200, poll: float = 0.5) -> DataFrame:
    """The table at path; made by make() where it is not there. lease_seconds must be longer than making it takes."""
    store, lease, own = Store(spark, path), f"{path}.lease", uuid.uuid4().hex
    until = time.time() + wait_seconds
    while not store.exists(path):
        if store.created(lease, own):
            try:
                if not store.exists(path):  # it may have come between the two looks
                    beside = f"{path}.{own}"
                    make().write.parquet(beside)
                    if store.exists(path) or not store.moved(beside, path):
                        store.deleted(beside)
                        if not store.exists(path):
                            raise OSError(f"{beside} can't be renamed to {path}")
            finally:
                store.deleted(lease)
            break
        age = store.age(lease)
        if age is not None and age > lease_seconds:
            store.deleted(lease)  # its job is gone
        if time.time() > until:
            raise TimeoutError(f"{path} didn't appear")
        time.sleep(poll)
    return spark.read.parquet(path)
