"""A shared folder through Hadoop's file system interface: listing, claims and renames.

The only things the stores need to be safe with several writers: a file that exactly one
of them can create, and a folder that becomes visible in one step.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches

#: Files that ``write_files`` puts into one folder.
FOLDER_FILES = 4096
#: Files that the driver lists at a time, as far as the folders are that small.
LISTED_FILES = 1 << 15


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """The names below ``name``, without what is hidden (``_`` and ``.`` first); [] if there is none."""
        if not self.exists(name):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._at(name))]
        return [n for n in found if n[0] not in "_."]

    def complete(self, name: str = "") -> bool:
        """Whether the table ``name`` was written to its end (the job's ``_SUCCESS`` marker is there)."""
        return self.exists(f"{name}/_SUCCESS" if name else "_SUCCESS")

    def create(self, name: str) -> bool:
        """Create an empty file unless it exists; of several callers exactly one gets True."""
        target = self._at(name)
        self._fs.mkdirs(target.getParent())
        uri = self._fs.makeQualified(target).toUri()
        if uri.getScheme() == "file":
            return self._jvm.java.io.File(uri.getPath()).createNewFile()
        try:
            self._fs.create(target, False).close()
            return True
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise

    def write(self, name: str, text: str) -> None:
        """Put a small text; a reader sees the old or the new one, or for a moment none."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self._fs.create(self._at(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name):
            self._fs.delete(self._at(name), False)
        self._fs.rename(self._at(part), self._at(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, staged: str, name: str) -> bool:
        """Rename the folder ``staged`` to ``name`` unless that exists (then ``staged`` goes)."""
        if not self.exists(name) and self._fs.rename(self._at(staged), self._at(name)):
            return True
        if not self.exists(name):
            raise OSError(f"cannot rename {self.path}/{staged} to {name}")
        self.delete(staged)
        return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _escaped(path: str) -> str:
    """``path`` as a pattern that only it fits."""
    return "".join(f"\\{c}" if c in "\\{}[]*?," else c for c in path)


def _hidden(name: str) -> bool:
    """What Spark's own listing leaves out."""
    return name[0] == "." or (name[0] == "_" and "=" not in name) or name.endswith("._COPYING_")


def folder_groups(spark: SparkSession, source: str, extension: str) -> list[list[str]]:
    """The files below the folder ``source`` in groups of paths to load, about ``LISTED_FILES`` files each.

    A path is a folder, with all below it, or a file with the ``extension`` that lies beside folders. The driver
    counts a folder's files without holding them. A folder without folders in it is never split. ``[[source]]``
    where there is no need to split, or where ``source`` is a pattern or no folder.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def split(at) -> bool:
        size = fs.getContentSummary(at)
        return size.getFileCount() > LISTED_FILES and size.getDirectoryCount() > 1

    if any(c in source for c in "{}[]*?\\") or not fs.exists(path(source)) or not split(path(source)):
        return [[source]]
    found, todo = [], [path(source)]
    while todo:
        for status in fs.listStatus(todo.pop()):
            at = status.getPath()
            if _hidden(at.getName()):
                continue
            if not status.isDirectory():
                if at.getName().endswith(extension):
                    found.append((1, _escaped(at.toString())))
                continue
            size = fs.getContentSummary(at)
            if size.getFileCount() > LISTED_FILES and size.getDirectoryCount() > 1:
                todo.append(at)
            elif size.getFileCount():
                found.append((size.getFileCount(), _escaped(at.toString())))
    groups, held = [], 0
    for files, at in found:
        if not groups or held + files > LISTED_FILES:
            groups.append([])
            held = 0
        groups[-1].append(at)
        held += files
    return groups or [[source]]


def write_files(rows: DataFrame, folder: str, key: str, content: str, extension: str) -> None:
    """Every row's string ``content`` and a line end as a file of its own below ``folder``, ``key=<value>`` in its path.

    On a file system that is mounted (``file:``) the tasks write the files themselves: Spark's writer starts
    processes to set the permissions of each file there. A file appears by a rename under a name
    that a second attempt of its task uses again. Elsewhere Spark writes them; for that, the content must
    hold no quotes, line ends and ``\\x01``.
    """
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() != "file":
        rows.select(key, content).write.partitionBy(key).option("extension", extension).option("sep", "\x01").csv(folder)
        return
    root, per_folder = uri.getPath(), FOLDER_FILES

    def fn(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value, data in zip(*(batch.column(c).to_pylist() for c in ("key", "content"))):
                place = f"{root}/{task}-{n // per_folder}"
                if n % per_folder == 0:
                    os.makedirs(place, exist_ok=True)
                part = f"{place}/.{n}.{os.getpid()}.part"
                with open(part, "wb") as out:
                    out.write((data or b"") + b"\n")
                os.replace(part, f"{place}/{key}={value}-{n}.{extension}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    written = small_batches(rows.select(F.col(key).cast("string").alias("key"), F.encode(content, "UTF-8").alias("content")))
    written.mapInArrow(fn, "n long").agg(F.sum("n")).first()
