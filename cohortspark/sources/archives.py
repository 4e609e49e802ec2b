"""Members of ZIP archives and row ranges of .npz files as partitions, by range reads.

An archive's directory is at its end, so one small task for each archive lists
what is in it without reading the rest; after that every member, or every range
of rows of an array's member, is a row of its own that any task can work on.
Files may be larger than a Spark binary cell.  Python has to reach them, by path
or by a pyarrow file system.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, member string, size long"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (Spark writes local ones as file:/...), and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of what the path, folder or pattern names; no content is read."""
    return spark.read.format("binaryFile").load(path).select("path")


def members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, member, size): the members of each archive, in their order by name, dealt out one by one."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                fs, inner = place(p)
                with fs.open_input_file(inner) as file, zipfile.ZipFile(file) as archive:
                    found = sorted((i.filename, i.file_size) for i in archive.infolist() if i.filename.lower().endswith(suffix) and not i.is_dir())
                yield pd.DataFrame({"path": [p] * len(found), "member": [n for n, _ in found], "size": [s for _, s in found]})

    found = _files(spark, path).mapInPandas(listed, MEMBERS)
    n = found.count()
    return found.repartition(max(1, min(n, 10_000)), "path", "member")


def csv_rows(spark: SparkSession, path: str, chunk: int = 50_000) -> DataFrame:
    """(fields map<string, string>) of the rows of all CSV members (with headers), a member a task."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, name in zip(frame["path"], frame["member"]):
                fs, inner = place(p)
                with fs.open_input_file(inner) as file, zipfile.ZipFile(file) as archive, archive.open(name) as member:
                    for part in pd.read_csv(io.TextIOWrapper(member, "utf-8", newline=""), dtype=str, keep_default_na=False, chunksize=chunk):
                        yield pd.DataFrame({"fields": part.to_dict("records")})

    return members(spark, path, ".csv").mapInPandas(lines, "fields map<string, string>")


class Arrays:
    """The arrays of an .npz file, by ranges of rows: only those are read of a member that is stored as it is, in order of rows."""

    def __init__(self, path: str):
        fs, inner = place(path)
        self.file = fs.open_input_file(inner)
        self.archive = zipfile.ZipFile(self.file)

    def __enter__(self) -> Arrays:
        return self

    def __exit__(self, *_) -> None:
        self.archive.close()
        self.file.close()

    def _head(self, name: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
        """Shape, whether columns come first, kind, and bytes of the head."""
        with self.archive.open(f"{name}.npy") as member:
            version = np.lib.format.read_magic(member)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            return *read(member), member.tell()

    def shape(self, name: str) -> tuple[int, ...]:
        return self._head(name)[0]

    def rows(self, name: str, lo: int, hi: int) -> np.ndarray:
        info = self.archive.getinfo(f"{name}.npy")
        shape, by_column, kind, head = self._head(name)
        if info.compress_type != zipfile.ZIP_STORED or by_column:
            with self.archive.open(info.filename) as member:
                return np.lib.format.read_array(io.BytesIO(member.read()))[lo:hi]
        self.file.seek(info.header_offset)
        local = self.file.read(30)
        begin = info.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little") + head
        row = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
        self.file.seek(begin + lo * row)
        return np.frombuffer(self.file.read((hi - lo) * row), kind).reshape(hi - lo, *shape[1:])


def row_ranges(spark: SparkSession, path: str, array: str, rows: int) -> DataFrame:
    """(path, lo, hi): ranges of at most ``rows`` rows of the named array of each .npz file, dealt out one by one."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                with Arrays(p) as file:
                    n = file.shape(array)[0]
                lo = np.arange(0, n, rows)
                yield pd.DataFrame({"path": [p] * len(lo), "lo": lo, "hi": np.minimum(lo + rows, n)})

    found = _files(spark, path).mapInPandas(listed, "path string, lo long, hi long")
    return found.repartition(max(1, min(found.count(), 10_000)), F.col("path"), F.col("lo"))
