"""The first bytes of many files: a data source that lists and opens them in its tasks."""

from __future__ import annotations

import fnmatch
import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, head binary"


def _tree(path: str) -> tuple[object, str, str]:
    """(file system, folder to list, pattern of the files below it) of a path that may have wildcards."""
    from pyarrow import fs

    local = urlsplit(path).scheme in ("", "file")
    path = os.path.abspath(re.sub("^file:/+", "/", path)) if local else path
    fixed = re.split(r"[*?\[]", path, maxsplit=1)[0]
    base = path if fixed == path else fixed.rpartition("/")[0]
    system, root = (fs.LocalFileSystem(), base) if local else fs.FileSystem.from_uri(base)
    rest = path[len(base) :].strip("/")
    return system, root, f"{root.rstrip('/')}/{rest}" if rest else root


def readable(path: str) -> bool:
    """Whether tasks can open the path without Spark's own readers."""
    return "{" not in path and (urlsplit(path).scheme in ("", "file", "hdfs", "s3", "gs"))


class _Heads(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.tasks = options["path"], int(options["size"]), int(options["tasks"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system, root, wanted = _tree(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for f in files:
            hidden = any(x[:1] in "._" for x in f.path[len(root) :].split("/") if x)
            chosen = f.path == wanted or f.path.startswith(f"{wanted.rstrip('/')}/") or fnmatch.fnmatch(f.path, wanted) or fnmatch.fnmatch(f.path, f"{wanted}/*")
            if f.type == fs.FileType.File and chosen and not hidden and zlib.crc32(f.path.encode()) % self.tasks == partition.value:
                with system.open_input_stream(f.path, compression=None) as x:
                    yield f.path, x.read(self.size)


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "promptloom_file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Heads(self.options)


def file_heads(spark: SparkSession, path: str, size: int, tasks: int | None = None) -> DataFrame:
    """file, head: the first `size` bytes of every file of path (a file, a folder with all below it, or a pattern), empty files
    included. Each of `tasks` tasks lists the folder, and opens its share of the files; the driver sees no name. Names that begin
    with _ or . are left out, as Spark's readers do."""
    spark.dataSource.register(FileHeads)
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.format(FileHeads.name()).option("size", size).option("tasks", tasks).load(path)
