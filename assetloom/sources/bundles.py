"""Members of tar archives as a data source whose tasks read byte ranges, never a whole archive.

``spark.read.format("tar_members").option("suffix", ".json").load("folder-or-file")`` gives (archive, name, value, error).

A plain tar is parted at headers: planning walks from header to header, reading 512 bytes of each, and keeps only where a
range of about ``range_bytes`` begins and ends. A compressed tar is one stream, unpacked as it is read. A task holds one
member at a time. An archive that breaks off or isn't one gives what could be read and a row that says why (``name`` null).
Paths may be of any file system that Arrow opens by its address; one without a scheme lies on a disk that all executors share.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 512
RANGE = 128 << 20
SCHEMA = "archive string, name string, value binary, error string"
#: Endings of compressed archives, and the two types of headers that hold the next member's long name or attributes.
COMPRESSED = (".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
ENDINGS = (".tar", *COMPRESSED)
_PREFIXES = (tarfile.GNUTYPE_LONGNAME, tarfile.GNUTYPE_LONGLINK, tarfile.XHDTYPE, tarfile.XGLTYPE)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: a compressed archive, read as one stream
    broken: str | None = None  # why the archive goes no further


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archives under a folder, or the one file."""
    system, inner = _opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(head + f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(ENDINGS))


def ranges(path: str, size: int = RANGE) -> list[Range]:
    """Where tasks begin and end: at headers, about ``size`` bytes apart."""
    if path.endswith(COMPRESSED):
        return [Range(path, 0, None)]
    system, inner = _opened(path)
    found, begin, at = [], 0, 0
    with system.open_input_file(inner) as file:
        whole = file.size()
        prefixed, broken = None, "no end of archive"  # where the headers that belong to the next member began
        while at + BLOCK <= whole:
            file.seek(at)
            try:
                header = tarfile.TarInfo.frombuf(file.read(BLOCK), "utf-8", "surrogateescape")
            except tarfile.EOFHeaderError:
                broken = None
                break
            except tarfile.HeaderError as wrong:
                broken = str(wrong)
                break
            first = at if prefixed is None else prefixed
            if first - begin >= size:
                found.append(Range(path, begin, first))
                begin = first
            prefixed = first if header.type in _PREFIXES else None
            at += BLOCK + -(-header.size // BLOCK) * BLOCK
        found.append(Range(path, begin, whole, broken))
    return found


class _Part:
    """A stretch of a file as a file of its own."""

    def __init__(self, file, start: int, end: int):
        self.file, self.left = file, end - start
        file.seek(start)

    def read(self, size: int = -1) -> bytes:
        wanted = self.left if size < 0 else min(size, self.left)
        content = self.file.read(wanted)
        self.left -= len(content)
        return content


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.size, self.longest = int(options.get("range_bytes", RANGE)), int(options.get("longest_member", 1 << 30))

    def partitions(self) -> list[Range]:
        return [r for path in archives(self.path) for r in ranges(path, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, inner = _opened(partition.path)
        try:
            with system.open_input_file(inner) as file:
                if partition.end is None:
                    stream, mode = _Part(file, 0, file.size()), "r|*"
                else:
                    stream, mode = _Part(file, partition.start, partition.end), "r|"
                    if not partition.end:
                        raise tarfile.ReadError("empty file")
                with tarfile.open(fileobj=stream, mode=mode) as archive:
                    for member in archive:
                        archive.members = []  # a stream needs no list of what it has passed
                        name = member.name.rsplit("/", 1)[-1]
                        if not member.isfile() or not name.endswith(self.suffix) or name.startswith("._"):
                            continue
                        if member.size > self.longest:
                            yield partition.path, member.name, None, f"longer than {self.longest} bytes"
                            continue
                        content = archive.extractfile(member).read()
                        if len(content) < member.size:
                            raise tarfile.ReadError("unexpected end of data")
                        yield partition.path, member.name, content, None
                if partition.broken:
                    raise tarfile.ReadError(partition.broken)
        except (tarfile.TarError, OSError, EOFError, ValueError) as broken:
            yield partition.path, None, None, f"{type(broken).__name__}: {broken}"


class TarMembers(DataSource):
    """Options: ``suffix`` of the members' names, ``range_bytes`` of a task, ``longest_member`` that is read."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarMembers)
