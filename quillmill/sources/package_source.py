"""Packages as a data source: spark.read.format("packages").option("path", ...).load().

Files are planned as partitions by their sizes. A task reads a package's end record and its
directory by ranges, then only the members that a filter on `name` or `part` leaves, each
a batch of its own. Columns are those of packages.members.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from . import archive

#: Bytes of the files of a partition.
PARTITION_BYTES = 128 << 20
WILD = "*?["


@dataclass
class Files(InputPartition):
    paths: list[str]


class Ranges:
    """A file that is read by ranges, and how many bytes that took."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        self.file, self.taken = system.open_input_file(name), 0
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        data = self.file.read_at(min(n, max(0, self.size - at)), at)
        self.taken += len(data)
        return data


def found(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a path or pattern names; ValueError if a pattern names
    none; size -1 for a path that is none."""
    prefix = "" if "://" in pattern or pattern.startswith("file:") else "file://"
    system, name = fs.FileSystem.from_uri(prefix + pattern) if not any(c in pattern for c in WILD) else (None, None)
    if system is not None:
        info = system.get_file_info(name)
        if info.type != fs.FileType.Directory:
            return [(pattern, info.size if info.type == fs.FileType.File else -1)]
        return [(_uri(pattern, name, i.path), i.size) for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File]
    head = pattern[: min(pattern.index(c) for c in WILD if c in pattern)]
    head = head[: head.rindex("/") + 1]
    system, name = fs.FileSystem.from_uri(prefix + head)
    wanted = posixpath.join(name, pattern[len(head) :])
    rows = system.get_file_info(fs.FileSelector(name, recursive="/" in pattern[len(head) :] or "**" in pattern, allow_not_found=True))
    # a star stays within a folder
    good = [i for i in rows if i.type == fs.FileType.File and i.path.count("/") == wanted.count("/") and fnmatch.fnmatchcase(i.path, wanted)]
    if not good:
        raise ValueError(f"no file matches {pattern}")
    return [(_uri(head, name, i.path), i.size) for i in good]


def _uri(asked: str, name: str, path: str) -> str:
    return asked.rstrip("/") + path[len(name.rstrip("/")) :]


def rows(doc: str, read: archive.Read, size: int, limits: archive.Limits, wanted: Callable[[archive.Entry], bool] | None, inflate: bool) -> Iterator[tuple]:
    """Rows of a package (doc, ord, name, part, size, packed, crc, is_dir, data, code, message):
    the wanted members, or one with what is wrong with the package."""
    try:
        entries = list(archive.directory(read, size, limits))
    except archive.Refused as e:
        yield (doc, -1, e.name, None, None, None, None, None, None, e.code, e.message)
        return
    for n, e in enumerate(entries):
        if wanted is not None and not wanted(e):
            continue
        data = code = message = None
        if inflate and not e.is_dir:
            try:
                data = archive.member(read, e)
            except archive.Refused as bad:
                code, message = bad.code if bad.code != "PKG002" or bad.name else "PKG001", bad.message
        yield (doc, n, e.name, e.part, e.size, e.packed, e.crc, e.is_dir, data, code, message)


def test_of(filters: list[Filter]) -> Callable[[archive.Entry], bool] | None:
    """Whether an entry passes the filters on name and part."""
    if not filters:
        return None

    def one(f: Filter, e: archive.Entry) -> bool:
        value = getattr(e, f.attribute[0])
        if isinstance(f, In):
            return value in f.value
        if isinstance(f, StringStartsWith):
            return value.startswith(f.value)
        return value.endswith(f.value) if isinstance(f, StringEndsWith) else value == f.value

    return lambda e: all(one(f, e) for f in filters)


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: pa.Schema):
        self.options, self.schema, self.filters = options, schema, []
        known = {f.name: f.type for f in fields(archive.Limits)}
        given = {k: v for k, v in options.items() if k in known}
        self.limits = archive.Limits(**{k: float(v) if k == "ratio" else int(v) for k, v in given.items()})

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        # a package that can't be read has a row without name or part, which no such filter keeps
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("name",), ("part",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = sorted({x for p in self.options["path"].split(",") for x in found(p.strip())}, key=lambda x: -x[1])
        many = max(1, -(-sum(max(0, n) for _, n in files) // PARTITION_BYTES))
        groups: list[list] = [[0, []] for _ in range(many)]
        for path, n in files:  # the largest first, each to the emptiest
            group = min(groups, key=lambda g: g[0])
            group[0] += max(n, 1 << 16)
            group[1].append(path)
        return [Files(g[1]) for g in groups if g[1]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted, inflate = test_of(self.filters), self.options.get("inflate", "true") != "false"
        for path in partition.paths:
            try:
                read = Ranges(path)
            except (OSError, ValueError):
                missing: tuple = (path, -1, None, None, None, None, None, None, None, "PKG000", "file is missing")
                yield self.batch([missing] if wanted is None else [])
                continue
            for row in rows(path, read, read.size, self.limits, wanted, inflate):
                if row[1] >= 0 or wanted is None:
                    yield self.batch([row])

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(self.schema.names, r)) for r in rows], self.schema)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        from .packages import MEMBERS

        return MEMBERS

    def reader(self, schema) -> PackageReader:  # noqa: ANN001
        from .packages import MEMBER_SCHEMA

        return PackageReader(dict(self.options), MEMBER_SCHEMA)
