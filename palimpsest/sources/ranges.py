"""Packages read by ranges: a data source that fetches the directory of a package and the parts that rules read, not its media.

``spark.read.format("office_packages").load(folder)`` after ``register(spark)`` gives the entry rows of ``operators.evidence`` with the
path and the number of bytes that were fetched. Folders and files are named as a URI that Arrow's file systems know (or a plain path).
Options: ``recursive`` (false), ``per_task`` (bytes of packages, by their size, that one task takes: 256 MB). What cannot be opened is a
row with idx -1 and the error, as in a scan. There is no SHA-256 and no media metadata: these would need the bytes that are left out.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import archives

SCHEMA = ("path string, size bigint, idx int, name string, packed bigint, unpacked bigint, method int, crc bigint, flags int, directory boolean, zip64 boolean, "
          "part boolean, whole boolean, text string, error string, zip_error boolean, fetched bigint")
ENDINGS = (".pptx", ".pptm", ".ppsx", ".ppsm", ".potx", ".potm")
#: Bytes of one fetch, and fetches that are kept.
BLOCK, KEPT = 64 << 10, 32


class Ranged:
    """A file as ``archives`` sees bytes: slices and a search backwards, each fetched in blocks where it is asked for."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.fetched = file, size, 0
        self.blocks: OrderedDict[int, bytes] = OrderedDict()

    def __len__(self) -> int:
        return self.size

    def fetch(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        self.fetched += len(out)
        return out

    def block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.blocks[k] = self.fetch(k * BLOCK, min(BLOCK, self.size - k * BLOCK))
            if len(self.blocks) > KEPT:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def __getitem__(self, where: slice) -> bytes:
        begin, end, _ = where.indices(self.size)
        if end <= begin:
            return b""
        if end - begin > 4 * BLOCK:
            return self.fetch(begin, end - begin)
        first, last = begin // BLOCK, (end - 1) // BLOCK
        return b"".join(self.block(k) for k in range(first, last + 1))[begin - first * BLOCK: end - first * BLOCK]

    def rfind(self, what: bytes, begin: int, end: int) -> int:
        found = self[begin:end].rfind(what)
        return begin + found if found >= 0 else -1


def entry_rows(path: str, data: Ranged, wanted: tuple[str, ...], need: tuple[str, ...]) -> Iterator[tuple]:
    """A row for each entry, with the text of its XML."""
    try:
        package = archives.open_package(data)
    except Exception as e:  # noqa: BLE001  a package that cannot be opened is a row, whatever the reason
        yield (path, data.size, -1, None, 0, 0, 0, 0, 0, False, False, False, False, None, str(e) or type(e).__name__, True, data.fetched)
        return
    last = {e.name: i for i, e in enumerate(package.entries)}
    whole = all(n in last for n in need)
    for i, e in enumerate(package.entries):
        text = error = None
        zip_error = False
        try:
            if last[e.name] == i and e.name.lower().endswith(wanted) and e.unpacked <= archives.XML_BYTES:
                text = package.read(e).decode("utf-8-sig", "replace")
        except Exception as x:  # noqa: BLE001  so is an entry that cannot be read
            error, zip_error = str(x), isinstance(x, archives.PackageError)
        name = e.name.encode("utf-8", "replace").decode()
        yield (path, data.size, i, name, e.packed, e.unpacked, e.method, e.crc, e.flags, e.directory, package.zip64, last[e.name] == i, whole, text, error, zip_error, data.fetched)


class Packages(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class PackageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.at = options.get("path", "")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.per_task = int(options.get("per_task", 256 << 20))

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.at if "://" in self.at or self.at.startswith("file:") else "file://" + self.at)

    def partitions(self) -> list[InputPartition]:
        """Files by path, as many to a task as fill it; only their names and sizes are looked at here."""
        from pyarrow import fs

        system, root = self.system()
        about = system.get_file_info(root)
        files = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        some = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(ENDINGS))
        out: list[list[tuple[str, int]]] = [[]]
        weight = 0
        for f in some:
            if out[-1] and weight + f[1] > self.per_task:
                out.append([])
                weight = 0
            out[-1].append(f)
            weight += f[1]
        return [Packages(files) for files in out if files] or [Packages([])]

    def read(self, partition: Packages) -> Iterator[tuple]:
        from ..operators.evidence import NEED, WANTED

        system, _ = self.system()
        for path, size in partition.files:
            with system.open_input_file(path) as file:
                yield from entry_rows(path, Ranged(file, size), WANTED, NEED)


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office_packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackageReader:
        return PackageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from .. import on_workers

    on_workers(spark)
    spark.dataSource.register(PackageSource)
