"""Assets in one container file, as a Python data source (`format("container")`), and its writer.

Layout: the magic line, the header's length (unsigned 32 bits, little endian), a JSON header with the group and the entries' path, offset,
length and media type, then the payload. Offsets let entries be read in partitions.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed value: the format's magic.
MAGIC = b"SCFIG1\n"
SCHEMA = "file string, path string, type string, content binary"


def read_header(path: str) -> tuple[dict, int]:
    """The header and where the payload begins; raises ValueError for what is no container."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: no container")
        raw = f.read(4)
        if len(raw) < 4:
            raise ValueError(f"{path}: header is cut off")
        size = struct.unpack("<I", raw)[0]
        try:
            header = json.loads(f.read(size))
        except ValueError as e:
            raise ValueError(f"{path}: bad header") from e
    if not header.get("entries"):
        raise ValueError(f"{path}: no entries")
    return header, len(MAGIC) + 4 + size


def write_container(path: str, group: str, entries: list[tuple[str, str, bytes]]) -> None:
    """Write entries (path, type, content), ordered by path; offsets are running sums of the lengths before."""
    at, listed = 0, []
    ordered = sorted(entries)
    for name, kind, content in ordered:
        listed.append({"p": name, "o": at, "l": len(content), "t": kind})
        at += len(content)
    header = json.dumps({"group": group, "entries": listed}, ensure_ascii=False).encode()
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<I", len(header)) + header)
        for _, _, content in ordered:
            f.write(content)


class _Part(InputPartition):
    def __init__(self, file: str, base: int, entries: list[dict]) -> None:
        self.file, self.base, self.entries = file, base, entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("entriesPerPartition", "40"))

    def partitions(self) -> list[_Part]:
        out = []
        for file in sorted(glob(self.path)):
            header, base = read_header(file)
            e = header["entries"]
            out += [_Part(file, base, e[i : i + self.size]) for i in range(0, len(e), self.size)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.file, "rb") as f:
            for e in partition.entries:
                f.seek(partition.base + e["o"])
                yield partition.file, e["p"], e.get("t") or "image/jpeg", f.read(e["l"])


class ContainerSource(DataSource):
    """Assets of all containers that a path pattern matches."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)
