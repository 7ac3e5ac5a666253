"""Data sources that Spark loads by name: game records and the folders of funnel runs.

``register(spark)`` makes ``spark.read.format("pgn").load(path)`` and ``spark.read.format("funnel_run").load(path)`` work.
Files are cut into byte ranges, and a range has what begins in it, so a large file is read by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrymill.sources.readers import GAME, parse_game

RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: The streams of a funnel run's folder, in the order of its stages. Fixed values.
STREAMS = ("positions", "tier0", "tier1", "triage", "tier3", "tier4")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    label: str = ""


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files of a folder with the suffix, by path."""
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffix)]
    scheme = path.split("://")[0] + "://" if "://" in path and not at.startswith("/") else ("file://" if path.startswith("file:") else "")
    return sorted((scheme + f.path, f.size) for f in found)


def ranges(files: list[tuple[str, int]], size: int, label: str = "") -> list[Range]:
    return [Range(path, start, min(start + size, total), label) for path, total in files for start in range(0, total, size)]


def records_in(part: Range, begin: bytes) -> Iterator[bytes]:
    """The records of a file that begin in a range. One begins with ``begin`` at the start of a line, and the first with the file."""
    system, at = _opened(part.path)
    mark = b"\n" + begin
    with system.open_input_file(at) as f:
        # From one byte earlier on, since a record that begins with the range follows the end of a line there.
        base = max(0, part.start - 1)
        f.seek(base)
        held, begins, look = b"", (0 if part.start == 0 else None), 0
        while True:
            more = f.read(READ_BYTES)
            held += more
            while (cut := held.find(mark, look)) >= 0:
                if begins is not None:
                    yield held[begins - base : cut]
                begins, look = base + cut + 1, cut + 1
                if begins >= part.end:
                    return
            if not more:
                if begins is not None:
                    yield held[begins - base :]
                return
            done = begins - base if begins is not None else max(0, len(held) - len(begin))
            held, base, look = held[done:], base + done, max(0, len(held) - done - len(begin))


class GameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(_files(self.path, ".pgn"), self.size) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.path:
            for text in records_in(part, b"[Event "):
                if game := parse_game(text.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n")):
                    yield game


class Games(DataSource):
    """Games of PGN files, each beginning with its Event tag: tags, result and moves."""

    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return GAME

    def reader(self, schema) -> GameReader:  # noqa: ANN001
        if "path" not in self.options:
            raise ValueError("pgn needs a path")
        return GameReader(dict(self.options))


class RunReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("rangebytes", RANGE_BYTES))
        only = options.get("streams")
        self.streams = [s.strip() for s in only.split(",")] if only else list(STREAMS)
        if unknown := [s for s in self.streams if s not in STREAMS]:
            raise ValueError(f"no streams of a run: {unknown}")

    def partitions(self) -> list[Range]:
        out = []
        for stream in self.streams:
            try:
                out += ranges(_files(f"{self.path}/{stream}.jsonl", ".jsonl"), self.size, stream)
            except FileNotFoundError:
                pass  # a stage that hasn't run
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        for line in records_in(part, b"") if part.path else ():
            text = line.decode(errors="replace").strip()
            if not text:
                continue
            try:
                row = json.loads(text)
                yield part.label, (str(row["id"]) if isinstance(row, dict) and row.get("id") is not None else None), text, isinstance(row, dict)
            except ValueError:
                yield part.label, None, text, False


class Runs(DataSource):
    """The records of a funnel run's folder: stream, id, the record's JSON, and whether it is an object at all.

    Streams that aren't there have no rows; ``streams`` names the wanted ones, separated by commas.
    """

    @classmethod
    def name(cls) -> str:
        return "funnel_run"

    def schema(self) -> str:
        return "stream string, id string, json string, valid boolean"

    def reader(self, schema) -> RunReader:  # noqa: ANN001
        if "path" not in self.options:
            raise ValueError("funnel_run needs a path")
        return RunReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Games)
    spark.dataSource.register(Runs)
