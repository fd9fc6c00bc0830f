"""A streaming source that replays a captured tape in steps of rows."""

from __future__ import annotations

import io
import json

from pyarrow import fs
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .files import TAPE


class ReplayReader(SimpleDataSourceStreamReader):
    """Each trigger reads the next ``rows`` lines of the file from the offset where the last one stopped."""

    def __init__(self, options: dict):
        self.rows = int(options.get("rows", 1000))
        path = options["path"]
        self.store, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def lines(self, start: int, end: int | None):
        names = [field.split(" ")[0] for field in TAPE.split(", ")]
        with io.BufferedReader(self.store.open_input_file(self.path)) as file:
            file.seek(start)
            n = 0
            while (end is None and n < self.rows) or (end is not None and file.tell() < end):
                line = file.readline()
                if not line.endswith(b"\n"):
                    break
                start, n = file.tell(), n + 1
                row = json.loads(line)
                yield start, tuple(row.get(name) for name in names)

    def read(self, start: dict):
        found = list(self.lines(start["byte"], None))
        return iter([row for _, row in found]), {"byte": found[-1][0] if found else start["byte"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([row for _, row in self.lines(start["byte"], end["byte"])])

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    """``spark.dataSource.register(ReplaySource)``; options path (a JSON-lines file, of any store that pyarrow
    reads) and rows."""

    @classmethod
    def name(cls) -> str:
        return "replay_tape"

    def schema(self) -> str:
        return TAPE

    def simpleStreamReader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)
