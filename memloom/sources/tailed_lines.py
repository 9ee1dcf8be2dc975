"""Growing line files as a data source, batch and stream: ``spark.dataSource.register(TailedLines)``, then format "tailed_lines".

An offset holds, for each file, how far whole lines reach and marks of the bytes at the beginning and before that place. The next batch reads on from
there where the marks are as they were; a file that was cut or rewritten has others, and is read anew from its beginning, its rows marked
as such. Offsets lie in the stream's checkpoint, so each line of an unchanged file is read once over any number of runs.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position bigint, value string, restarted boolean"
#: Bytes of a mark, of a step of reading, and of a file's part that one task reads.
MARK_BYTES, STEP_BYTES, PART_BYTES = 4096, 1 << 20, 64 << 20


class Part(InputPartition):
    """Whole lines of a file between two places."""

    def __init__(self, file: str, start: int, stop: int, restarted: bool):
        self.file, self.start, self.stop, self.restarted = file, start, stop, restarted


class Files:
    """The line files of a folder, on any file system that pyarrow knows by the path's scheme."""

    def __init__(self, path: str, glob: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.glob = glob

    def sizes(self) -> dict[str, int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)}

    def read(self, file: str, start: int, stop: int) -> bytes:
        with self.fs.open_input_file(file) as f:
            return f.read_at(max(0, stop - start), start)

    def last_line_end(self, file: str, size: int) -> int:
        """The place after the last line feed within ``size`` bytes."""
        stop = size
        while stop > 0:
            start = max(0, stop - STEP_BYTES)
            at = self.read(file, start, stop).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
        return 0

    def marks(self, file: str, end: int) -> str:
        """A digest of the bytes at the beginning and of those before ``end``."""
        head, tail = self.read(file, 0, min(end, MARK_BYTES)), self.read(file, max(0, end - MARK_BYTES), end)
        return hashlib.sha256(head + b"\0" + tail).hexdigest()[:24]

    def parts(self, file: str, start: int, stop: int, restarted: bool) -> Iterator[Part]:
        """Parts of about PART_BYTES that end with a line."""
        while start < stop:
            end = stop if stop - start <= PART_BYTES else self.line_end(file, start + PART_BYTES, stop)
            yield Part(file, start, end, restarted)
            start = end

    def line_end(self, file: str, at: int, stop: int) -> int:
        while at < stop:
            found = self.read(file, at, min(at + STEP_BYTES, stop)).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += STEP_BYTES
        return stop

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        """The lines of a part, some megabytes at a time."""
        at, rest = part.start, b""
        while at < part.stop:
            raw = self.read(part.file, at, min(at + STEP_BYTES, part.stop))
            at += len(raw)
            if not raw:
                break
            begin = at - len(raw) - len(rest)
            *lines, rest = (rest + raw).split(b"\n")
            places = []
            for line in lines:
                places.append(begin)
                begin += len(line) + 1
            text = [line.decode("utf-8", "replace") for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(text)), pa.array(places, pa.int64()), pa.array(text, pa.string()), pa.array([part.restarted] * len(text))], names=["file", "position", "value", "restarted"])


class TailedLines(DataSource):
    """Options: path (a folder), glob (of file names, all by default)."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def _files(self) -> Files:
        return Files(self.options["path"], self.options.get("glob", "*"))

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self._files())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Tail(self._files())


class _Whole(DataSourceReader):
    def __init__(self, files: Files):
        self.files = files

    def partitions(self) -> list[Part]:
        return [p for f, size in sorted(self.files.sizes().items()) for p in self.files.parts(f, 0, self.files.last_line_end(f, size), False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition)


class _Tail(DataSourceStreamReader):
    def __init__(self, files: Files):
        self.files = files

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        held = {}
        for file, size in self.files.sizes().items():
            end = self.files.last_line_end(file, size)
            held[file] = [end, self.files.marks(file, end)]
        return {"files": json.dumps(held, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        parts = []
        for file, (stop, _) in sorted(now.items()):
            at, mark = before.get(file, (0, ""))
            same = at <= stop and (at == 0 or self.files.marks(file, at) == mark)
            parts += self.files.parts(file, at if same else 0, stop, not same)
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from self.files.rows(partition)

    def commit(self, end: dict) -> None:
        pass
