"""Tables whose versions are published by one manifest: writers prepare files beside it and put out a version only where none came between.

A part is written by Spark's own commit protocol into a folder of its own, so a failed task leaves nothing that is read. A version is a small
manifest that names its parts; it is created without overwriting, under the number after the one its writer expected. Whoever comes second
finds it taken and gets a VersionConflict; what was readable before stays so.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Ends a manifest that is whole.
END = "\n"


class VersionConflict(Exception):
    """Another version came between."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    parts: list[dict] = field(default_factory=list)
    note: dict = field(default_factory=dict)


class VersionedTable:
    """``path``: a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, number: int) -> Version | None:
        stream = self._fs.open(self._path(f"{self.path}/manifest-{number}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(raw)) if raw.endswith(END) else None

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest whole one (0, without parts, where there is none)."""
        if number is not None:
            found = self._read(number) if number else Version()
            if found is None:
                raise ValueError(f"version {number} is not whole")
            return found
        return next((v for n in reversed(self.numbers()) if (v := self._read(n))), Version())

    def write_part(self, df: DataFrame, kind: str) -> dict:
        """Write ``df`` as a part that no version names yet."""
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return {"kind": kind, "folder": folder}

    def publish(self, parts: list[dict], expected: int, note: dict | None = None) -> Version:
        """Put out ``parts`` as the version after ``expected``, or raise VersionConflict."""
        if self.version().number != expected:
            raise VersionConflict(f"version {self.version().number} is not {expected}")
        self._create(f"{self.path}/manifest-{expected + 1}.json", (json.dumps({"parts": parts, "note": note or {}}) + END).encode())
        return Version(expected + 1, parts, note or {})

    def _create(self, path: str, content: bytes) -> None:
        """Write a new file; VersionConflict where there is one."""
        target = self._path(path)
        if self._fs.getScheme() == "file":  # Hadoop's local file system looks and then creates; this does both at once
            try:
                with open(target.toUri().getPath(), "xb") as f:
                    f.write(content)
            except FileExistsError as taken:
                raise VersionConflict(f"{target.getName()} is taken") from taken
            return
        try:
            stream = self._fs.create(target, False)
        except Exception as taken:
            if self._fs.exists(target):
                raise VersionConflict(f"{target.getName()} is taken") from taken
            raise
        stream.write(bytearray(content))
        stream.close()

    def read(self, kind: str, schema: str, number: int | None = None) -> DataFrame:
        """The rows of all parts of a ``kind``; of none, no rows."""
        folders = [f"{self.path}/{p['folder']}" for p in self.version(number).parts if p["kind"] == kind]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, df: DataFrame, kind: str, expected: int, note: dict | None = None) -> Version:
        return self.publish([*self.version(expected).parts, self.write_part(df, kind)], expected, note)

    def import_empty(self, df: DataFrame, kind: str) -> Version:
        """Rows into a table that has no version yet."""
        return self.append(df, kind, 0)

    def overwrite(self, df: DataFrame, kind: str, expected: int) -> Version:
        return self.publish([*[p for p in self.version(expected).parts if p["kind"] != kind], self.write_part(df, kind)], expected)

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the newest ``keep`` versions names, but for those of the last of them on: a writer may be at work
        on folders that no version names yet, so only folders named by an older version go. Returns how many went."""
        numbers = self.numbers()
        kept = {p["folder"] for n in numbers[-keep:] for p in self.version(n).parts}
        gone = {p["folder"] for n in numbers[:-keep] if (v := self._read(n)) for p in v.parts} - kept
        for folder in gone:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        return len(gone)
