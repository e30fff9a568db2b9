"""Versions of a folder's tables: a version is a small file that names its folders, and the newest one counts.

Folders are written first, under names of their own, and never changed; the file comes last, by a rename
that fails if another writer took the number. So who has opened a version reads it whole, whatever is
published meanwhile, and a writer that dies leaves folders that no version names. ``collect`` deletes what only old
versions name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published since this one read."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root, f"{root}/_versions"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, fs = self._path(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{number:012d}.json", wholetext=True).first()[0])

    def current(self) -> dict:
        """The newest version's content with its ``version``; version 0 is empty."""
        numbers = self.numbers()
        return self.read(numbers[-1]) | {"version": numbers[-1]} if numbers else {"version": 0, "folders": []}

    def publish(self, state: dict, after: int) -> int:
        """Makes ``state`` the version that follows ``after``; ``folders`` are what it needs, relative to the root."""
        number = after + 1
        made, fs = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        goal, _ = self._path(f"{self.folder}/{number:012d}.json")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(state, default=str).encode()))
        out.close()
        # the local file system renames over a file, others refuse to
        if (self.numbers() or [0])[-1] >= number or not fs.rename(made, goal):
            fs.delete(made, False)
            raise Conflict(f"version {number} exists")
        return number

    def collect(self, keep: int = 2) -> list[str]:
        """Deletes the versions before the last ``keep``, and the folders that only they name."""
        numbers = self.numbers()
        held = {f for n in numbers[-keep:] for f in self.read(n)["folders"]}
        old = sorted({f for n in numbers[:-keep] for f in self.read(n)["folders"]} - held)
        for n in numbers[:-keep]:
            path, fs = self._path(f"{self.folder}/{n:012d}.json")
            fs.delete(path, False)
        for name in old:
            path, fs = self._path(f"{self.root}/{name}")
            fs.delete(path, True)
        return old
