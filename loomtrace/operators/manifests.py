"""Numbered manifests: what a table consists of, published one after the other so that a reader always finds a whole one.

A manifest is written aside and moved to the next number by a rename that does not replace. Of two writers that start from one
manifest the second finds the number taken; a crash leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer published first."""


class Manifests:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> tuple[int, dict | None]:
        """Number and body of the last manifest; (0, None) if there is none."""
        folder, fs = self.at("manifests")
        if not fs.exists(folder):
            return 0, None
        names = [n for s in fs.listStatus(folder) if (n := s.getPath().getName())[0].isdigit() and n.endswith(".json")]
        if not names:
            return 0, None
        found, _ = self.at(f"manifests/{max(names)}")
        return int(max(names)[:-5]), json.loads(self.spark.read.text(found.toString(), wholetext=True).first()[0])

    def publish(self, after: int, body: dict) -> int:
        """Make ``body`` the manifest that follows number ``after``."""
        draft, fs = self.at(f"manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        target, _ = self.at(f"manifests/{after + 1:012d}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict(f"manifest {after + 1} exists")
        return after + 1

    def delete(self, name: str = "") -> None:
        target, fs = self.at(name) if name else (self.spark._jvm.org.apache.hadoop.fs.Path(self.path), self.at("x")[1])
        fs.delete(target, True)

    def unnamed(self, folder: str, named: set[str]) -> list[str]:
        """Entries of a folder that are not among ``named``."""
        where, fs = self.at(folder)
        return [f"{folder}/{n}" for s in fs.listStatus(where) if (n := s.getPath().getName()) not in named] if fs.exists(where) else []
