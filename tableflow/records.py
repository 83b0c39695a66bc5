"""Numbered records in a folder, each made by one writer only: what commits and marks rest on.

A record is one small JSON file, complete before it has its name, and its name is given to one writer alone: by a hard link on
local disks, elsewhere by a rename that does not replace, which HDFS and file systems like it do as one step. A store that
cannot (some object stores) has one writer at a time. Records lie in folders of a thousand, so that the newest is found
by listing two short folders and opening one file, however many there are.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import SparkSession

from tableflow import workspace

IN_A_FOLDER = 1000
#: How often a writer that lost to another one starts again.
ATTEMPTS = 20
_NAME = re.compile(r"[sv](\d+)(?:\.json)?")


class Conflict(RuntimeError):
    """Another writer was faster."""


class Records:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, folder: str) -> list[int]:
        """The numbers in the names of a folder, newest first; none if there is no folder."""
        system, target = workspace.file_system(self.spark, folder)
        if not system.exists(target):
            return []
        found = [_NAME.fullmatch(status.getPath().getName()) for status in system.listStatus(target)]
        return sorted((int(m[1]) for m in found if m), reverse=True)

    def _file(self, number: int) -> str:
        return f"{self.path}/s{number // IN_A_FOLDER:09d}/v{number:012d}.json"

    def newest(self, count: int = 1) -> list[tuple[int, dict]]:
        """The last ``count`` records, newest first."""
        numbers: list[int] = []
        for folder in self._numbers(self.path):
            numbers += self._numbers(f"{self.path}/s{folder:09d}")
            if len(numbers) >= count:
                break
        return [(n, json.loads(self._read(self._file(n)))) for n in numbers[:count]]

    def latest(self) -> tuple[int, dict] | None:
        return next(iter(self.newest()), None)

    def _read(self, path: str) -> str:
        system, target = workspace.file_system(self.spark, path)
        stream = system.open(target)
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def add(self, number: int, content: dict) -> bool:
        """Make record ``number``; ``False`` if another writer has made it."""
        path = self._file(number)
        system, target = workspace.file_system(self.spark, path)
        _, draft = workspace.file_system(self.spark, f"{self.path}/.draft-{uuid.uuid4().hex}")
        system.mkdirs(target.getParent())
        stream = system.create(draft)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            if system.getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            return not system.exists(target) and system.rename(draft, target)
        except FileExistsError:
            return False
        finally:
            system.delete(draft, False)
