"""Numbered entries that make what writers have written count, one at a time.

An entry appears with its content in one step: it is written aside and then given its
name, which fails where the name is taken.  On local folders that is a hard link, on
other file systems a rename without overwriting (atomic on HDFS; a store whose
renames are copies needs a committer of its own).  A reader never sees half an entry.

A writer reads the log, works out its change and appends at the number that it read; if
another was first, it starts again.  An entry with ``"restart": True`` stands for all
before it, which are then deleted; a writer that comes late with one of their numbers
finds out after appending, and starts again too.
"""

from __future__ import annotations

import json
import os
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self._conf), path

    def _names(self) -> list[str]:
        fs, path = self._fs(self.folder)
        if not fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.isdigit())

    def _open(self, name: str) -> dict | None:
        """An entry; None if it is gone by now."""
        fs, path = self._fs(f"{self.folder}/{name}")
        try:
            held = fs.open(path)
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.getClass().getName():
                return None
            raise
        text = self._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        held.close()
        if not text:
            raise ValueError(f"entry {self.folder}/{name} has no content")
        return json.loads(text)

    def read(self) -> tuple[int, list[dict]]:
        """Number of the next entry, and the entries from the last restart on."""
        while True:
            names, out = self._names(), []
            for name in reversed(names):
                entry = self._open(name)
                if entry is None:  # a restart came meanwhile
                    break
                out.append(entry)
                if entry.get("restart"):
                    break
            else:
                entry = {}
            if entry is not None:
                return int(names[-1]) + 1 if names else 0, out[::-1]

    def append(self, n: int, entry: dict) -> bool:
        """Add ``entry`` as number ``n``; False if another writer was first."""
        fs, aside = self._fs(f"{self.folder}/aside-{uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"n": n, **entry}).encode()))
        out.close()
        added = self._name(fs, aside, f"{self.folder}/{n:010d}")
        fs.delete(aside, False)
        if added and any(int(x) > n and (self._open(x) or {}).get("restart") for x in self._names()):
            fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n:010d}"), False)
            return False
        if added and entry.get("restart"):
            for x in self._names():
                if int(x) < n:
                    fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}"), False)
        return added

    def _name(self, fs, aside, name: str) -> bool:
        to = self._jvm.org.apache.hadoop.fs.Path(name)
        if fs.getUri().getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), to.toUri().getPath())
            except FileExistsError:
                return False
            return True
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(aside, to, options)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True
